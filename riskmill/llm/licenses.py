"""Licence scans through a positional rare-token index, in DataFrame operations only.

Each licence has templates (sentences as word lists) and mandatory key phrases. The index has, for the rarest words of each
template (highest inverse document frequency among the templates), their postings: template and position. A file's words
are looked up in that index; word w at place p which stands at position q of template t votes for t beginning at p - q.
Votes are intersected: where all rare words of a template agree on one beginning, the template is found. A licence
is reported when a template is found and every mandatory phrase of it stands in the file.

The base labels come from the same look-up with the base phrases as templates: a phrase stands where all of its words agree
on one beginning, so every place is counted exactly.

Only documents with an index word leave the text scan, with the places of such words and no others. The index has
a fixed size: it is a table of the templates.

Defined cases: a null or empty text has no words, no labels, null places and score 0; repeated rows are scanned each for
itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.llm.shared import documents

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Everything else in ASCII parts words; digits, letters and all other characters make them.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose places count, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Well-known licence sentences, label by label, and the phrases that each label demands.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("cc", "licensed under cc by nc 4 0"),
    ("cc", "licensed under a creative commons attribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
KEY_PHRASES = {
    "mit": ("mit license|permission is hereby granted",), "apache": ("apache license",), "gpl": ("general public license",),
    "lgpl": ("lesser general public license",), "agpl": ("affero general public license",),
    "cc": ("cc by|creative commons",), "bsd": ("redistribution and use",), "mpl": ("mozilla public license",),
    "isc": ("permission to use copy",), "unlicense": ("free and unencumbered",),
}
RARE = 4


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words in order."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.filter(F.split(lower, PARTS), lambda w: w != "")


def positional_index(templates, base) -> list[tuple[str, str, int, int, bool]]:
    """(word, label, template, position, is_base): the rare words of templates and all words of base phrases."""
    texts = [t.split() for _, t in templates]
    df = Counter(w for t in texts for w in set(t))
    idf = {w: log(len(texts) / n) for w, n in df.items()}
    out = []
    for k, ((label, _), words) in enumerate(zip(templates, texts, strict=True)):
        places = sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))[:RARE]
        out += [(words[i], label, k, i, False) for i in sorted(places)]
    for k, (phrase, label) in enumerate(base, len(texts)):
        out += [(w, label, k, i, True) for i, w in enumerate(phrase.split())]
    return out


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE, key_phrases=KEY_PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    ``score`` is the largest share of a template's words that stand at their places, 1 where a base phrase stands.
    """
    index = positional_index(templates, base)
    vocabulary = sorted({w for w, *_ in index})
    # The postings of a word, as a literal map: word -> [(template, position)].
    postings = F.create_map(*[
        c for w in vocabulary for c in (
            F.lit(w),
            F.array(*[F.struct(F.lit(k).alias("t"), F.lit(i).alias("q")) for x, _, k, i, _ in index if x == w]),
        )
    ])
    words = documents(docs).select("doc_id", words_of(F.col("text")).alias("words"))
    placed = F.filter(
        F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("p"))), lambda x: x["w"].isin(vocabulary)
    )
    spotted = words.select("doc_id", F.size("words").alias("n_words"), "words", placed.alias("spots"))
    votes = F.flatten(F.transform("spots", lambda s: F.transform(
        F.element_at(postings, s["w"]), lambda x: F.struct(x["t"].alias("t"), (s["p"] - x["q"]).alias("at"))
    )))
    voted = spotted.select("doc_id", "n_words", "words", F.when(F.size("spots") > 1, F.array_sort(votes)).alias("votes"))

    needed = Counter(k for _, _, k, _, _ in index)
    need = F.array(*[F.lit(needed[k]) for k in range(len(templates) + len(base))])
    # Equal votes lie side by side; a beginning is found where as many agree as the template has index words.
    size = F.size("votes")
    found = F.filter(
        F.transform("votes", lambda v, i: F.when(
            (i + F.get(need, v["t"]) <= size) & (F.get(F.col("votes"), i + F.get(need, v["t"]) - 1) == v), v
        )), lambda v: v.isNotNull(),
    )
    hits = voted.select("doc_id", "n_words", "words", F.coalesce(found, F.array().cast(
        "array<struct<t:int,at:int>>")).alias("found"))

    first_base = len(templates)
    starts = F.transform(F.filter("found", lambda v: v["t"] >= first_base), lambda v: v["at"])
    base_names = F.array(*[F.lit(label) for _, label in base])
    base_labels = F.array_sort(F.array_distinct(F.transform(
        F.filter("found", lambda v: v["t"] >= first_base), lambda v: F.get(base_names, v["t"] - first_base)
    )))
    names = F.array(*[F.lit(label) for label, _ in templates])
    texts = F.array(*[F.array(*[F.lit(w) for w in t.split()]) for _, t in templates])

    def share(v):
        mine = F.get(texts, v["t"])
        same = F.aggregate(
            F.transform(mine, lambda w, i: F.when(F.get(F.col("words"), v["at"] + i) == w, 1).otherwise(0)),
            F.lit(0), lambda a, b: a + b,
        )
        return F.struct(F.get(names, v["t"]).alias("label"), (same / F.size(mine)).alias("share"))

    shares = F.transform(F.filter("found", lambda v: (v["t"] < first_base) & (v["at"] >= 0)), share)
    told = hits.select(
        "doc_id", "n_words", starts.alias("starts"), base_labels.alias("base_labels"),
        F.when(F.size("found") > 0, shares).alias("shares"),
        F.when(F.size("found") > 0, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).alias("line"),
    )

    def demanded(label: str) -> Column:
        ok = F.lit(True)
        for either in key_phrases.get(label, ()):
            one = F.lit(False)
            for phrase in either.split("|"):
                one = one | F.contains(F.col("line"), F.lit(f" {phrase} "))
            ok = ok & one
        return ok

    own = [
        F.when(F.array_contains("shares.label", label) & demanded(label), F.lit(label))
        for label in sorted({label for label, _ in templates})
    ]
    own_labels = F.filter(F.array(*own), lambda x: x.isNotNull())
    best = F.coalesce(F.array_max("shares.share"), F.lit(0.0))
    return told.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base_labels", F.when(F.col("shares").isNotNull(), own_labels)
                                                            .otherwise(F.array().cast("array<string>"))))), ",").alias("labels"),
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
