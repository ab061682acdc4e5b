"""Near duplicates by bottom-k sketches: one hash function, the k smallest values of a document's shingles.

1. One pass over the texts makes each document's shingle hashes (five words), their number, a 128-bit digest of the
   set and the sketch. Documents with equal sets are one class from then on.
2. Inverted lists of retained values. Two sketches whose estimate reaches the filter share a minimum number of
   values, so they share one of the rarest values of either: only those are listed (prefix filtering by the exact
   frequency of every value). A passage found in a third of all documents gets into no list.
3. Each round, a list's members are paired with one member, its centre, unless a link already joins them to it. The
   estimate from the union of two sketches filters the pairs; intersections of the full sets confirm them. A
   group of n near copies needs about n pairs per round, not n². Centres change from round to round.
4. Documents that the rounds leave in lists of several components meet once more, through prefixes of their full
   sets: an exact filter, so no link between them is lost, and texts that are alike only below the threshold
   don't meet. Members of a shingle's largest component are not paired with each other.

Sets of words: A-Z are lower-cased and words are runs of bytes other than ASCII white space. A text with fewer than five
words has its whole sequence as one shingle. Sketches that hold the whole set give the exact similarity.

Defined cases: null and empty texts have an empty set and are linked with nothing, not even each other; rows
with a null identifier are left out (they can be named in no link); rows with equal identifiers count as copies of
one document, and their sets are compared as any others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.llm.shared import WordCache, components, documents, in_slices, kept
from riskmill.session import materialize

#: 64-bit words of a set's bit map; long sets fill it, and then it filters less.
BIT_WORDS = 16
SKETCHES = "doc_id long, n_shingles long, set_key binary, sketch array<long>"


@dataclass(frozen=True)
class Near:
    """Links pairs with ``100 * intersection >= percent * union``.

    ``least`` of ``k`` sketch values must agree. For similarity 0.75 and k = 32 the expected number is 24 with a
    deviation of 2.45, so 13 is missed with a probability of about 1 in 50,000 at the very threshold.
    """

    words: int = 5
    percent: int = 75
    k: int = 32
    least: int = 13
    rounds: int = 4


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits (multiply and shift)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, words: int):
        self.width = words
        self.words = WordCache(xxhash.xxh3_64_intdigest, 150_000)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        each = self.words.of(words)
        width = min(self.width, len(words))
        n = len(words) - width + 1
        total = np.full(n, width, np.uint64)
        for i in range(width):
            total = _mixed(total) + each[i : i + n]
        return np.unique(_mixed(total))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def sketches(docs: DataFrame, how: Near = Near()) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()),
                        ("sketch", pa.list_(pa.int64()))])
    width, k = how.words, how.k

    def make(ids, texts):
        shingler = kept(("shingler", width), lambda: Shingler(width))
        sets = [shingler(t) for t in texts]
        return {
            "doc_id": ids, "n_shingles": [len(s) for s in sets],
            "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            "sketch": [_signed(s[:k]) for s in sets],
        }

    return documents(docs).where("doc_id IS NOT NULL").mapInArrow(in_slices(make, schema), SKETCHES)


def shingle_sets(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """(doc_id, shingles): the sorted hashes as bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])
    width = how.words

    def make(ids, texts):
        shingler = kept(("shingler", width), lambda: Shingler(width))
        return {"doc_id": ids, "shingles": [shingler(t).tobytes() for t in texts]}

    return documents(docs).mapInArrow(in_slices(make, schema), "doc_id long, shingles binary")


def listed(classes: DataFrame, how: Near) -> DataFrame:
    """(id, own, value) of the rarest values of each sketch, where a value has more than one holder.

    A sketch of s values must share t = min(least, percent of s) with a partner, so its s - t + 1 rarest are enough.
    Values with one holder (``own`` of them) are the rarest of all and take their places without being moved again.
    """
    postings = classes.select("id", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    held = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    common = postings.join(held, "value").groupBy("id").agg(
        F.first("s").alias("s"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values")
    )
    own = F.col("s") - F.size("values")
    needed = F.least(F.lit(how.least), F.ceil(F.col("s") * how.percent / 100))
    room = (F.col("s") - needed + 1 - own).cast("int")
    return common.where(room > 0).select(
        "id", own.alias("own"), F.explode(F.slice("values.value", 1, room)).alias("value")
    )


def estimated(pairs: DataFrame, classes: DataFrame, how: Near) -> DataFrame:
    """Pairs whose sketches agree in enough of the smallest values of their union."""
    left = classes.select(F.col("id").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    right = classes.select(F.col("id").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * how.percent)
    k, least, percent = how.k, how.least, how.percent

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                union = np.union1d(x, y)[:k]
                shared = np.intersect1d(np.intersect1d(x, y, True), union, True).size
                keep.append(shared >= min(least, ceil(union.size * percent / 100)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, how: Near) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    percent = how.percent

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * shared >= percent * (x.size + y.size - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("xb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def classes_of(found: DataFrame) -> DataFrame:
    """One row per distinct non-empty set: its smallest document, size and sketch."""
    return found.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
    )


def near_links(docs: DataFrame, classes: DataFrame, how: Near = Near()) -> DataFrame:
    """Confirmed links (a, b) between classes; they connect every pair that is similar enough."""
    spark = docs.sparkSession
    lists = materialize(listed(classes, how), "lists")
    wanted = lists.groupBy("value").agg(F.count("*").alias("c")).where("c > 1").select("value")
    lists = materialize(lists.join(wanted, "value"), "lists")
    members = lists.select(F.col("id").alias("doc_id")).distinct()
    sets = materialize(
        shingle_sets(docs.join(members, "doc_id", "left_semi"), how).groupBy("doc_id")
        .agg(F.first("shingles").alias("shingles")) if _repeats(classes)
        else shingle_sets(docs.join(members, "doc_id", "left_semi"), how), "sets",
    )
    root = lists.select("id", F.col("id").alias("root")).distinct()
    links, tried = None, None
    for turn in range(how.rounds):
        rooted = lists.join(root, "id")
        mixed = rooted.groupBy("value").agg(
            F.min("root").alias("low"), F.max("root").alias("high"),
            # Who has least to itself is closest to what the others share; ties change from round to round.
            F.min_by(F.struct("id", "root"), F.struct("own", F.xxhash64("id", F.lit(turn)))).alias("centre"),
        ).where("low <> high").select("value", "centre")
        pairs = rooted.join(mixed, "value").where("root <> centre.root").select(
            F.least("id", "centre.id").alias("a"), F.greatest("id", "centre.id").alias("b")
        ).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        n = pairs.count()
        if not n:
            break
        tried = pairs if tried is None else tried.unionAll(pairs)
        fresh = materialize(confirmed(materialize(estimated(pairs, classes, how), "estimated"), sets, how), "links")
        links = fresh if links is None else links.unionAll(fresh)
        root = _roots(lists, links)
        if turn and 20 * fresh.count() < n:
            break
    if links is None:
        return spark.createDataFrame([], "a long, b long")

    # The rest, whole: documents of lists that still hold several components meet through their full sets.
    rooted = lists.join(root, "id")
    mixed = rooted.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    loose = materialize(rooted.join(mixed.select("value"), "value").select("id", "root").distinct(), "loose")
    rest = unlinked_pairs(loose, sets, how).join(tried, ["a", "b"], "left_anti")
    last = confirmed(materialize(rest, "pairs"), sets, how)
    return links.unionAll(materialize(last, "links"))


def unlinked_pairs(loose: DataFrame, sets: DataFrame, how: Near) -> DataFrame:
    """Every pair of (id, root) rows with different roots that can be similar enough, by prefixes of the full sets.

    With shingles ordered from rare to frequent, two similar sets share one among the first ``1 - j`` of the larger
    set and the first ``1 - 2j / (1 + j)`` of the smaller one. What each text has for itself fills these prefixes. At
    the first shingle they share, what is left of either set must suffice for the whole intersection (positional
    filter), and so must what bit maps of the sets allow (bitmap filter). So texts that are alike only below the
    threshold hardly meet. All these filters are exact: none loses a link.
    """
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("value", pa.int64())])

    def run(batches):
        for batch in batches:
            for i, held in enumerate(batch.column("shingles")):
                values = np.frombuffer(held.as_buffer(), np.int64)
                doc = np.full(len(values), batch.column("id")[i].as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc), pa.array(np.full(len(values), len(values))), pa.array(values)], schema=schema
                )

    def map_bits(batches):
        for batch in batches:
            maps = np.zeros((batch.num_rows, BIT_WORDS), np.uint64)
            for i, held in enumerate(batch.column("shingles")):
                spots = np.frombuffer(held.as_buffer(), np.uint64) % np.uint64(64 * BIT_WORDS)
                np.bitwise_or.at(maps[i], spots >> np.uint64(6), np.uint64(1) << (spots & np.uint64(63)))
            columns = [pa.array(_signed(np.ascontiguousarray(maps[:, k]))) for k in range(BIT_WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", *bits])

    bits = [f"b{k}" for k in range(BIT_WORDS)]
    whole = sets.select(F.col("doc_id").alias("id"), "shingles").join(loose.select("id"), "id", "left_semi")
    loose = loose.join(whole.mapInArrow(map_bits, ", ".join(["id long", *(f"{b} long" for b in bits)])), "id")
    postings = materialize(whole.mapInArrow(run, "id long, n long, value long"), "postings")
    held = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    common = postings.join(held, "value").groupBy("id").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values")
    )
    own, j = F.col("n") - F.size("values"), how.percent
    probe = F.col("n") - F.ceil(F.col("n") * j / 100) + 1 - own
    index = F.col("n") - F.ceil(F.col("n") * 2 * j / (100 + j)) + 1 - own
    first = common.select("id", "n", F.posexplode(F.slice("values.value", 1, F.greatest(probe, F.lit(0)).cast("int"))).alias(
        "place", "value"), index.alias("index"), own.alias("own"))
    rows = materialize(
        first.join(loose, "id").select("id", "n", "root", "value", (F.col("place") < F.col("index")).alias("indexed"),
                                       (F.col("n") - F.col("own") - F.col("place")).alias("left"), *bits),
        "prefixes",
    )
    sizes = rows.groupBy("value", "root").agg(F.count("*").alias("c"))
    main = main_roots(sizes)
    mixed = rows.join(main.where("several > 1").select("value", "main"), "value")
    one = mixed.where("root <> main").select(
        "value", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"), F.col("indexed").alias("ix"),
        F.col("left").alias("lx"), *[F.col(b).alias(f"x{b}") for b in bits])
    two = mixed.select(
        "value", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("root").alias("ry"), F.col("indexed").alias("iy"),
        F.col("left").alias("ly"), (F.col("root") == F.col("main")).alias("in_main"),
        *[F.col(b).alias(f"y{b}") for b in bits])
    only_x = " + ".join(f"bit_count(x{b} & ~y{b})" for b in bits)
    only_y = " + ".join(f"bit_count(y{b} & ~x{b})" for b in bits)
    met = one.join(two, "value").where(
        f"rx <> ry AND (in_main OR x < y) AND ((nx >= ny AND iy AND ny * 100 >= nx * {j})"
        f" OR (ny >= nx AND ix AND nx * 100 >= ny * {j}))"
        # At the first shingle that two sets share, all they share is still to come in both.
        f" AND least(lx, ly) * {100 + j} >= {j} * (nx + ny)"
        # A bit that one map alone has stands for at least one shingle that the other set lacks.
        f" AND least(nx - ({only_x}), ny - ({only_y})) * {100 + j} >= {j} * (nx + ny)"
    )
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def main_roots(sizes: DataFrame) -> DataFrame:
    """(value, main, several): the root with most rows of each value, of equal ones the larger, and how many there are.

    The choice is total, because it is made again for either side of a join and both have to name the same root.
    """
    return sizes.groupBy("value").agg(
        F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("several")
    )


def _repeats(classes: DataFrame) -> bool:
    """Whether an identifier stands for two different sets (rows that repeat an identifier)."""
    return not classes.groupBy("id").count().where("count > 1").isEmpty()


def _roots(lists: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links, "list-components")
    ids = lists.select("id").distinct()
    return materialize(
        ids.join(found, ids["id"] == found["node"], "left").select("id", F.coalesce("root", "id").alias("root")), "roots"
    )


def near_duplicates(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document with an identifier."""
    found = materialize(sketches(docs, how), "sketches")
    classes = materialize(classes_of(found), "classes")
    links = near_links(docs.where("doc_id IS NOT NULL"), classes, how)
    found_roots = components(links)
    known = classes.select("set_key", "id").join(
        found_roots, F.col("id") == F.col("node"), "left"
    ).select("set_key", F.coalesce("root", "id").alias("component_id"))
    out = found.select("doc_id", "n_shingles", "set_key").join(known, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, and rows without an identifier."""
    gone = near_duplicates(docs, how).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
