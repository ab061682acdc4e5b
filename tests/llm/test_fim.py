"""Fill-in-middle: every case beside plain string work, and the index beside Python's own code points."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from riskmill.llm import fim

ROWS = [
    (1, "plain words without anything special, long enough to be cut somewhere", "x"),
    (2, "", "x"), (3, None, "x"), (4, "a", None), (5, "é", "x"), (6, "日本語のテキスト" * 50, "x"),
    (7, "mixed é text 😀 with 𝒳 four-byte and \x00 zero", "x"), (8, "holds <M> a mark", "x"), (9, "<P>", "x"),
    (10, "nearly < P> and <p> and <S", "x"), (None, "no identifier", "x"), (None, None, None),
    (11, "repeated", "x"), (11, "repeated", "x"), (11, "repeated identifier, other text", "x"),
    *[(i, "ab😀cdé" * (i % 13), "y") for i in range(100, 400)],
]


def by_hand(doc_id, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", one, two - one, f"<S>{text[two:]}<P>{text[:one]}<M>{text[one:two]}"
    return doc_id, n, "psm", one, two - one, f"<P>{text[:one]}<S>{text[two:]}<M>{text[one:two]}"


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


def test_every_case_equals_plain_string_work(spark):
    # Columns that bear the names of outputs don't matter.
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, form string").repartition(3)
    for how in (fim.Fim(), fim.Fim(slice_bytes=16)):
        made = fim.transform(docs, how)
        found = [tuple(r) for r in made.collect()]
        assert sorted(found, key=key) == sorted((by_hand(a, b) for a, b, _ in ROWS), key=key)
        back = fim.restored(made).select("doc_id", "restored").collect()
        assert sorted(map(tuple, back), key=key) == sorted(((a, b or "") for a, b, _ in ROWS), key=key)
    forms = {r[2] for r in found}
    assert forms == {"plain", "psm", "spm"}


def test_digests_and_empty_table(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, form string")
    for r in fim.digests(docs).where("doc_id < 100").collect():
        texts = [b or "" for a, b, _ in ROWS if a == r["doc_id"]]
        assert r["restored_sha256"] in {hashlib.sha256(t.encode()).hexdigest() for t in texts}
        assert r["output_sha256"] in {hashlib.sha256(by_hand(r["doc_id"], t)[5].encode()).hexdigest() for t in texts}
    assert fim.digests(docs.limit(0)).collect() == []


def test_very_long_text(spark):
    text = "line with ü and plain words\n" * 200_000
    row = fim.restored(fim.transform(spark.createDataFrame([(5, text)], "doc_id long, text string"))).first()
    assert row["restored"] == text and row["n"] == len(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aé日😀\x00\n", max_size=12), min_size=1, max_size=6))
def test_cuts_go_both_ways(texts):
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    index = fim.Exceptions(np.frombuffer(b"".join(raw), np.uint8), bounds[:-1], bounds[1:])
    assert index.length.tolist() == [len(t) for t in texts]
    for share in (0, 1, 2, 3):
        cut = index.length * share // 3
        byte = index.byte(cut)
        assert byte.tolist() == [len(t[:c].encode()) for t, c in zip(texts, cut, strict=True)]
        assert index.code_point(byte).tolist() == cut.tolist()


def test_given_table_restores_whole_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wrong = fim.restored(fim.transform(docs)).join(docs.select("doc_id", "text"), "doc_id").where("restored <> text")
    assert wrong.count() == 0
