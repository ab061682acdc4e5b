import hashlib
import re
from collections import defaultdict

import pytest

from riskmill.llm import exact_dedup

SCHEMA = "doc_id long, text string, body string, head string, range int"


def by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", text or "")].append(doc_id)
    return {
        (doc_id, min(ids), len(ids), doc_id == min(ids), hashlib.sha256(body.encode()).hexdigest())
        for body, ids in groups.items() for doc_id in ids
    }


@pytest.mark.parametrize("samples", [24, 1])
def test_groups(spark, monkeypatch, samples):
    monkeypatch.setattr(exact_dedup, "SAMPLES_PER_RANGE", samples)
    base = "a common beginning that is long enough to fill the key "
    texts = ["", None, " ", "a  b", "a\tb", "a\x0b\x0cb", "a\u00a0b", "A b", "x" * 200_000, "x" * 200_000 + "y"]
    rows = list(enumerate(texts * 2 + ["hot text"] * 700 + [base + str(i % 7) for i in range(300)]))
    docs = spark.createDataFrame([(i, t, "q", "r", 1) for i, t in rows], SCHEMA).repartition(7)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert {tuple(r) for r in got} == by_hand(rows) and len(got) == len(rows)


def test_hash_collisions_and_cuts_inside_groups(spark, monkeypatch):
    """Keys that tell nothing apart: full comparisons alone decide, also across ranges."""
    monkeypatch.setattr(exact_dedup, "KEY_BYTES", 0)
    monkeypatch.setattr(exact_dedup.F, "xxhash64", _flat(exact_dedup.F.xxhash64, exact_dedup.F.lit))
    rows = [(i, f"text {i % 3}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert {tuple(r) for r in got} == by_hand(rows)


def _flat(real, lit):
    return lambda *cols: lit(7).cast("long") if cols == ("body",) else real(*cols)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, "b"), (None, "b"), (3, "c"), (3, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == 8 and sum(r.kept for r in got) == 4
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got if r.group_size == 4} == {(1, 1, 4), (2, 1, 4), (None, 1, 4)}
    kept = exact_dedup.drop_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "b"), (1, "a"), (3, "c"), (3, "d")]
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0
    assert exact_dedup.drop_duplicates(docs.limit(0)).count() == 0
