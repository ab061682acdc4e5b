"""Every stage of the pipeline on given and odd rows."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from riskmill.llm import exact_dedup, quality, toxicity
from riskmill.llm.shared import table


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    """Documents, and some of their texts again: without identifier, under one that others bear, twice the same."""
    docs = table(spark, sf_dir, "documents").withColumns({"_text": F.lit("kept"), "_gone": F.lit(1), "score": F.lit("x")})
    some = docs.where("doc_id < 60")
    first = docs.agg(F.min("doc_id")).first()[0]
    return docs.unionByName(some.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(
        some.withColumn("doc_id", F.lit(first))
    ).unionByName(some).unionByName(some.limit(2).withColumn("text", F.lit(None).cast("string"))).cache()


@pytest.mark.parametrize("name", ["quality classifier", "toxicity"])
def test_verdicts_reach_their_own_rows(spark, sf_dir, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    module, bad = (quality, "predicted = 0") if name == "quality classifier" else (toxicity, "toxic = 1")
    model = module.fit(odd, table(spark, sf_dir, "labels"))
    texts = odd.select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("doc_id", F.xxhash64("text"))
    rejected = {r["doc_id"] for r in module.score(texts, model).where(bad).collect()}
    kept = stage(spark, odd, sf_dir)
    assert kept.columns == odd.columns
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    wanted = odd.where(~key.isin(list(rejected) or [0]))
    assert rejected and kept.exceptAll(wanted).isEmpty() and wanted.exceptAll(kept).isEmpty()


def test_copies_go_by_identifier_and_text(spark):
    rows = [(1, "a", "p"), (5, "a", "q"), (5, "b", "r"), (5, "b", "s"), (None, "c", "t"), (None, "c", "u"), (None, "a", "v"),
            (7, None, "w"), (8, "", "x"), (9, "b  b", "y"), (2, "b\tb", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string")
    kept = [tuple(r) for r in exact_dedup.drop_duplicates(docs).collect()]
    assert sorted((a, b) for a, b, _ in kept if a) == [(1, "a"), (2, "b\tb"), (5, "b"), (7, None)]
    assert [(b, c) for a, b, c in kept if a is None] in ([("c", "t")], [("c", "u")])
    assert exact_dedup.drop_duplicates(docs.limit(0)).collect() == []


def test_whole_run(spark, sf_dir):
    docs, counts = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir).cache()
        assert after.columns == docs.columns and after.exceptAll(docs).isEmpty(), name
        counts.append((docs.count(), after.count()))
        docs = after
    assert all(b < a for a, b in counts[2:]) and all(b <= a and b > 0 for a, b in counts)
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert filled.where("n > 1024").isEmpty()


def test_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name in ("exact dedup", "minhash near-dedup", "best-fit packing"):
        assert dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), sf_dir).collect() == []
