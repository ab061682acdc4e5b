import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from riskmill.operators.scoring import responses, score_table
from riskmill.operators.validate import validate_records
from riskmill.plans.fixtures import RISK_SPEC, record_lines
from riskmill.plans.queries import CHOSEN
from riskmill.session import new_folder
from riskmill.sources import tables
from riskmill.streaming import score_stream
from riskmill.streaming.score_stream import (
    committed_batches, committed_responses, scored_records, start_responding, start_scoring,
)


def test_stream_equals_batch_over_several_runs(spark, sf_dir):
    source, out, state = (new_folder(spark, n) for n in ("in", "out", "state"))
    lines = record_lines(spark, sf_dir).select("body")
    halves = lines.withColumn("h", F.xxhash64("body") % 2)

    def run():
        start_scoring(tables.json_lines(spark, source, stream=True), out, state, RISK_SPEC, CHOSEN).awaitTermination()

    for half in (0, 1):
        halves.filter(F.abs("h") == half).select("body").write.mode("append").text(source)
        run()
    run()
    columns = ["body", "risk_score", "prediction", "risk_category", "valid"]
    got = scored_records(spark, out).select(columns)
    want = score_table(validate_records(lines, RISK_SPEC), RISK_SPEC, CHOSEN).select(columns)
    assert got.count() == want.count() == 1000
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # A stream that starts anew with another checkpoint reads everything again and leaves the earlier output.
    start_scoring(
        tables.json_lines(spark, source, stream=True), out, new_folder(spark, "state"), RISK_SPEC, CHOSEN
    ).awaitTermination()
    assert scored_records(spark, out).count() == 2000
    assert not scored_records(spark, out).filter("not valid").isEmpty()


def test_readers_see_a_batch_once_whatever_fails(spark, sf_dir, monkeypatch):
    """The first attempt writes all its rows and dies before its commit; later a committed batch is repeated."""
    source, out, state = (new_folder(spark, n) for n in ("in", "out", "state"))
    lines = record_lines(spark, sf_dir).select("body")
    lines.write.text(source)
    want = responses(score_table(validate_records(lines, RISK_SPEC), RISK_SPEC, CHOSEN).withColumn("accepted", F.col("valid")))
    want = want.select("body", "response", "accepted")

    def run():
        stream = tables.json_lines(spark, source, stream=True)
        start_responding(stream, out, state, RISK_SPEC, CHOSEN).awaitTermination()

    def dies(*args):
        raise OSError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(score_stream, "_commit", dies)
        with pytest.raises(StreamingQueryException):
            run()
    assert committed_responses(spark, out).isEmpty() and committed_batches(spark, out).isEmpty()
    assert spark.read.parquet(f"{out}/batches").count() == 1000
    run()
    first = committed_responses(spark, out).select(want.columns)
    assert first.exceptAll(want).isEmpty() and want.exceptAll(first).isEmpty()
    real = score_stream._commit
    with monkeypatch.context() as patched:
        # Dies after the commit: the batch is repeated, and what is committed stays.
        patched.setattr(score_stream, "_commit", lambda *a: (real(*a), dies())[1])
        lines.limit(10).write.mode("append").text(source)
        with pytest.raises(StreamingQueryException):
            run()
    run()
    assert committed_responses(spark, out).count() == 1010 and committed_batches(spark, out).count() == 2
    sides = {r["accepted"]: r["n"] for r in committed_responses(spark, out).groupBy("accepted").agg(F.count("*").alias("n")).collect()}
    assert sides[True] > 0 and sides[False] > 0
