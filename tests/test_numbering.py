import pytest
from pyspark.sql import functions as F

from riskmill.operators.numbering import row_numbers


@pytest.fixture
def many_parts(spark):
    settings = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_numbers_follow_the_order(spark, many_parts):
    rows = [(i * 7919 % 1000, "x" if i % 3 else None, i % 5) for i in range(1000)] + [(5, "x", 1)] * 400 + [(None, "y", 2)]
    df = spark.createDataFrame(rows, "a long, b string, c long").repartition(6)
    got = row_numbers(df, ["a", "b"], "n").collect()
    assert sorted(r["n"] for r in got) == list(range(1401))
    in_order = [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["n"])]
    assert in_order == sorted(in_order, key=lambda p: ((p[0] is not None, p[0]), (p[1] is not None, p[1])))
    assert sorted(map(repr, ((r["a"], r["b"], r["c"]) for r in got))) == sorted(map(repr, rows))


def test_numbers_do_not_depend_on_partitioning(spark, many_parts):
    df = spark.range(3000).select((F.col("id") % 50).alias("a"), (F.col("id") % 7).alias("b"), F.col("id").alias("c"))
    one = row_numbers(df.repartition(2), ["a"], start=1)
    two = row_numbers(df.repartition(9), ["a"], start=1)
    assert one.exceptAll(two).isEmpty() and one.agg(F.min("row_id"), F.max("row_id")).first() == (1, 3000)


def test_no_task_orders_the_whole_table(spark, many_parts):
    numbered = row_numbers(spark.range(500).toDF("a"), ["a"])
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    # The only window without partitions orders a row per partition.
    whole = [line for line in plan.splitlines() if "Window" in line and "__part" in line and "row_number" not in line]
    assert len(whole) == 1 and "sum(__n" in whole[0]
    assert row_numbers(spark.range(0).toDF("a"), ["a"]).collect() == []
    with pytest.raises(ValueError, match="already"):
        row_numbers(spark.range(3).toDF("row_id"), ["row_id"])
