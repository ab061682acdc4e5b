import pytest
from pyspark.sql import functions as F

from riskmill.operators.smotenc import balance_report, smotenc, synthetic_rows
from riskmill.plans.fixtures import RISK_SPEC, risk_events
from riskmill.spec import FeatureSpec

SPEC = FeatureSpec("k", ("x",), ("c",), ("f",), "y")


def table(spark, n0, n1):
    return spark.range(n0 + n1).select(
        F.col("id").alias("k"), ((F.col("id") * 37) % 101).cast("double").alias("x"),
        F.concat(F.lit("c"), F.col("id") % 3).alias("c"), (F.col("id") % 2).cast("int").alias("f"),
        (F.col("id") < n1).cast("int").alias("y"),
    )


def test_counts_hull_and_values(spark):
    df = table(spark, 400, 30)
    after = smotenc(df, SPEC).cache()
    new = after.filter("is_synthetic")
    assert new.count() == 200 - 30
    lo, hi = df.filter("y = 1").agg(F.min("x"), F.max("x")).first()
    assert new.filter(~F.col("x").between(lo, hi)).isEmpty()
    assert new.filter("y <> 1 or c not in ('c0', 'c1', 'c2') or f not in (0, 1)").isEmpty()
    assert after.filter("not is_synthetic").drop("is_synthetic").exceptAll(df.select(after.columns[:-1])).isEmpty()
    report = {r["label"]: r["added"] for r in balance_report(df, after, "y").collect()}
    assert report == {0: 0, 1: 170}


def test_published_amount(spark):
    from riskmill.operators.smotenc import minority_facts

    facts = minority_facts(table(spark, 3889, 199), SPEC)
    assert int(0.5 * facts["n_maj"] - facts["n_min"]) == 1745


def test_independent_of_partitioning(spark):
    df = table(spark, 100, 20)
    a, b = (synthetic_rows(d, SPEC) for d in (df, df.repartition(9)))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_ratio_already_reached(spark):
    after = smotenc(table(spark, 20, 15), SPEC)
    assert after.filter("is_synthetic").isEmpty() and after.count() == 35


def test_too_few_rows(spark):
    with pytest.raises(ValueError, match="more than 5"):
        smotenc(table(spark, 100, 5), SPEC)


def test_missing_numbers_are_refused(spark, sf_dir):
    df = risk_events(spark, sf_dir).withColumn("x_num", F.lit(None).cast("double"))
    with pytest.raises(ValueError, match="missing"):
        smotenc(df, RISK_SPEC)
