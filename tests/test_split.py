import hashlib

import pytest
from pyspark.sql import functions as F

from riskmill.operators import split


def table(spark, n0, n1):
    return spark.range(n0 + n1).select(F.col("id").alias("k"), (F.col("id") < n1).cast("int").alias("y"))


def test_published_quotas():
    assert split.test_quotas({0: 4861, 1: 249}, 0.2) == {0: 972, 1: 50}


def test_fold_sizes_differ_by_one_at_most():
    sizes = split.fold_sizes({0: 3889, 1: 199}, 5)
    for per_class in sizes.values():
        assert max(per_class) - min(per_class) <= 1
    both = [a + b for a, b in zip(sizes[0], sizes[1], strict=True)]
    assert sum(both) == 4088 and max(both) - min(both) <= 1


def test_split_counts_and_partitioning(spark):
    df = table(spark, 4861, 249)
    first = split.stratified_split(df, "y", "k")
    counts = {(r["split"], r["y"]): r["count"] for r in first.groupBy("split", "y").count().collect()}
    assert counts == {("train", 0): 3889, ("train", 1): 199, ("test", 0): 972, ("test", 1): 50}
    again = split.stratified_split(df.repartition(7), "y", "k")
    assert first.exceptAll(again).isEmpty()
    other = split.stratified_split(df, "y", "k", seed=7)
    assert not first.exceptAll(other).isEmpty()


def by_sorting(rows, ranks):
    """The keys at 1-based ranks of a class, by sorting digests in plain Python."""
    order = sorted(f"{hashlib.md5(f'42|fold|{k}'.encode()).hexdigest()}|{k}" for k in rows)
    return tuple(order[r - 1] for r in ranks)


@pytest.mark.parametrize(("classes", "folds"), [(2, 5), (26, 5), (2, 60), (300, 3)])
def test_cuts_are_the_keys_at_their_ranks(spark, monkeypatch, classes, folds):
    df = spark.range(5200).select(F.col("id").alias("k"), (F.col("id") % classes).cast("int").alias("y"))
    totals = {c: len(range(c, 5200, classes)) for c in range(classes)}
    want = {c: by_sorting(range(c, 5200, classes), r) for c, r in split.fold_ranks(totals, folds).items()}
    plan = split.fit_kfold(df, "y", "k", folds)
    assert plan.cuts == want
    sizes = plan.apply(df, "fold").groupBy("y", "fold").count()
    spread = sizes.groupBy("y").agg(F.max("count").alias("high"), F.min("count").alias("low"), F.count("*").alias("n"))
    assert spread.where(f"high - low > 1 OR n <> {folds}").isEmpty()
    # Coarse grids leave more keys to the last scan.
    monkeypatch.setattr(split, "CELLS", 1)
    assert split.fit_kfold(df, "y", "k", folds).cuts == want


def test_three_scans(spark, monkeypatch):
    df = table(spark, 20_000, 900)
    frame, seen = type(df), []
    real = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: seen.append(1) or real(self))
    split.fit_kfold(df, "y", "k")
    assert len(seen) == 3


def test_a_rank_outside_its_stretch_is_found_all_the_same(spark, monkeypatch):
    df = table(spark, 3000, 200)
    want = split.fit_kfold(df, "y", "k").cuts
    for wrong in ([0, 5], [split.SPAN - 9, split.SPAN], [split.SPAN // 2, split.SPAN // 2 + 1000]):
        monkeypatch.setattr(split, "_stretches", lambda ranks, totals, wrong=wrong: {c: [list(wrong)] for c in ranks})
        assert split.fit_kfold(df, "y", "k").cuts == want


def test_split_applies_without_a_shuffle(spark):
    df = split.stratified_split(table(spark, 500, 50), "y", "k")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_repeated_key_is_refused(spark):
    df = table(spark, 10, 5).withColumn("k", F.lit(1))
    with pytest.raises(ValueError, match="not unique"):
        split.stratified_split(df, "y", "k")


def test_too_few_rows_for_folds(spark):
    with pytest.raises(ValueError, match="fewer than"):
        split.stratified_kfold(table(spark, 50, 3), "y", "k")


def test_integrity_sees_a_leak(spark):
    df = table(spark, 100, 20)
    parts = split.stratified_split(df, "y", "k")
    assert split.split_integrity(df, parts, "y", "k").first()["ok"]
    leaked = parts.unionByName(parts.filter("split = 'test'").withColumn("split", F.lit("train")))
    row = split.split_integrity(df, leaked, "y", "k").first()
    assert not row["ok"] and row["shared_keys"] == 24
