import pytest
from pyspark.sql import functions as F

from riskmill.operators import models
from riskmill.operators.encode import Encoding, encode, encode_long
from riskmill.operators.models import CANDIDATES, LinearScorer, ModelSettings, fit_candidate, lr_gradient
from riskmill.plans import crossval
from riskmill.plans.fixtures import RISK_SPEC, risk_events
from riskmill.session import new_folder
from riskmill.sources import store
from riskmill.spec import ScoringSettings

QUICK = ModelSettings(forest_trees=3, forest_depth=4, boosting_rounds=2, extreme_rounds=2, extreme_depth=3)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    """Few distinct feature values, so that collapsing applies."""
    return risk_events(spark, sf_dir).withColumn("x_num", F.floor(F.col("x_num") / 50).cast("double")).cache()


def test_unknown_names(rows):
    with pytest.raises(ValueError, match="Unknown model"):
        fit_candidate(rows, RISK_SPEC, "Nearest Guess", "baseline")
    with pytest.raises(ValueError, match="Unknown strategy"):
        fit_candidate(rows, RISK_SPEC, models.LOGISTIC, "magic")
    with pytest.raises(ValueError, match="Unknown candidates"):
        crossval.out_of_fold_scores(rows.withColumn("fold", F.lit(0)), RISK_SPEC, [("a", "b")])


@pytest.mark.parametrize("strategy", ["baseline", "class_weight"])
def test_collapsed_fit_is_the_optimum_of_all_rows(rows, strategy):
    assert models.collapse_rows(rows, RISK_SPEC).count() * 10 <= rows.count() * 2
    fitted = fit_candidate(rows, RISK_SPEC, models.LOGISTIC, strategy)
    worst = lr_gradient(rows, fitted).agg(F.max(F.abs("gradient"))).first()[0]
    assert worst < 1e-6


def test_collapsing_does_not_change_the_fit(rows, monkeypatch):
    a = LinearScorer.from_fitted(fit_candidate(rows, RISK_SPEC, models.LOGISTIC, "class_weight"))
    same = [F.lit(1.0).alias("copies")]
    monkeypatch.setattr(models, "collapse_rows", lambda df, spec: df.select("*", *same))
    b = LinearScorer.from_fitted(fit_candidate(rows, RISK_SPEC, models.LOGISTIC, "class_weight"))
    assert a.intercept == pytest.approx(b.intercept, abs=1e-5)
    assert a.categorical["x_cat"] == pytest.approx(b.categorical["x_cat"], abs=1e-5)


def test_boosting_on_counted_rows_is_the_fit_on_all_rows(spark, sf_dir, monkeypatch):
    """Numbers are binned by exact quantiles, so collapsing leaves nothing to a sample."""
    rows = risk_events(spark, sf_dir).cache()
    quick = ModelSettings(boosting_rounds=6)
    learned = models.learn(rows, RISK_SPEC, binned=True)
    counted = models.collapse_rows(learned[0].binned(rows), RISK_SPEC)
    assert counted.count() * 2 < rows.count() and counted.agg(F.sum("copies")).first()[0] == rows.count()
    assert counted.select("x_num").distinct().count() <= models.BINS
    a = fit_candidate(rows, RISK_SPEC, models.BOOSTING, "sample_weight", quick)
    monkeypatch.setattr(models, "collapse_rows", lambda df, spec: df.withColumn("copies", F.lit(1.0)))
    b = fit_candidate(rows, RISK_SPEC, models.BOOSTING, "sample_weight", quick)
    splits = [[x for x in m.stages.stages[-1].toDebugString.split("\n") if "feature" in x] for m in (a, b)]
    assert splits[0] == splits[1] and len(splits[0]) > 20
    both = a.score(rows).withColumnRenamed("score", "one")
    assert models.score_with(b.stages, both).agg(F.max(F.abs(F.col("one") - F.col("score")))).first()[0] < 1e-9


def test_bins_are_cut_at_exact_quantiles(spark):
    df = spark.createDataFrame([(i, float(i * i), "a", 0, i % 2) for i in range(640)],
                               "row_id long, x_num double, x_cat string, x_bin int, target int")
    encoding, _ = models.learn(df, RISK_SPEC, binned=True)
    sizes = [r["count"] for r in encoding.binned(df).groupBy("x_num").count().collect()]
    assert len(sizes) == models.BINS and max(sizes) == 20 == min(sizes)
    # A number that stands for its bin falls into it, and into the vector's slot.
    binned = encode(encoding.binned(df), encoding).select("row_id", F.col("features").alias("one"))
    plain = encode(df, encoding).join(binned, "row_id")
    assert plain.where(F.col("one").cast("string") != F.col("features").cast("string")).isEmpty()


def test_encoder_uses_population_deviation_and_ignores_unseen(spark):
    train = spark.createDataFrame([(1, 1.0, "b", 0, 0), (2, 3.0, "a", 1, 1)], "row_id long, x_num double, x_cat string, x_bin int, target int")
    learned = Encoding.fit(train, RISK_SPEC)
    assert learned.scales["x_num"] == 1.0 and learned.means["x_num"] == 2.0
    assert learned.slots() == ["num__x_num", "cat__x_cat_a", "cat__x_cat_b", "bin__x_bin"]
    new = spark.createDataFrame([(3, 5.0, "zzz", 1, 0), (4, 2.0, None, 0, 0), (5, 2.0, "b", 0, 0)], train.schema)
    vectors = {r["row_id"]: r["features"].toArray().tolist() for r in encode(new, learned).collect()}
    assert vectors == {3: [3.0, 0, 0, 1.0], 4: [0, 0, 0, 0], 5: [0, 0, 1.0, 0]}
    long = sorted((r["row_id"], r["slot"], r["value"]) for r in encode_long(new, learned).collect())
    assert long == [(3, "bin__x_bin", 1.0), (3, "num__x_num", 3.0), (5, "cat__x_cat_b", 1.0)]


def test_constant_column_is_divided_by_one(spark):
    train = spark.createDataFrame([(1, 4.0, "b", 0, 0), (2, 4.0, "a", 1, 1)], "row_id long, x_num double, x_cat string, x_bin int, target int")
    assert Encoding.fit(train, RISK_SPEC).scales["x_num"] == 1.0


def test_too_many_categories(spark, monkeypatch):
    from riskmill.operators import encode as module

    monkeypatch.setattr(module, "MAX_CATEGORIES", 3)
    train = spark.range(50).selectExpr("id as row_id", "1.0D as x_num", "cast(id as string) as x_cat", "0 as x_bin", "0 as target")
    with pytest.raises(ValueError, match="too many"):
        Encoding.fit(train, RISK_SPEC)


def test_all_candidates_by_cross_validation(spark, sf_dir):
    split = crossval.split_rows(risk_events(spark, sf_dir), RISK_SPEC)
    train = split.filter("split = 'train'").drop("split")
    folds = crossval.fold_rows(train, RISK_SPEC, 3)
    scores = crossval.out_of_fold_scores(folds, RISK_SPEC, CANDIDATES, 3, QUICK)
    check = crossval.oof_check(folds, scores, RISK_SPEC).collect()
    assert len(check) == 10
    assert all(r["keys"] == 800 and r["bad_keys"] == 0 and r["missing_keys"] == 0 for r in check)
    results = crossval.cv_results(scores).collect()
    assert sorted(r["seq"] for r in results) == list(range(10))
    assert all(0.3 < r["mean_roc_auc"] <= 1 for r in results)


def test_saved_model(spark, rows):
    path = new_folder(spark, "bundle")
    with pytest.raises(FileNotFoundError, match="fit and save"):
        store.load_bundle(spark, path)
    fitted = fit_candidate(rows, RISK_SPEC, models.BOOSTING, "sample_weight", QUICK)
    chosen = ScoringSettings(threshold=0.45)
    store.save_bundle(spark, fitted, path, chosen)
    bundle = store.load_bundle(spark, path)
    assert bundle.settings == chosen and bundle.spec.features == RISK_SPEC.features
    assert bundle.spec.domains == dict(RISK_SPEC.domains)
    again = models.score_with(bundle.stages, rows)
    assert again.exceptAll(fitted.score(rows)).isEmpty()
