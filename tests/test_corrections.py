"""Behaviour at the edges that once depended on size, or lost rows."""

import pytest
from pyspark.sql import functions as F

from riskmill.operators import metrics, profile, rules, split
from riskmill.operators.models import BOOSTING, LOGISTIC, LinearScorer, ModelSettings, fit_candidate
from riskmill.operators.scoring import score_table
from riskmill.operators.validate import validate_records
from riskmill.plans.fixtures import RISK_SPEC, record_lines, risk_events
from riskmill.session import new_folder
from riskmill.sources import store


def _points(rows):
    return sorted(map(tuple, metrics.roc_points(rows, label="y", score="s").collect()))


def test_nan_scores_have_no_rank(spark):
    rows = [(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.6), (1, float("nan")), (0, None)]
    scored = spark.createDataFrame(rows, "y int, s double")
    clean = scored.where("s IS NOT NULL AND NOT isnan(s)")
    assert _points(scored) == _points(clean)


def test_a_column_without_values_is_described(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b")], "id long, empty string, s string")
    got = {r.column: r for r in profile.describe_mixed(df).collect()}
    assert (got["empty"]["count"], got["empty"].n_unique, got["empty"].top) == (0, 0, None)
    assert set(got) == {"id", "empty", "s"}


def test_majority_baseline_of_an_empty_table(spark):
    row = split.majority_baseline(spark.createDataFrame([], "y int"), "y").first()
    assert row.accuracy == 0 and row.accuracy_pct == 0


def test_nan_is_no_extreme(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    assert [tuple(r) for r in rules.numeric_extremes(df, ["x"]).collect()] == [("x", 1.0, 3.0)]


def test_text_keys_are_compared_by_digest(spark):
    df = spark.createDataFrame([("a" * 200,), ("a" * 200,), ("b",), (None,), (None,)], "k string")
    row = profile.dup_report(df, "k").first()
    assert (row.n_rows, row.row_duplicates, row.key_duplicates) == (5, 2, 2)


def test_boosting_sees_the_rows_as_they_are(spark, sf_dir):
    """Highly repeated rows, told apart by nothing: the same fit as on rows that no collapsing could merge."""
    rows = risk_events(spark, sf_dir).withColumn("x_num", F.round("x_num", -2))
    settings = ModelSettings(boosting_rounds=2)
    fitted = fit_candidate(rows, RISK_SPEC, BOOSTING, "sample_weight", settings)
    trees = fitted.stages.stages[-1]
    assert trees.getNumTrees == 2 and fitted.weight_total == rows.count()


def test_a_reloaded_linear_model_scores_as_an_expression(spark, sf_dir):
    rows = risk_events(spark, sf_dir)
    fitted = fit_candidate(rows, RISK_SPEC, LOGISTIC, "class_weight")
    path = new_folder(spark, "bundle")
    store.save_bundle(spark, fitted, path)
    scorer = LinearScorer.from_table(store.load_coefficients(spark, path), store.load_bundle(spark, path).spec)
    both = fitted.score(rows).withColumn("own", scorer.probability())
    assert both.agg(F.max(F.abs(F.col("own") - F.col("score")))).first()[0] == pytest.approx(0, abs=1e-9)


def test_any_model_scores_checked_records_in_one_scan(spark, sf_dir):
    fitted = fit_candidate(risk_events(spark, sf_dir), RISK_SPEC, LOGISTIC, "class_weight")
    checked = validate_records(record_lines(spark, sf_dir), RISK_SPEC)
    by_stages = score_table(checked, RISK_SPEC, fitted.stages)
    by_expression = score_table(checked, RISK_SPEC, LinearScorer.from_fitted(fitted))
    plan = by_stages._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert plan == checked._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert not by_stages.where("NOT valid").isEmpty() and by_stages.where("NOT valid AND risk_score IS NOT NULL").isEmpty()
    columns = ["row_id", "valid", "errors", "prediction", "risk_category", "risk_score"]
    one, two = (df.select(columns).orderBy("row_id").toPandas() for df in (by_stages, by_expression))
    assert one.drop(columns=["risk_score", "errors"]).equals(two.drop(columns=["risk_score", "errors"]))
    assert (one["risk_score"] - two["risk_score"]).abs().max() < 1e-3
    assert list(map(list, one["errors"])) == list(map(list, two["errors"]))
