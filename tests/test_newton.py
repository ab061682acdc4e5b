"""Logistic regressions fitted side by side, beside a dense solver, Spark's own and cross-validation's rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmill.operators import newton
from riskmill.operators.models import LOGISTIC, LinearScorer, fit_candidate
from riskmill.operators.newton import Fit, fit_many
from riskmill.plans import crossval
from riskmill.plans.fixtures import RISK_SPEC, risk_events
from riskmill.spec import FeatureSpec

SPEC = FeatureSpec(key="k", numeric=("a", "b"), categorical=("c", "e"), binary=("f",), target="t")


def drawn(n=400, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = float(rng.normal(50, 9)), float(rng.integers(0, 4))
        c, e, f = str(rng.choice(list("xyz"))), str(rng.choice(["u", "v"])), int(rng.integers(2))
        p = 1 / (1 + np.exp(-((a - 60) / 9 + b / 3 + (c == "x") + f / 2)))
        rows.append((i, a, b, c if rng.random() > 0.05 else None, e, f, int(rng.random() < p), f"tag {i % 3}"))
    return rows


def dense(rows, weights, c):
    """The optimum by Newton's method on a plain matrix; also the scores."""
    x = np.array([[r[1], r[2]] for r in rows])
    x = (x - x.mean(0)) / x.std(0)
    columns = [np.ones(len(rows)), *x.T, np.array([r[5] for r in rows])]
    columns += [np.array([r[k] == v for r in rows]) for k, vs in ((3, "xyz"), (4, "uv")) for v in vs]
    x, y = np.column_stack(columns).astype(float), np.array([r[6] for r in rows], float)
    w = np.where(y == 1, weights[1], weights[0])
    penalty = np.full(x.shape[1], 1 / c)
    penalty[0] = 0
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (w * (p - y)) + penalty * beta)
    return beta, 1 / (1 + np.exp(-x @ beta))


def test_side_by_side_equals_one_by_one(spark):
    rows = drawn()
    df = spark.createDataFrame(rows, "k int, a double, b double, c string, e string, f int, t int, tag string").repartition(3)
    tags = ("tag 0", "tag 1", "tag 2")
    fits = [Fit("all", tags, "baseline"), Fit("balanced", tags, "class_weight"), Fit("two", tags[:2], "scale_pos_weight")]
    for c in (1.0, 0.1):
        found = fit_many(df, SPEC, fits, c)
        for fit in fits:
            own = [r for r in rows if r[7] in fit.tags]
            n1 = sum(r[6] for r in own)
            n0 = len(own) - n1
            weights = {"baseline": (1, 1), "class_weight": (len(own) / (2 * n0), len(own) / (2 * n1)),
                       "scale_pos_weight": (1, n0 / n1)}[fit.strategy]
            beta, scores = dense(own, weights, c)
            assert found[fit.name].intercept == pytest.approx(beta[0], abs=1e-8)
            at = df.filter(F.col("tag").isin(*fit.tags)).select("k", found[fit.name].probability().alias("p")).collect()
            assert {r["k"]: r["p"] for r in at} == {r[0]: pytest.approx(s, abs=1e-8) for r, s in zip(own, scores, strict=True)}


def test_category_that_a_fit_never_sees_weighs_nothing(spark):
    rows = [(i, float(i % 7), 0.0, "new" if i % 2 else "old", "u", i % 2, int(i % 5 == 0), f"tag {i % 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c string, e string, f int, t int, tag string")
    found = fit_many(df, SPEC, [Fit("old", ("tag 0",), "baseline")])["old"]
    assert found.categorical["c"]["new"] == pytest.approx(0, abs=1e-12)
    assert found.numeric["b"][1:] == (1.0, pytest.approx(0, abs=1e-12))
    with pytest.raises(ValueError, match="both classes"):
        fit_many(df.filter("t = 0"), SPEC, [Fit("none", ("tag 0",), "baseline")])


def test_separable_rows_settle(spark):
    rows = [(i, float(i), 0.0, "x", "u", 0, int(i >= 100), "all") for i in range(200)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c string, e string, f int, t int, tag string")
    scorer = fit_many(df, SPEC, [Fit("far", ("all",), "baseline")], c=1000.0)["far"]
    scores = [r[0] for r in df.orderBy("k").select(scorer.probability()).collect()]
    assert scores == sorted(scores) and scores[99] < 0.5 < scores[100]


def test_equals_the_single_fit_and_cross_validation_uses_it(spark, sf_dir, monkeypatch):
    rows = risk_events(spark, sf_dir).cache()
    single = LinearScorer.from_fitted(fit_candidate(rows, RISK_SPEC, LOGISTIC, "class_weight"))
    many = fit_many(rows.withColumn("tag", F.lit("x")), RISK_SPEC, [Fit("f", ("x",), "class_weight")])["f"]
    apart = rows.agg(F.max(F.abs(single.probability() - many.probability()))).first()[0]
    assert apart < 1e-5
    folds = crossval.fold_rows(rows, RISK_SPEC, 3)
    candidates = [(LOGISTIC, "baseline"), (LOGISTIC, "smotenc")]
    together = crossval.out_of_fold_scores(folds, RISK_SPEC, candidates, 3)
    check = crossval.oof_check(folds, together, RISK_SPEC).collect()
    assert {(r["keys"], r["bad_keys"], r["missing_keys"]) for r in check} == {(1000, 0, 0)}
    # With more slots than fit a matrix every fit is Spark's own, and the scores are the same.
    monkeypatch.setattr(newton, "MOST_SLOTS", 5)
    alone = crossval.out_of_fold_scores(folds, RISK_SPEC, candidates, 3).withColumnRenamed("score", "other")
    both = together.join(alone, ["strategy", "key"])
    assert both.count() == 2000 and both.agg(F.max(F.abs(F.col("score") - F.col("other")))).first()[0] < 1e-4
