"""Threshold analysis on out-of-fold scores, the final fit and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.functions.scalars import q
from riskmill.operators.choose import choose_threshold
from riskmill.operators.metrics import evaluation_report, threshold_sweep
from riskmill.operators.models import LOGISTIC, ModelSettings, fit_candidate
from riskmill.plans.crossval import fold_rows, out_of_fold_scores, split_rows
from riskmill.session import materialize
from riskmill.spec import FeatureSpec, ScoringSettings


def oof_scores(
    train: DataFrame, spec: FeatureSpec, candidate=(LOGISTIC, "smotenc"), k: int = 5,
    settings: ModelSettings = ModelSettings(), seed: int = 42,
) -> DataFrame:
    """``key, fold, label, score`` of every training row, for one candidate."""
    folds = fold_rows(train, spec, k, seed)
    return out_of_fold_scores(folds, spec, (candidate,), k, settings).select("key", "fold", "label", "score")


def threshold_analysis(scores: DataFrame) -> DataFrame:
    """The sweep over pooled out-of-fold scores."""
    return threshold_sweep(scores).select("threshold", "precision", "recall", "f1_score", "specificity")


def final_fit(rows: DataFrame, spec: FeatureSpec, candidate=(LOGISTIC, "smotenc"),
              settings: ModelSettings = ModelSettings(), seed: int = 42):
    """Splits, then fits the chosen candidate on all training rows: ``(fitted, train, test)``."""
    split = split_rows(rows, spec, seed=seed)
    train, test = (split.filter(F.col("split") == part).drop("split") for part in ("train", "test"))
    return fit_candidate(train, spec, *candidate, settings), train, test


def final_report(
    rows: DataFrame, spec: FeatureSpec, candidate=(LOGISTIC, "smotenc"), k: int = 5,
    settings: ModelSettings = ModelSettings(), seed: int = 42, scoring: ScoringSettings = ScoringSettings(),
) -> DataFrame:
    """Test metrics at the default threshold and at the one proposed by training rows alone."""
    fitted, train, test = final_fit(rows, spec, candidate, settings, seed)
    pooled = oof_scores(train, spec, candidate, k, settings, seed)
    proposed = choose_threshold(threshold_analysis(pooled)).first()["threshold"]
    scored = materialize(
        fitted.score(test).select(q(spec.target).cast("int").alias("label"), "score"), "test-scores"
    )
    return evaluation_report(scored, proposed, scoring.threshold, " + ".join(candidate))
