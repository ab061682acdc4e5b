"""Picking a candidate or a threshold: a recall floor first, then F1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDIDATE_RECALL_FLOOR = 0.50
THRESHOLD_RECALL_FLOOR = 0.60

# The reasons given with a choice.
CANDIDATE_BY_F1 = "selected from CV rows with mean_recall >= {floor}, ranked by mean F1"
CANDIDATE_BY_RECALL = (
    "no strategy reached mean_recall >= {floor} in CV, so the highest-recall row was used as a fallback"
)
THRESHOLD_BY_F1 = "highest F1 among thresholds with OOF recall >= {floor}"
THRESHOLD_BY_RECALL = "no threshold reached OOF recall >= {floor}; used max-recall threshold as fallback"


def _best(df: DataFrame, recall: str, f1: str, floor: float, ties) -> DataFrame:
    usable = F.coalesce(F.col(recall) >= F.lit(floor), F.lit(False))
    return (
        df.withColumn("usable", usable)
        .orderBy(
            F.desc("usable"),
            F.desc_nulls_last(F.when(F.col("usable"), F.col(f1)).otherwise(F.col(recall))),
            *ties,
        )
        .limit(1)
    )


def _with_reason(best: DataFrame, by_f1: str, by_recall: str, floor: float) -> DataFrame:
    note = F.when(F.col("usable"), F.lit(by_f1.format(floor=floor))).otherwise(F.lit(by_recall.format(floor=floor)))
    return best.withColumn("selection_note", note).drop("usable")


def cv_summary(folds: DataFrame, by: tuple[str, ...] = ("model", "strategy")) -> DataFrame:
    """Means over folds, and the population deviation of recall."""
    return folds.groupBy(*by).agg(
        F.avg("recall").alias("mean_recall"), F.stddev_pop("recall").alias("std_recall"),
        F.avg("precision").alias("mean_precision"), F.avg("f1").alias("mean_f1"),
        F.avg("roc_auc").alias("mean_roc_auc"),
    )


def select_candidate(results: DataFrame, floor: float = CANDIDATE_RECALL_FLOOR) -> DataFrame:
    """Highest mean F1 among those reaching the recall floor, else the highest recall.

    Ties go to the higher ROC-AUC, then to the earlier ``seq``.
    """
    best = _best(results, "mean_recall", "mean_f1", floor, (F.desc_nulls_last("mean_roc_auc"), F.asc("seq")))
    return _with_reason(best, CANDIDATE_BY_F1, CANDIDATE_BY_RECALL, floor)


def choose_threshold(sweep: DataFrame, floor: float = THRESHOLD_RECALL_FLOOR) -> DataFrame:
    """Highest F1 among thresholds reaching the recall floor, else the highest recall; ties go low."""
    best = _best(sweep, "recall", "f1_score", floor, (F.asc("threshold"),))
    return _with_reason(best, THRESHOLD_BY_F1, THRESHOLD_BY_RECALL, floor)


def cv_stability(results: DataFrame, model: str, strategy: str, test_metrics: DataFrame) -> DataFrame:
    """The stored CV row of one candidate and its distance to the test recall; empty if not stored."""
    row = results.filter((F.col("model") == model) & (F.col("strategy") == strategy))
    test_recall = test_metrics.select("recall").scalar()
    return row.select(
        "model", "strategy", "mean_recall", "std_recall", "mean_precision", "mean_f1", "mean_roc_auc",
        test_recall.alias("test_recall"), F.abs(F.col("mean_recall") - test_recall).alias("recall_gap"),
    )
