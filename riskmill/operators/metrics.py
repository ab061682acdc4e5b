"""Metrics, curves and threshold tables over a table of labels and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.functions.scalars import decide, safe_div
from riskmill.operators.prefix import running_totals

# The thresholds of the sweep, as written decimals.
SWEEP = (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)
DEFAULT_THRESHOLD = 0.50
COUNTS = ("tn", "fp", "fn", "tp")
COMPARED = ("accuracy", "precision", "recall", "f1_score", "specificity")


def rates(tn: Column, fp: Column, fn: Column, tp: Column) -> list[Column]:
    """Every rate that follows from the four counts; 0 where its denominator is 0."""
    precision, recall = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return [
        safe_div(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        safe_div(tn, tn + fp).alias("specificity"),
        safe_div(tn, tn + fn).alias("npv"),
    ]


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.select("*", *rates(*[F.col(c) for c in COUNTS]))


def confusion(
    df: DataFrame, threshold: float = DEFAULT_THRESHOLD, by: tuple[str, ...] = (),
    inclusive: bool = True, label: str = "label", score: str = "score",
) -> DataFrame:
    """TN, FP, FN and TP in one aggregate."""
    hit = decide(F.col(score), threshold, inclusive) == 1
    positive = F.col(label) == 1
    return df.filter(F.col(score).isNotNull()).groupBy(*by).agg(
        F.count_if(~positive & ~hit).alias("tn"), F.count_if(~positive & hit).alias("fp"),
        F.count_if(positive & ~hit).alias("fn"), F.count_if(positive & hit).alias("tp"),
    )


def metrics_at(
    df: DataFrame, threshold: float = DEFAULT_THRESHOLD, by: tuple[str, ...] = (),
    inclusive: bool = True, label: str = "label", score: str = "score",
) -> DataFrame:
    return with_rates(confusion(df, threshold, by, inclusive, label, score)).withColumn(
        "threshold", F.lit(float(threshold))
    )


def threshold_sweep(
    df: DataFrame, thresholds=SWEEP, by: tuple[str, ...] = (), label: str = "label", score: str = "score"
) -> DataFrame:
    """All rates at every threshold, from one pass: a row only counts how many thresholds it reaches."""
    thresholds = sorted(float(t) for t in thresholds)
    reached = sum(((F.col(score) >= F.lit(t)).cast("int") for t in thresholds), F.lit(0))
    positive = F.col(label) == 1
    steps = df.filter(F.col(score).isNotNull()).groupBy(*by, reached.alias("reached")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    # At most len(thresholds) + 1 rows per group from here on.
    marks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds)])
    hit = F.col("reached") > F.col("i")
    zero = F.lit(0).cast("bigint")
    counts = steps.select("*", F.inline(marks)).groupBy(*by, "threshold").agg(
        F.sum(F.when(hit, zero).otherwise(F.col("neg"))).alias("tn"),
        F.sum(F.when(hit, F.col("neg")).otherwise(zero)).alias("fp"),
        F.sum(F.when(hit, zero).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(hit, F.col("pos")).otherwise(zero)).alias("tp"),
    )
    return with_rates(counts)


def score_totals(
    df: DataFrame, by: tuple[str, ...] = (), label: str = "label", score: str = "score", ahead: bool = False
) -> DataFrame:
    """Positives and negatives at and above every distinct score."""
    positive = (F.col(label) == 1).cast("bigint")
    return running_totals(df, score, {"pos": positive, "neg": F.lit(1).cast("bigint") - positive}, by, ahead)


def _summary(df: DataFrame, by: tuple[str, ...], label: str, score: str, hits: dict[str, Column]) -> DataFrame:
    """ROC-AUC, average precision and, per entry of ``hits``, TP and FP, all from one pass."""
    totals = score_totals(df, by, label, score)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    zero = F.lit(0).cast("bigint")
    summed = totals.groupBy(*by).agg(
        F.sum(neg * (F.col("cum_pos") - pos / 2)).alias("won"),
        F.sum(pos * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("stepped"),
        F.max("all_pos").alias("p"), F.max("all_neg").alias("n"),
        *[F.sum(F.when(hit, F.col("pos")).otherwise(zero)).alias(f"tp_{name}") for name, hit in hits.items()],
        *[F.sum(F.when(hit, F.col("neg")).otherwise(zero)).alias(f"fp_{name}") for name, hit in hits.items()],
    )
    pairs = F.col("p").cast("double") * F.col("n").cast("double")
    return summed.select(
        *by, "p", "n",
        F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / pairs).alias("roc_auc"),
        safe_div(F.col("stepped"), F.col("p")).alias("average_precision"),
        *[f"tp_{name}" for name in hits], *[f"fp_{name}" for name in hits],
    )


def _counts_of(name: str) -> list[Column]:
    tp, fp = F.col(f"tp_{name}"), F.col(f"fp_{name}")
    return [F.col("n") - fp, fp, F.col("p") - tp, tp]


def ranking_metrics(df: DataFrame, by: tuple[str, ...] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Tie-aware ROC-AUC (missing with one class only) and step-wise average precision."""
    return _summary(df, by, label, score, {}).select(*by, "roc_auc", "average_precision")


def all_metrics(
    df: DataFrame, threshold: float = DEFAULT_THRESHOLD, by: tuple[str, ...] = (), inclusive: bool = True,
    label: str = "label", score: str = "score",
) -> DataFrame:
    """Counts and rates at a threshold together with the threshold-free metrics."""
    hit = decide(F.col(score), threshold, inclusive) == 1
    summed = _summary(df, by, label, score, {"t": hit})
    counts = summed.select(
        *by, *[c.alias(n) for c, n in zip(_counts_of("t"), COUNTS, strict=True)],
        F.lit(float(threshold)).alias("threshold"), "roc_auc", "average_precision",
    )
    return with_rates(counts)


def roc_auc(df: DataFrame, by: tuple[str, ...] = (), **names: str) -> DataFrame:
    return ranking_metrics(df, by, **names).select(*by, "roc_auc")


def average_precision(df: DataFrame, by: tuple[str, ...] = (), **names: str) -> DataFrame:
    return ranking_metrics(df, by, **names).select(*by, "average_precision")


def roc_points(df: DataFrame, thin: bool = False, label: str = "label", score: str = "score") -> DataFrame:
    """``threshold, fpr, tpr`` per distinct score, plus the start at (0, 0).

    ``thin`` leaves out the inner points of vertical and horizontal runs, which do not change the
    curve.
    """
    totals = score_totals(df, (), label, score, ahead=thin)
    if thin:
        totals = totals.filter(~_inside_run())
    points = totals.select(
        F.col(score).alias("threshold"),
        safe_div(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
        safe_div(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
    )
    start = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(points)


def _inside_run() -> Column:
    """Whether a point lies strictly inside a vertical or horizontal run of the curve.

    The step to a point and the step from it tell: both without negatives (vertical) or both without
    positives. So a run of any length is judged point by point, without gathering it. The first
    point of the curve and the last one always stay.
    """
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    straight = [(F.col(n) == 0) & (F.col(f"next_{n}") == 0) for n in ("neg", "pos")]
    return ~first & F.coalesce(straight[0] | straight[1], F.lit(False))


def pr_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """``threshold, recall, precision`` per distinct score, plus the end at (0, 1)."""
    totals = score_totals(df, (), label, score)
    points = totals.select(
        F.col(score).alias("threshold"),
        safe_div(F.col("cum_pos"), F.col("all_pos")).alias("recall"),
        safe_div(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
    )
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision")
    )
    return points.unionByName(end)


def no_skill_rate(df: DataFrame, label: str = "label") -> DataFrame:
    """The precision of a random ranking: the share of positives."""
    return df.agg(F.avg(F.col(label).cast("double")).alias("no_skill"))


def evaluation_report(
    df: DataFrame, alternative: float, default: float = DEFAULT_THRESHOLD, model: str = "model",
    label: str = "label", score: str = "score",
) -> DataFrame:
    """Default and alternative threshold side by side, with the threshold-free metrics."""
    marks = {"default": default, "alternative_recall_oriented": alternative}
    if alternative == default:
        del marks["alternative_recall_oriented"]
    summed = _summary(df, (), label, score, {role: F.col(score) >= F.lit(t) for role, t in marks.items()})
    rows = [
        F.struct(F.lit(float(t)).alias("threshold"), F.lit(role).alias("threshold_role"), *rates(*_counts_of(role)))
        for role, t in marks.items()
    ]
    return summed.select("roc_auc", "average_precision", F.inline(F.array(*rows))).select(
        F.lit(model).alias("model"), "threshold", "threshold_role", *COMPARED, "roc_auc", "average_precision"
    )


def metric_compare(df: DataFrame, alternative: float, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """``metric, at_default, at_alternative, delta``."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in COMPARED])
    long = threshold_sweep(df, {default, alternative}).select("threshold", F.inline(pairs))

    def at(t):
        return F.max(F.when(F.col("threshold") == F.lit(t), F.col("value")))

    return long.groupBy("metric").agg(at(default).alias("at_default"), at(alternative).alias("at_alternative")).withColumn(
        "delta", F.col("at_alternative") - F.col("at_default")
    )


def error_analysis(df: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """Missed positives out of all positives, false alarms out of all negatives."""
    c = confusion(df, threshold, label=label, score=score)
    return c.select(
        *COUNTS,
        (F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"),
        safe_div(F.col("fn"), F.col("tp") + F.col("fn")).alias("missed_share"),
        safe_div(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_alarm_share"),
    )


def fold_metrics(df: DataFrame, by: tuple[str, ...], threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Recall, precision, F1 and ROC-AUC per group; a score equal to the threshold is negative here."""
    return all_metrics(df, threshold, by, inclusive=False).select(
        *by, "recall", "precision", F.col("f1_score").alias("f1"), "roc_auc"
    )
