"""From checked records to scores, decisions, bands and responses."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmill.functions.scalars import band, clamp, class_label, decide, q
from riskmill.operators.models import LinearScorer, score_with
from riskmill.spec import FeatureSpec, ScoringSettings

OUTPUTS = ("risk_score", "prediction", "risk_category", "threshold_used", "valid", "errors")


def _outputs(probability: Column, settings: ScoringSettings) -> list[Column]:
    """Decision and band come from the exact probability, only the shown score is rounded."""
    good = F.size("errors") == 0
    return [
        F.when(good, F.round(probability, settings.decimals)).alias("risk_score"),
        F.when(good, decide(probability, settings.threshold)).alias("prediction"),
        F.when(good, band(probability, settings)).alias("risk_category"),
        F.when(good, F.lit(settings.threshold)).alias("threshold_used"),
        good.alias("valid"),
        F.col("errors"),
    ]


def score_table(
    checked: DataFrame, spec: FeatureSpec, scorer: LinearScorer | PipelineModel,
    settings: ScoringSettings = ScoringSettings(),
) -> DataFrame:
    """Scores rows with an ``errors`` column; rejected rows stay, without outputs.

    Either way the records are read and checked once. A linear model is one expression of the same projection.
    Any other model sees rejected rows too, with plain values in place of their features; what it says of them
    is not shown.
    """
    carried = [c for c in checked.columns if c not in (*spec.features, "errors")]
    if isinstance(scorer, LinearScorer):
        return checked.select(*[q(c) for c in carried], *_outputs(scorer.probability(), settings))
    good = F.size("errors") == 0
    types = {c: checked.schema[c].dataType for c in spec.features}
    plain = {c: F.lit("" if isinstance(t, T.StringType) else 0).cast(t) for c, t in types.items()}
    filled = checked.withColumns({c: F.when(good, q(c)).otherwise(plain[c]) for c in spec.features})
    return score_with(scorer, filled).select(*[q(c) for c in carried], *_outputs(F.col("score"), settings))


def responses(scored: DataFrame, settings: ScoringSettings = ScoringSettings()) -> DataFrame:
    """Replaces the outputs by one JSON text per record: a result, or the first error."""
    percentage = clamp(F.round(F.col("risk_score") * 100, 2), 0.0, 100.0)
    result = F.struct(
        F.lit(True).alias("success"),
        F.struct(
            F.col("risk_score"), percentage.alias("risk_percentage"), F.col("prediction"),
            class_label(F.col("prediction")).alias("predicted_class"), F.col("risk_category"),
            F.col("threshold_used").alias("threshold"),
        ).alias("data"),
        F.lit(settings.disclaimer).alias("disclaimer"),
    )
    failure = F.struct(
        F.lit(False).alias("success"),
        F.struct(
            F.lit("VALIDATION_ERROR").alias("code"), F.try_element_at("errors", F.lit(1)).alias("message")
        ).alias("error"),
    )
    kept = [c for c in scored.columns if c not in OUTPUTS]
    return scored.select(
        *[q(c) for c in kept], F.when(F.col("valid"), F.to_json(result)).otherwise(F.to_json(failure)).alias("response")
    )
