"""Saving a fitted candidate with everything needed to score by it later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from riskmill.operators.models import LOGISTIC, Fitted, LinearScorer
from riskmill.spec import FeatureSpec, ScoringSettings

SETTINGS = """
    model string, strategy string, key string, target string, features array<string>,
    numeric array<string>, categorical array<string>, binary array<string>,
    domains map<string, array<string>>, ranges map<string, array<double>>,
    threshold double, bands map<string, double>, decimals int, disclaimer string
"""


@dataclass(frozen=True)
class Bundle:
    model: str
    strategy: str
    stages: PipelineModel
    spec: FeatureSpec
    settings: ScoringSettings


def save_bundle(spark: SparkSession, fitted: Fitted, path: str, settings: ScoringSettings = ScoringSettings()) -> None:
    """Writes the model, one row of settings and, for a linear model, its coefficient table."""
    spec = fitted.encoding.spec
    row = (
        fitted.model, fitted.strategy, spec.key, spec.target, list(spec.features), list(spec.numeric),
        list(spec.categorical), list(spec.binary), {c: list(v) for c, v in spec.domains.items()},
        {c: [float(x) for x in v] for c, v in spec.ranges.items()}, settings.threshold,
        {"moderate_from": settings.moderate_from, "high_from": settings.high_from},
        settings.decimals, settings.disclaimer,
    )
    fitted.stages.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([row], SETTINGS).write.mode("overwrite").parquet(f"{path}/settings")
    if fitted.model == LOGISTIC:
        LinearScorer.from_fitted(fitted).table(spark).write.mode("overwrite").parquet(f"{path}/coefficients")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    try:
        row = spark.read.schema(SETTINGS).parquet(f"{path}/settings").first()
        stages = PipelineModel.load(f"{path}/model")
    except (AnalysisException, FileNotFoundError) as e:
        raise FileNotFoundError(f"no saved model at {path}; fit and save one first") from e
    spec = FeatureSpec(
        key=row["key"], numeric=tuple(row["numeric"]), categorical=tuple(row["categorical"]),
        binary=tuple(row["binary"]), target=row["target"], order=tuple(row["features"]),
        domains={c: tuple(v) for c, v in row["domains"].items()},
        ranges={c: tuple(v) for c, v in row["ranges"].items()},
    )
    settings = ScoringSettings(
        threshold=row["threshold"], moderate_from=row["bands"]["moderate_from"],
        high_from=row["bands"]["high_from"], decimals=row["decimals"], disclaimer=row["disclaimer"],
    )
    return Bundle(row["model"], row["strategy"], stages, spec, settings)


def load_coefficients(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/coefficients")
