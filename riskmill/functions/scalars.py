"""Scalar expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmill.spec import ScoringSettings


def safe_div(num: Column, den: Column) -> Column:
    """num / den, and 0 where den is 0."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    return F.round(safe_div(part, whole) * 100, places)


def outside(col: Column, domain) -> Column:
    """True where the value is missing or not in ``domain``."""
    return ~F.coalesce(col.isin(*domain), F.lit(False))


def decide(score: Column, threshold: float, inclusive: bool = True) -> Column:
    """0/1 decision; ``inclusive`` tells whether a score equal to the threshold is positive."""
    hit = score >= F.lit(threshold) if inclusive else score > F.lit(threshold)
    return hit.cast("int")


def band(score: Column, settings: ScoringSettings) -> Column:
    return (
        F.when(score < F.lit(settings.moderate_from), "LOW")
        .when(score < F.lit(settings.high_from), "MODERATE")
        .when(score.isNotNull(), "HIGH")
    )


def class_label(prediction: Column) -> Column:
    return F.when(prediction == 1, "Higher risk").when(prediction == 0, "Lower risk")


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def trimmed(text: Column) -> Column:
    """Text without white space at its ends; null if nothing is left."""
    return F.nullif(F.btrim(text, F.lit(" \t\n\x0b\x0c\r\u00a0")), F.lit(""))


def clamp(col: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col, F.lit(lo)), F.lit(hi))


def add_all(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN compares above every number in Spark, so it is turned into a plain missing value."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(q(c)), q(c)).alias(c) if c in floats else q(c) for c in df.columns
    ])


def q(name: str) -> Column:
    """Column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def one_row(df: DataFrame) -> list[Column]:
    """The columns of a one-row table as columns for another one, from a single subquery."""
    row = df.select(F.struct(*df.columns)).scalar()
    return [row[c].alias(c) for c in df.columns]
