"""Class weights instead of more rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.functions.scalars import safe_div, q


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weights ``n / (k * n_c)``: ``label, n, weight, ratio`` (ratio to the lightest class)."""
    counted = df.agg(
        F.count_if(q(target) == 0).alias("n0"), F.count_if(q(target) == 1).alias("n1")
    )
    total = F.col("n0") + F.col("n1")
    weights = [safe_div(total, F.lit(2) * F.col(f"n{c}")) for c in (0, 1)]
    return counted.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("label"), F.col(f"n{c}").alias("n"), weights[c].alias("weight"),
            safe_div(weights[c], F.least(*weights)).alias("ratio"),
        )
        for c in (0, 1)
    ])))


def class_weight_map(df: DataFrame, target: str) -> DataFrame:
    """The same weights as one map value."""
    entries = F.array_sort(F.collect_list(F.struct("label", "weight")))
    return class_weights(df, target).agg(F.map_from_entries(entries).alias("weights"))


def positive_weight(df: DataFrame, target: str) -> DataFrame:
    """One row: negatives per positive."""
    return df.agg(
        F.count_if(q(target) == 0).alias("negatives"), F.count_if(q(target) == 1).alias("positives")
    ).withColumn("positive_weight", safe_div(F.col("negatives"), F.col("positives")))


def with_balanced_weight(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """Each row with its class weight; the joined side has two rows."""
    weights = class_weights(df, target).select(F.col("label").alias("__label"), F.col("weight").alias(out))
    return df.join(F.broadcast(weights), q(target) == F.col("__label"), "left").drop("__label")


def with_positive_weight(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """Negatives weigh 1, positives as much as all negatives together."""
    weight = positive_weight(df, target).select("positive_weight").scalar()
    return df.withColumn(out, F.when(q(target) == 1, weight).otherwise(F.lit(1.0)))
