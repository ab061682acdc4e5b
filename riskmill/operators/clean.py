"""Cleaning: drop identifiers, drop repeated rows, keep everything else as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskmill.functions.scalars import nan_to_null
from riskmill.spec import FeatureSpec


def drop_columns(df: DataFrame, columns) -> DataFrame:
    return df.drop(*columns)


def drop_repeated(df: DataFrame, columns=None) -> DataFrame:
    """Keeps one of each group of equal rows.

    Compared over whole rows unless ``columns`` names what makes two rows the same.
    """
    return df.dropDuplicates(list(columns)) if columns else df.distinct()


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return nan_to_null(df).na.drop(subset=[column])


def clean_table(df: DataFrame, drop=(), same_by=None) -> DataFrame:
    """NaN to missing, repeated rows out, then the unwanted columns out.

    Repeats are compared with the identifier still in place, so that two different records
    with equal answers are both kept.
    """
    return drop_columns(drop_repeated(nan_to_null(df), same_by), drop)


def select_features(df: DataFrame, spec: FeatureSpec, with_key: bool = True) -> DataFrame:
    """Key, features in the spec's order, target."""
    head = [spec.key] if with_key else []
    return df.select(*head, *spec.features, spec.target)
