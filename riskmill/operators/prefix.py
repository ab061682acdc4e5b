"""Running totals in value order without one task ever holding the whole order.

Rows are first collapsed to distinct values (partial aggregation before the shuffle), which are
range-partitioned by value and written once, with the number of their partition. Each range is
totalled, the range totals give every range its starting offset, and the exact running sum is
finished inside the ranges in parallel. What stands above the collapsing runs once.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmill.session import materialize

ROWS_PER_RANGE = 250_000


def value_cuts(df: DataFrame, value: str) -> list[float]:
    """Cut points for two or more ranges of about ROWS_PER_RANGE rows; their number has no ceiling."""
    n = df.agg(F.count(value)).first()[0]
    ranges = max(2, -(-n // ROWS_PER_RANGE))
    grid = ",".join(f"{i / ranges!r}D" for i in range(1, ranges))
    cuts = df.agg(F.expr(f"percentile_approx(`{value}`, array({grid}), {max(100, 4 * ranges)})")).first()[0]
    return sorted(set(cuts or []))


def with_range(df: DataFrame, value: str, cuts: list[float], out: str) -> DataFrame:
    """Adds the index of the value range each row falls in."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    inf = float("inf")
    splits = [-inf, *[c for c in cuts if -inf < c < inf], inf]
    bucketizer = Bucketizer(splits=splits, inputCol=value, outputCol="__range")
    return bucketizer.transform(df).withColumn(out, F.col("__range").cast("int")).drop("__range")


def running_totals(
    df: DataFrame,
    value: str,
    counts: dict[str, F.Column],
    by: tuple[str, ...] = (),
    ahead: bool = False,
) -> DataFrame:
    """One row per distinct value (and ``by`` group), from the highest value down.

    Missing values and NaN have no place in the order.

    For every entry ``name: expression`` of ``counts`` the result has ``name`` (the sum at this
    value), ``cum_name`` (the sum at this value and above) and ``all_name`` (the group's sum); with
    ``ahead`` also ``next_name``, the sum at the next lower value, or null after the last one.
    """
    names = list(counts)
    data = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    distinct = data.groupBy(*by, value).agg(*[F.sum(expr).alias(n) for n, expr in counts.items()])
    # The sample for the borders reads the shuffled distinct values. Written, a row keeps its partition's number.
    ranged = distinct.repartitionByRange(F.col(value)).withColumn("value_range", F.spark_partition_id())
    distinct = materialize(ranged, "value-ranges")
    # A row per range and group from here to the offsets.
    totals = distinct.groupBy(*by, "value_range").agg(
        *[F.sum(n).alias(f"all_{n}") for n in names], F.max_by(F.struct(*names), value).alias("top")
    )
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    downward = group.orderBy(F.desc("value_range"))
    above = downward.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "value_range",
        *[F.coalesce(F.sum(f"all_{n}").over(above), F.lit(0)).alias(f"above_{n}") for n in names],
        *[F.sum(f"all_{n}").over(group).alias(f"all_{n}") for n in names],
        # What the next range begins with, for the last value of this one.
        *([F.lead("top").over(downward).alias("below")] if ahead else []),
    )
    order = Window.partitionBy(*by, "value_range").orderBy(F.desc(value))
    inside = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        distinct.select(
            *by, value, "value_range", *names,
            *[F.sum(n).over(inside).alias(f"in_{n}") for n in names],
            *([F.lead(F.struct(*names)).over(order).alias("lower")] if ahead else []),
        )
        .join(offsets, [*by, "value_range"])
        .select(
            *by, value, *names,
            *[(F.col(f"above_{n}") + F.col(f"in_{n}")).alias(f"cum_{n}") for n in names],
            *[F.col(f"all_{n}") for n in names],
            *([F.coalesce("lower", "below")[n].alias(f"next_{n}") for n in names] if ahead else []),
        )
    )
