"""Consecutive row numbers in key order, without one task ever holding the whole order.

Rows are range-partitioned by the order and written with the number of their partition. Rows are numbered inside each
partition, and the counts of the partitions before it shift them: two passes, and a row per partition in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmill.functions.scalars import q
from riskmill.session import materialize


def row_numbers(df: DataFrame, order, out: str = "row_id", start: int = 0) -> DataFrame:
    """Adds ``out``: ``start``, start + 1, ... in the order of the columns ``order``, nulls first.

    Rows that agree in all of them are told apart by a digest of the whole row; only rows that agree in every column get
    their numbers in no particular order, which no reader can tell. So the numbers are the same for any partitioning, and
    may serve as the key of a table without one.
    """
    order = list(order)
    if out in df.columns:
        raise ValueError(f"{out} is a column already")
    tie = F.xxhash64(F.to_json(F.struct(*[q(c) for c in df.columns]), {"ignoreNullFields": "false"}))
    sort = [*[q(c).asc_nulls_first() for c in order], F.col("__tie")]
    ranged = df.withColumn("__tie", tie).repartitionByRange(*sort).withColumn("__part", F.spark_partition_id())
    written = materialize(ranged, "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # A row per partition.
    starts = written.groupBy("__part").agg(F.count("*").alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy("__part").orderBy(*sort)
    numbered = written.withColumn("__nth", F.row_number().over(inside)).join(F.broadcast(starts), "__part")
    return numbered.select(
        *[q(c) for c in df.columns], (F.col("__before") + F.col("__nth") - 1 + F.lit(start)).cast("bigint").alias(out)
    )
