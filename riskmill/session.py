"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "riskmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, ANSI, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # The last of repeated JSON keys counts.
        "spark.sql.variant.allowDuplicateKeys": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local-mode session without one gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="riskmill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives repeated readers
    column pruning, pushdown and (with ``partition_by``) partition pruning. Partitioned rows are
    rebalanced first: files of a useful size, and a value with most of the rows gets many tasks.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    writer = df.write
    if partition_by:
        rebalanced = df.hint("rebalance", *[F.col(c) for c in partition_by])
        writer = rebalanced.write.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reliable_checkpoints(spark: SparkSession) -> None:
    """Gives Spark's own checkpoints a place in the shared folder, unless the session has one.

    Iterative learners then cut the lineage of their residuals every few rounds instead of carrying all of it.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``new_folder`` named and that no frame still reads."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
