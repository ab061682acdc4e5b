"""Continuous scoring of JSON records: a stateless stream with good and rejected outputs."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskmill.operators.models import LinearScorer
from riskmill.operators.scoring import responses, score_table
from riskmill.operators.validate import validate_records
from riskmill.spec import FeatureSpec, ScoringSettings


MANIFEST = "stream string, batch bigint, attempt string"


def _stream_name(checkpoint_dir: str) -> str:
    return hashlib.sha256(checkpoint_dir.rstrip("/").encode()).hexdigest()[:16]


def start_scoring(
    records: DataFrame, out_dir: str, checkpoint_dir: str, spec: FeatureSpec,
    scorer: LinearScorer | PipelineModel, settings: ScoringSettings = ScoringSettings(),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Scores the ``body`` of every record of a stream.

    A micro-batch is one write, partitioned into good and rejected rows, to a folder named by the
    checkpoint and its batch id. A batch repeated after a failure replaces its own folder, so no row is
    written twice; a stream that starts anew with another checkpoint leaves earlier output alone.
    """
    stream = _stream_name(checkpoint_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        scored = score_table(validate_records(batch, spec), spec, scorer, settings)
        scored.write.mode("overwrite").partitionBy("valid").parquet(f"{out_dir}/stream={stream}/batch={batch_id}")

    return (
        records.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def scored_records(spark: SparkSession, out_dir: str) -> DataFrame:
    """Everything written so far; filter on ``valid`` to read one side only."""
    found = spark.read.parquet(out_dir).drop("batch", "stream")
    return found.withColumn("valid", F.col("valid").cast("boolean"))


def committed_batches(spark: SparkSession, out_dir: str) -> DataFrame:
    """``stream, batch, attempt`` of every finished batch; none before the first."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], MANIFEST)


def _commit(spark: SparkSession, out_dir: str, stream: str, batch_id: int, attempt: str) -> None:
    """One manifest row: from here on the batch counts."""
    row = spark.createDataFrame([(stream, batch_id, attempt)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{out_dir}/manifest")


def start_responding(
    records: DataFrame, out_dir: str, checkpoint_dir: str, spec: FeatureSpec,
    scorer: LinearScorer | PipelineModel, settings: ScoringSettings = ScoringSettings(),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Answers the ``body`` of every record of a stream with a response record.

    Results and error records are two parts (``accepted``) of one write. Each attempt at a batch writes a folder of
    its own, and a row in the manifest commits it once all of it is there. An attempt that fails half-way, or a batch
    that is repeated after its commit, leaves what readers see as it is.
    """
    stream = _stream_name(checkpoint_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mine = committed_batches(spark, out_dir).filter((F.col("stream") == stream) & (F.col("batch") == batch_id))
        if not mine.isEmpty():
            return
        attempt = uuid.uuid4().hex
        scored = score_table(validate_records(batch, spec), spec, scorer, settings)
        answered = responses(scored.withColumn("accepted", F.col("valid")), settings)
        answered.write.partitionBy("accepted").parquet(
            f"{out_dir}/batches/stream={stream}/batch={batch_id}/attempt={attempt}"
        )
        _commit(spark, out_dir, stream, batch_id, attempt)

    return (
        records.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def committed_responses(spark: SparkSession, out_dir: str) -> DataFrame:
    """The response records of all committed batches; filter on ``accepted`` to read one side only.

    The manifest, joined on the folders' names, prunes the folders that are read.
    """
    listed = committed_batches(spark, out_dir)
    if listed.isEmpty():
        return spark.createDataFrame([], "body string, response string, accepted boolean")
    found = spark.read.option("basePath", f"{out_dir}/batches").parquet(f"{out_dir}/batches")
    found = found.withColumns({c: F.col(c).cast("string") for c in ("stream", "attempt")})
    seen = found.join(listed, ["stream", "batch", "attempt"], "left_semi").drop("stream", "batch", "attempt")
    return seen.withColumn("accepted", F.col("accepted").cast("boolean"))
