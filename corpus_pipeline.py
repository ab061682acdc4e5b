"""From raw documents to packed sequences: five stages, each written and read again before the next.

Near duplicates are judged on what the earlier stages kept, packing on what remains at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmill.llm import exact_dedup, minhash, packing, quality, toxicity
from riskmill.llm.queries import vocabulary_path
from riskmill.llm.shared import table
from riskmill.session import materialize


def _row_key(docs: DataFrame) -> Column:
    """A number for identifier and text together, so that a verdict reaches its own row, whatever its identifier."""
    return F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit("")))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rows whose keys are the ``doc_id`` of ``rejected``."""
    gone = rejected.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, _row_key(docs) == gone["_gone"], "left_anti")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_row_key(docs).alias("doc_id"), docs["text"])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier predicts as 0."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _without(docs, materialize(quality.score(_keyed(docs), model), "quality").where("predicted = 0"))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the severity model calls toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _without(docs, materialize(toxicity.score(_keyed(docs), model), "toxicity").where("toxic = 1"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every piece of every document in a sequence."""
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", keep_civil),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("best-fit packing", pack),
]

# SQL states neither the fitted classifiers nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
