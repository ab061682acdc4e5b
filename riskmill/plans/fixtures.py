"""Mixed-type tables with a 0/1 target, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmill.functions.hashing import keyed_digest, uniform_draw
from riskmill.functions.scalars import nan_to_null
from riskmill.spec import FeatureSpec

SEED = 42

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

RISK_SPEC = FeatureSpec(
    key="row_id",
    numeric=("x_num",),
    categorical=("x_cat",),
    binary=("x_bin",),
    target="target",
    domains={"x_cat": EVENT_TYPES},
    ranges={"x_num": (0, 400)},
)

DOC_SPEC = FeatureSpec(
    key="doc_id",
    numeric=("n_chars",),
    categorical=("lang", "source"),
    binary=("quality",),
    target="toxic",
)

ORDER_SPEC = FeatureSpec(
    key="o_orderkey",
    numeric=("o_totalprice", "c_acctbal"),
    categorical=("o_orderpriority", "c_mktsegment"),
    binary=("late_year",),
    target="target",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def risk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a rare 0/1 target that rises with the value and for errors."""
    events = table(spark, sf_dir, "events")
    chance = (
        F.lit(0.01)
        + F.least(F.col("value"), F.lit(200.0)) / F.lit(200.0) * F.lit(0.12)
        + F.when(F.col("event_type") == "error", 0.05).otherwise(0.0)
    )
    return events.select(
        F.col("event_id").alias("row_id"),
        F.col("value").alias("x_num"),
        F.col("event_type").alias("x_cat"),
        (F.col("user_id") % 2).cast("int").alias("x_bin"),
        (uniform_draw(SEED, "t", F.col("event_id")) < chance).cast("int").alias("target"),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a toxicity label: numeric length, two categorical columns, one flag."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id")


def risk_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer: two numeric and two categorical features, a rare target."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    chance = (
        F.lit(0.01)
        + F.least(F.col("o_totalprice"), F.lit(400000.0)) / F.lit(400000.0) * F.lit(0.03)
        + F.when(F.col("c_acctbal") < 0, 0.04).otherwise(0.0)
    )
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        "o_totalprice",
        "c_acctbal",
        "o_orderpriority",
        "c_mktsegment",
        (F.year("o_orderdate") >= 1997).cast("int").alias("late_year"),
        (uniform_draw(SEED, "t", F.col("o_orderkey")) < chance).cast("int").alias("target"),
    )


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with missing values, broken rules and repeated rows."""
    eid = F.col("event_id")
    copies = F.when(eid % 100 == 4, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        table(spark, sf_dir, "events")
        .select(
            "event_id",
            "event_type",
            F.when(eid % 25 == 0, F.lit(None).cast("double"))
            .when(eid % 40 == 1, -F.col("value"))
            .otherwise(F.col("value"))
            .alias("value"),
            F.when(eid % 50 == 2, F.lit(5))
            .when(eid % 50 == 3, F.lit(None).cast("int"))
            .otherwise((F.col("user_id") % 2).cast("int"))
            .alias("flag"),
            F.explode(copies).alias("copy"),
        )
        .drop("copy")
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label, a score with many ties, and a fold, without any model."""
    score = F.lit(0.5) * uniform_draw(SEED, "s", F.col("row_id")) + F.lit(0.5) * F.least(
        F.col("x_num"), F.lit(200.0)
    ) / F.lit(200.0)
    fold = F.conv(F.substring(keyed_digest(SEED, "g", F.col("row_id")), 1, 4), 16, 10).cast("int") % 5
    return risk_events(spark, sf_dir).select(
        "row_id", "x_cat", "x_bin", fold.alias("fold"), F.col("target").alias("label"),
        F.round(score, 2).alias("score"),
    )


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text per event, most of them well formed and some broken in every known way."""
    eid = F.col("event_id")
    value = F.col("value").cast("string")
    flag = (F.col("user_id") % 2).cast("string")

    def text(v, t, f, extra=""):
        return F.concat(
            F.lit('{"x_num":'), v, F.lit(',"x_cat":'), t, F.lit(',"x_bin":'), f, F.lit(extra + "}")
        )

    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    lit = F.lit
    body = (
        F.when(eid % 20 == 0, F.concat(lit('{"x_cat":'), quoted, lit(',"x_bin":'), flag, lit("}")))
        .when(eid % 20 == 1, text(value, lit('""'), flag))
        .when(eid % 20 == 2, text(F.concat(lit('"'), value, lit('"')), quoted, flag))
        .when(eid % 20 == 3, text(value, quoted, F.when(F.col("user_id") % 2 == 1, "true").otherwise("false")))
        .when(eid % 20 == 4, text(lit("-5"), lit('"vapes"'), lit("7")))
        .when(eid % 20 == 5, text(value, lit('"Unknown123"'), flag))
        .when(eid % 20 == 6, lit("{bad"))
        .when(eid % 20 == 7, lit("[1]"))
        .when(eid % 20 == 8, lit("null"))
        .when(eid % 20 == 9, lit('"x"'))
        .when(eid % 20 == 10, text(value, quoted, flag, ',"extra":[1,2]'))
        .when(eid % 20 == 11, text(lit('"abc"'), quoted, lit('"yes"')))
        .when(eid % 20 == 12, text(lit("null"), lit("null"), flag))
        .otherwise(text(value, quoted, flag))
    )
    return table(spark, sf_dir, "events").select(eid.alias("row_id"), body.alias("body"))
