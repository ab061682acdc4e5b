"""Tables in and out: CSV with pandas-like missing tokens, Parquet, JSON lines, stored metrics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmill.functions.scalars import nan_to_null, q

# Texts that mean a missing cell. "Unknown" is a value, not one of them.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


BOOLEAN_TEXTS = ("true", "True", "TRUE", "false", "False", "FALSE")
WHOLE_TEXT = r"^\s*[+-]?\d+\s*$"
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def infer_csv_schema(
    spark: SparkSession, path: str, null_tokens=NULL_TOKENS, multi_line: bool = False
) -> T.StructType:
    """Column types from all cells of a header CSV, for looking at a file that has no spec yet.

    Whole numbers are bigint, or double where a cell is missing; other numbers double; truth words
    boolean where none is missing; a column of missing cells only double; anything else string.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
    checks = []
    for i, c in enumerate(raw.columns):
        cell = F.when(~q(c).isin(*null_tokens), q(c))
        whole = cell.rlike(WHOLE_TEXT) & cell.try_cast("bigint").isNotNull()
        checks.append(F.struct(
            F.count("*").alias("rows"), F.count(cell).alias("cells"), F.count_if(whole).alias("whole"),
            F.count_if(cell.rlike(NUMBER_TEXT)).alias("numbers"), F.count_if(cell.isin(*BOOLEAN_TEXTS)).alias("truth"),
        ).alias(f"c{i}"))
    row = raw.agg(*checks).first()
    fields = []
    for i, c in enumerate(raw.columns):
        found = row[f"c{i}"]
        complete = found["cells"] == found["rows"]
        if found["cells"] and found["truth"] == found["cells"] and complete:
            kind = T.BooleanType()
        elif found["cells"] and found["whole"] == found["cells"] and complete:
            kind = T.LongType()
        elif found["numbers"] == found["cells"]:
            kind = T.DoubleType()
        else:
            kind = T.StringType()
        fields.append(T.StructField(c, kind))
    return T.StructType(fields)


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, null_tokens=NULL_TOKENS,
    strict: bool = False, multi_line: bool = False,
) -> DataFrame:
    """A header CSV as a typed table.

    Cells are read as text, missing tokens become NULL, the rest is cast. A cell that does not
    cast is NULL, or an error with ``strict``.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])
    raw = (
        spark.read.schema(text).option("header", True).option("enforceSchema", False)
        .option("escape", '"').option("multiLine", multi_line).csv(path)
    )
    cells = []
    for f in wanted.fields:
        cell = F.when(~q(f.name).isin(*null_tokens), q(f.name))
        typed = cell.cast(f.dataType) if strict else cell.try_cast(f.dataType)
        cells.append(typed.alias(f.name))
    return nan_to_null(raw.select(*cells))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header CSV parts, missing cells empty; as many files as partitions."""
    (
        df.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "")
        .option("escape", '"').csv(path)
    )


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by=()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def json_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One record text per line in ``body``, as a table or a file stream; nothing is parsed here."""
    reader = spark.readStream if stream else spark.read
    return reader.text(path).withColumnRenamed("value", "body")


def stored_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A metrics table written earlier; empty when there is none yet."""
    try:
        return scan_csv(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)


def look_up(df: DataFrame, **equal) -> DataFrame:
    """Rows where every named column has the given value."""
    for column, value in equal.items():
        df = df.filter(q(column) == F.lit(value))
    return df
