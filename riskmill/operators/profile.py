"""Data-quality profiling: one pass and small results wherever the measure allows it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmill.functions.scalars import percent, q
from riskmill.operators.quantiles import exact_quantiles

QUARTILES = (0.25, 0.5, 0.75)


def _rows(structs: list[Column], source: DataFrame) -> DataFrame:
    """Turns the structs of a one-row aggregate into rows."""
    return source.select(F.inline(F.array(*structs)))


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def null_report(df: DataFrame) -> DataFrame:
    """Missing values per column: ``column, n_missing, pct_missing``."""
    counted = df.agg(
        F.count("*").alias("n_rows"), *[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    )
    return _rows([
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"m{i}").alias("n_missing"),
            percent(F.col(f"m{i}"), F.col("n_rows")).alias("pct_missing"),
        )
        for i, c in enumerate(df.columns)
    ], counted)


def _comparable(df: DataFrame, column: str) -> Column:
    """The value itself, or the digest of a text, which would only be compared."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return q(column).alias(column)
    return F.sha2(q(column), 256).alias(column)


def dup_report(df: DataFrame, key: str) -> DataFrame:
    """Copies beyond the first, of whole rows and of the key; missing equals missing."""
    rows = df.select(*[_comparable(df, c) for c in df.columns]).groupBy(*[q(c) for c in df.columns]).agg(F.count("*").alias("n"))
    full = rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("row_duplicates"),
    )
    keys = df.select(_comparable(df, key)).groupBy(q(key)).agg(F.count("*").alias("n")).agg(
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("k")
    )
    return full.withColumn("key_duplicates", keys.scalar())


def value_counts(df: DataFrame, columns) -> DataFrame:
    """Rows per value, missing included: ``column, value, n``; one shuffle for all columns."""
    pairs = [F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*pairs))).groupBy("column", "value").agg(F.count("*").alias("n"))


def class_distribution(df: DataFrame, target: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``label, n, pct`` for both classes, also an absent one; the percentage is of all rows."""
    counted = df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), *[F.count_if(q(target) == c).alias(f"n{c}") for c in (0, 1)]
    )
    structs = [
        F.struct(
            F.lit(c).alias("label"), F.col(f"n{c}").alias("n"),
            percent(F.col(f"n{c}"), F.col("n_rows")).alias("pct"),
        )
        for c in (0, 1)
    ]
    return counted.select(*by, F.inline(F.array(*structs)))


def _moments(df: DataFrame, columns):
    values = [F.when(~F.isnan(q(c).cast("double")), q(c).cast("double")) for c in columns]
    return df.agg(*[
        F.struct(
            F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("lo"), F.max(v).alias("hi"),
        ).alias(f"s{i}")
        for i, v in enumerate(values)
    ]).first()


DESCRIBE_SCHEMA = "column string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double"


def describe_numeric(df: DataFrame, columns, exact: bool = True) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles; ``exact=False`` sketches the quartiles."""
    columns = list(columns)
    row = _moments(df, columns)
    stats = {c: row[f"s{i}"] for i, c in enumerate(columns)}
    if exact:
        bounds = {c: (s["n"], s["lo"], s["hi"]) for c, s in stats.items()}
        quart = exact_quantiles(df, columns, QUARTILES, bounds)
    else:
        sketch = df.approxQuantile(columns, list(QUARTILES), 0.001)
        quart = {c: v or [None] * 3 for c, v in zip(columns, sketch, strict=True)}
    out = [
        (c, s["n"], s["mean"], s["std"], s["lo"], *quart[c], s["hi"]) for c, s in stats.items()
    ]
    return df.sparkSession.createDataFrame(out, DESCRIBE_SCHEMA)


def describe_mixed(df: DataFrame, exact: bool = True) -> DataFrame:
    """The numeric summary, and for other columns the distinct count and the most frequent value."""
    numeric = [c for c in df.columns if is_numeric(df, c)]
    other = [c for c in df.columns if c not in numeric]
    blank = {"n_unique": "bigint", "top": "string", "freq": "bigint"}
    parts = []
    if numeric:
        parts.append(describe_numeric(df, numeric, exact).select(
            "column", "count", *[F.lit(None).cast(t).alias(n) for n, t in blank.items()],
            "mean", "std", "min", "q25", "q50", "q75", "max",
        ))
    if other:
        top = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value")))
        summary = (
            value_counts(df, other).filter("value is not null").groupBy("column")
            .agg(F.sum("n").alias("count"), F.count("*").alias("n_unique"), top.alias("best"))
        )
        # A column without any value has a row too.
        every = df.sparkSession.createDataFrame([(c,) for c in other], "column string")
        summary = every.join(summary, "column", "left").withColumns({
            "count": F.coalesce("count", F.lit(0)), "n_unique": F.coalesce("n_unique", F.lit(0)),
        })
        parts.append(summary.select(
            "column", "count", "n_unique", F.col("best.value").alias("top"), (-F.col("best.neg")).alias("freq"),
            *[F.lit(None).cast("double").alias(n) for n in ("mean", "std", "min", "q25", "q50", "q75", "max")],
        ))
    return reduce(DataFrame.unionByName, parts)


def schema_report(df: DataFrame, key: str) -> DataFrame:
    """Type, non-missing count and an example per column (the value at the smallest key that has one)."""
    counted = df.agg(*[
        F.struct(
            F.count(q(c)).alias("n"),
            F.min_by(q(c).cast("string"), F.when(q(c).isNotNull(), q(key))).alias("example"),
        ).alias(f"s{i}")
        for i, c in enumerate(df.columns)
    ])
    kinds = dict(df.dtypes)
    return _rows([
        F.struct(
            F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"),
            F.col(f"s{i}.n").alias("non_null"), F.col(f"s{i}.example").alias("example"),
        )
        for i, c in enumerate(df.columns)
    ], counted)


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(",".join(df.columns)).alias("columns")
    )


def role_inference(df: DataFrame, columns, exact: bool = True) -> DataFrame:
    """Suggests a role from the type and the number of distinct values; the spec has the last word."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    counted = df.agg(*[distinct(q(c)).alias(f"d{i}") for i, c in enumerate(columns)])
    structs = []
    for i, c in enumerate(columns):
        n = F.col(f"d{i}")
        role = F.when(F.lit(is_numeric(df, c)) & (n > 2), "numeric").when(n == 2, "binary").otherwise("categorical")
        structs.append(F.struct(F.lit(c).alias("column"), n.alias("n_unique"), role.alias("role")))
    return _rows(structs, counted)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over the observed range, the last one closed: ``bin, lo, hi, n``."""
    value = q(column).cast("double")
    value = F.when(~F.isnan(value), value)
    row = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    spark = df.sparkSession
    if row["lo"] is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n bigint")
    lo, hi = float(row["lo"]), float(row["hi"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    part = F.least(F.floor((value - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counted = df.filter(value.isNotNull()).groupBy(part.alias("bin")).agg(F.count("*").alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def head_tail(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First and last rows in key order."""
    head = df.orderBy(q(key).asc(), *[q(c) for c in df.columns if c != key]).limit(n)
    tail = df.orderBy(q(key).desc(), *[q(c).desc() for c in df.columns if c != key]).limit(n)
    return head.withColumn("part", F.lit("head")).unionByName(tail.withColumn("part", F.lit("tail")))


def domain_discovery(df: DataFrame, columns) -> DataFrame:
    """Distinct values of each categorical column, in order: ``column, value``."""
    found = value_counts(df, columns).filter("value is not null").select("column", "value")
    return found.orderBy("column", "value")


def quality_summary(df: DataFrame, key: str, target: str, rules) -> DataFrame:
    """Rows, columns, duplicates, missing cells, failing rules and class balance in one record."""
    missing = reduce(lambda a, b: a + b, [F.count_if(q(c).isNull()) for c in df.columns])
    failing = reduce(
        lambda a, b: a + b, [(F.count_if(r.broken()) > 0).cast("int") for r in rules], F.lit(0)
    )
    summary = df.agg(
        F.count("*").alias("n_rows"), missing.alias("missing_cells"), failing.alias("failing_rules"),
        F.count_if(q(target) == 0).alias("class_0"), F.count_if(q(target) == 1).alias("class_1"),
    )
    duplicates = dup_report(df, key).select("row_duplicates")
    return summary.select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), duplicates.scalar().alias("row_duplicates"),
        "missing_cells", "failing_rules", "class_0", "class_1",
        percent(F.col("class_1"), F.col("n_rows")).alias("class_1_pct"),
    )
