import math

from pyspark.sql import functions as F

from riskmill.operators import clean, profile, rules
from riskmill.session import new_folder
from riskmill.sources import tables


def test_null_tokens_and_unknown(spark):
    path = new_folder(spark, "tokens")
    body = 'id,x,s\n1,N/A,Unknown\n2,NA,nan\n3,,"a, ""b"""\n4,1e3,null\n5,abc,x\n6,NaN,#N/A\n'
    spark.createDataFrame([(line,) for line in body.splitlines()], "v string").coalesce(1).write.text(path)
    rows = tables.scan_csv(spark, path, "id bigint, x double, s string").orderBy("id").collect()
    assert [r["x"] for r in rows] == [None, None, None, 1000.0, None, None]
    assert [r["s"] for r in rows] == ["Unknown", None, 'a, "b"', None, "x", None]


def test_csv_keeps_missing_cells_missing(spark):
    path = new_folder(spark, "csv")
    df = spark.createDataFrame([(1, None, 'say "hi", you'), (2, 2.5, None)], "id bigint, x double, s string")
    tables.write_csv(df, path)
    back = tables.scan_csv(spark, path, "id bigint, x double, s string")
    assert back.exceptAll(df).isEmpty() and back.count() == 2


def test_missing_metrics_table_is_empty(spark):
    none = tables.stored_metrics(spark, new_folder(spark, "none"), "model string, recall double")
    assert none.count() == 0 and none.columns == ["model", "recall"]


def test_nan_is_missing_not_large(spark):
    df = spark.createDataFrame([(1, math.nan), (2, -1.0), (3, None)], "id int, x double")
    counts = rules.rule_counts(df, [rules.below("x"), rules.at_most("x")]).collect()
    assert [r["n"] for r in counts] == [1, 1]
    assert clean.clean_table(df).filter(F.col("x").isNull()).count() == 2


def test_no_violation_has_its_own_line(spark):
    df = spark.createDataFrame([(1, 1.0)], "id int, x double")
    rows = rules.violations_report(df, [rules.below("x")]).collect()
    assert len(rows) == 1 and rows[0]["n"] == 0 and "No invalid" in rows[0]["message"]


def test_missing_flag_breaks_its_domain(spark):
    df = spark.createDataFrame([(0,), (1,), (None,), (5,)], "f int")
    assert rules.violating_rows(df, [rules.not_in("f", (0, 1))]).count() == 2


def test_missing_equals_missing_in_duplicates(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, None), (1, "x" * 100)], "k int, s string")
    row = profile.dup_report(df, "k").first()
    assert (row["n_rows"], row["row_duplicates"], row["key_duplicates"]) == (5, 2, 3)


def test_different_records_with_equal_answers_stay(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a")], "id int, s string")
    assert clean.clean_table(df, drop=("id",)).count() == 2


def test_inferred_types(spark):
    path = new_folder(spark, "infer")
    body = "a,b,c,d,e,f\n1,1,1.5,True,x,\n2,NA,2,False,1,NA\n"
    spark.createDataFrame([(line,) for line in body.splitlines()], "v string").coalesce(1).write.text(path)
    schema = tables.infer_csv_schema(spark, path)
    assert [f.dataType.simpleString() for f in schema] == ["bigint", "double", "double", "boolean", "string", "double"]
    assert tables.scan_csv(spark, path, schema).count() == 2
