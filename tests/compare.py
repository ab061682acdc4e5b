"""Runs queries beside their SQL and compares names, row counts and values."""

from __future__ import annotations

import math
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value) + 0.0)
    return str(value)


def normal_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, query, sql) -> str:
    """Empty when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    left = normal_rows(df.columns, df.collect())
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    right = normal_rows(names, got.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""


def main(argv):
    from riskmill.session import get_session

    import __spark_entry__ as entry

    sf_dir = argv[0]
    spark = get_session("compare", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
                        spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, sf_dir, name, queries[name], sql[name])
            else:
                problem = f"(no SQL) {len(queries[name](spark, sf_dir).collect())} rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(problem) and not problem.startswith("(no SQL)")
        print(f"{name:28s} {time.time() - start:6.1f}s  {problem or 'ok'}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    import sys

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    main(sys.argv[1:])
