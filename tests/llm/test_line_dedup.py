"""Line deduplication beside a brute-force version, its runs, and its plans."""

import hashlib
import string
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskmill.llm import line_dedup
from riskmill.llm.line_dedup import LineRule, Runs

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, least_chars=40, least_docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    held = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                held.setdefault(key(line), set()).add(-(2**63) if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        own = -(2**63) if doc_id is None else doc_id
        kept = [x for x in lines if len(held.get(key(x), ())) < least_docs or max(held[key(x)]) == own]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def made(spark, rows, rule=LineRule()):
    docs = spark.createDataFrame([(a, b, 0, "z") for a, b in rows], "doc_id long, text string, mark int, h1 string")
    return Counter(tuple(r) for r in line_dedup.dedup_lines(docs, rule).collect())


LONG = "This footer line occurs in very many documents of the table"
OTHER = "naïve café — a line with multibyte characters, 40 and more é"


def test_every_case(spark):
    rows = [(i, f"own line of document {i} that is long enough to count as one\n{LONG}\nshort") for i in range(40)]
    rows += [(100 + i, f"  {LONG.upper()}\t\n\n{LONG}") for i in range(3)]
    rows += [(200 + i, "\n".join([OTHER] * 3)) for i in range(5)]
    rows += [(300 + i, "four documents hold this line, which is one too few for it") for i in range(4)]
    rows += [(400, "a line that one document repeats, however often it does so\n" * 300)]
    rows += [(500, None), (501, ""), (502, "\n"), (503, "\n\n\n"), (None, LONG), (None, None), (None, OTHER + "\nx")]
    rows += [(600, LONG), (600, LONG), (600, f"{LONG}\nother text of a repeated identifier"), (601, LONG[:39])]
    rows += [(700 + i, "Ä" * 40 + "\r") for i in range(6)] + [(710 + i, "ä" * 40) for i in range(6)]
    rows += [(720 + i, "x" * 39 + " ") for i in range(6)]
    assert made(spark, rows) == brute(rows)
    for rule in (LineRule(batches=1), LineRule(batches=7, fanout=2, share=1), LineRule(batches=5, fanout=3, share=10**9)):
        assert made(spark, rows, rule) == brute(rows)
    assert made(spark, rows, LineRule(least_chars=1, least_docs=2)) == brute(rows, 1, 2)


def test_empty_table_and_no_long_line(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.digests(docs).collect() == []
    assert made(spark, [(1, "a\nb"), (2, None)]) == brute([(1, "a\nb"), (2, None)])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.lists(st.sampled_from(["aa", "AA ", "\tbbb", "é", "", "cc"]), max_size=6)),
                max_size=20))
def test_random_tables(spark, drawn):
    rows = [(i, "\n".join(lines)) for i, lines in drawn]
    assert made(spark, rows, LineRule(2, 3, 3)) == brute(rows, 2, 3)


def batch(spark, numbers):
    rows = spark.createDataFrame([(x, -x, 1, 1, x) for x in numbers], "h1 long, h2 long, n long, n_rows long, last long")
    return rows


def test_runs_are_disjoint_levelled_and_removed(spark, tmp_path):
    runs = Runs(spark, 2)
    for k in range(6):
        runs.add(batch(spark, range(10 * k, 10 * k + 20)))
    assert [len(level) for level in runs.levels] == [2, 0, 1]
    held = [r["h1"] for name in runs.names() for r in spark.table(name).collect()]
    assert sorted(held) == list(range(70))
    totals = {r["h1"]: r["n"] for r in runs.totals().collect()}
    assert totals == {x: 2 if 10 <= x < 60 else 1 for x in range(70)}
    names = list(runs.folders)
    runs.drop()
    assert not [n for n in names if spark.catalog.tableExists(n)]


def test_a_batch_meets_the_runs_without_moving_either(spark):
    runs = Runs(spark, 4)
    first = runs.add(batch(spark, range(0, 50)))
    second = runs._sorted(batch(spark, range(25, 75)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table(second).join(spark.table(first), line_dedup.HASH, "left_anti")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 25
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.drop()


def test_no_python_and_frequent_lines_are_not_dealt_by_hash(spark):
    rows = [(i, f"{LONG}\nline {i} is of its own and long enough to be looked at here") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    rule = LineRule(share=100)
    lines = line_dedup.long_lines(line_dedup.texts(docs, "doc_id", "text"), rule)
    totals = line_dedup.entries(lines)
    gone = line_dedup.looked_up(lines, totals, lines.count(), rule)
    assert gone.count() == 2999
    plan = line_dedup.digests(docs, rule)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    # The frequent line's rows are taken out before anything is dealt out by hash.
    left = lines.join(totals.where("n_rows * 100 > 6000").select("h1", "h2"), ["h1", "h2"], "left_anti")
    assert left.groupBy("h1", "h2").count().agg(F.max("count")).first()[0] == 1


def test_digests_of_the_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = {tuple(r) for r in line_dedup.digests(docs).collect()}
    assert found == {(a, n, d, hashlib.sha256(t.encode()).hexdigest()) for a, n, d, t in brute(rows)}
