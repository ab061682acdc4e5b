"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Keys of at least
``least_chars`` code points that occur in at least ``least_docs`` documents lose their lines everywhere but in the document
with the largest identifier that holds them. Keys are compared by two 64-bit hashes (128 bits) of them.

1. One scan of the texts writes the long lines' hashes, dealt to batches by document.
2. Each batch becomes a sorted run: a row per hash with its number of documents and rows and its largest document. Runs are
   bucketed by hash and sorted inside a bucket, so that joining them moves nothing.
3. A batch merge-anti-joins the runs before it: hashes that none of them holds become a run of their own on level 0.
   Hashes that one holds already go to a log of repeated ones. So runs never share a hash.
4. A level with ``fanout`` runs is compacted into one run of the next level before the next batch. Every batch thus meets few
   runs, and a hash is rewritten once per level.
5. Runs merged with the sums of the log give the total of every hash.
6. Lines are looked up in the totals. Hashes with more than 1 / ``share`` of all rows are at most ``share``, whatever the
   table holds; they are broadcast, and their rows never meet in one task. The others are joined by hash.
7. Places of lines to drop are gathered per text and joined back to it.

Defined cases: a null or empty text is one empty line; a null identifier counts as the smallest one; rows with the same
identifier are one document (a line in all of them counts once, and all of them keep or lose it); a text that loses all
its lines becomes empty; a key that ``least_docs`` documents don't hold stays however often they repeat it; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from string import ascii_lowercase, ascii_uppercase
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmill.session import discard, materialize, new_folder

HASH = ["h1", "h2"]
NO_ID = -(2**63)


@dataclass(frozen=True)
class LineRule:
    least_chars: int = 40
    least_docs: int = 5
    batches: int = 4
    fanout: int = 2
    share: int = 10_000


@dataclass
class Runs:
    """Levels of sorted runs in the shared folder. A run has each hash once, and no two runs share one."""

    spark: SparkSession
    fanout: int = 2
    levels: list[list[str]] = field(default_factory=list)
    repeats: list[str] = field(default_factory=list)
    folders: dict[str, str] = field(default_factory=dict)

    def _sorted(self, rows: DataFrame) -> str:
        """Writes ``rows``, bucketed and sorted by hash, and returns the table's name."""
        name = f"line_run_{uuid4().hex}"
        self.folders[name] = new_folder(self.spark, "line-run")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartition(buckets, *HASH)
        dealt.write.bucketBy(buckets, *HASH).sortBy(*HASH).saveAsTable(name, format="parquet", path=self.folders[name])
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, self.folders.pop(name))

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def compact(self) -> None:
        """Merges the runs of each full level into one of the next."""
        for k in range(len(self.levels)):
            if len(self.levels[k]) < self.fanout:
                continue
            if k + 1 == len(self.levels):
                self.levels.append([])
            old = self.levels[k]
            both = self.spark.table(old[0])
            for name in old[1:]:
                both = both.unionAll(self.spark.table(name))
            self.levels[k + 1].append(self._sorted(both))
            self.levels[k] = []
            for name in old:
                self._drop(name)

    def add(self, entries: DataFrame) -> str:
        """Adds a batch (h1, h2, n, n_rows, last), each hash once, and returns the run of its new hashes."""
        self.compact()
        batch = self._sorted(entries)
        new = self.spark.table(batch)
        for name in self.names():
            new = new.join(self.spark.table(name), HASH, "left_anti")
        if not self.names():
            run = batch
        else:
            run = self._sorted(new)
            self.repeats.append(self._sorted(self.spark.table(batch).join(self.spark.table(run), HASH, "left_anti")))
            self._drop(batch)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        return run

    def totals(self) -> DataFrame:
        """(h1, h2, n, n_rows, last) of every hash: its run and what later batches added."""
        added = None
        for name in self.repeats:
            rows = self.spark.table(name)
            added = rows if added is None else added.unionAll(rows)
        parts = [self.spark.table(name) for name in self.names()]
        if added is not None:
            more = added.groupBy(*HASH).agg(
                F.sum("n").alias("more"), F.sum("n_rows").alias("more_rows"), F.max("last").alias("later")
            )
            parts = [
                part.join(more, HASH, "left").select(
                    *HASH, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"),
                    (F.col("n_rows") + F.coalesce("more_rows", F.lit(0))).alias("n_rows"),
                    F.greatest("last", "later").alias("last"),
                )
                for part in parts
            ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return out

    def drop(self) -> None:
        for name in list(self.folders):
            self._drop(name)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), ascii_uppercase, ascii_lowercase)


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc, mark, lines): ``mark`` tells texts of one identifier apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).alias("mark"), F.split(text, "\n").alias("lines"),
    )


def long_lines(docs: DataFrame, rule: LineRule) -> DataFrame:
    """(batch, h1, h2, doc, mark, place) of every line with a long key, written once."""
    lines = docs.select("doc", "mark", F.posexplode("lines").alias("place", "line"))
    keys = lines.select("doc", "mark", "place", line_key(F.col("line")).alias("key"))
    hashed = keys.where(F.length("key") >= rule.least_chars).select(
        F.pmod(F.xxhash64("doc"), F.lit(rule.batches)).cast("int").alias("batch"),
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc", "mark", "place",
    )
    path = new_folder(docs.sparkSession, "lines")
    hashed.write.partitionBy("batch").parquet(path)
    return docs.sparkSession.read.schema(hashed.schema).parquet(path)


def entries(lines: DataFrame) -> DataFrame:
    """A row per hash: documents, rows and the largest document. Counted per document first, so no hash is hot."""
    pairs = lines.groupBy(*HASH, "doc").agg(F.count("*").alias("n_rows"))
    return pairs.groupBy(*HASH).agg(
        F.count("*").alias("n"), F.sum("n_rows").alias("n_rows"), F.max("doc").alias("last")
    )


def looked_up(lines: DataFrame, totals: DataFrame, total: int, rule: LineRule) -> DataFrame:
    """(doc, mark, place) of the lines to drop. ``totals`` is a written table, ``total`` the number of ``lines``."""
    often = F.col("n_rows") * rule.share > total
    wanted = totals.select(*HASH, "last", (F.col("n") >= rule.least_docs).alias("common"), often.alias("often"))
    hot = F.broadcast(wanted.where("often").select(*HASH, "last", "common"))
    rare = wanted.where("common AND NOT often").select(*HASH, "last")
    first = lines.join(hot, HASH).where("common AND doc <> last")
    # Hashes that are frequent, but in few documents, must not be dealt out by hash either.
    second = lines.join(hot.select(*HASH), HASH, "left_anti").join(rare, HASH).where("doc <> last")
    return first.select("doc", "mark", "place").unionAll(second.select("doc", "mark", "place"))


def dedup_lines(
    docs: DataFrame, rule: LineRule = LineRule(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of every row. ``docs`` is read twice."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    lines = long_lines(rows, rule)
    runs = Runs(spark, rule.fanout)
    for batch in range(rule.batches):
        runs.add(entries(lines.where(F.col("batch") == batch)))
    total = lines.count()
    # What is neither common nor frequent plays no further part.
    held = (F.col("n") >= rule.least_docs) | (F.col("n_rows") * rule.share > total)
    totals = materialize(runs.totals().where(held), "line-totals")
    runs.drop()
    gone = looked_up(lines, totals, total, rule).groupBy("doc", "mark").agg(F.collect_set("place").alias("places"))
    joined = rows.join(gone, ["doc", "mark"], "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    kept = F.when(F.col("places").isNull(), F.col("lines")).otherwise(
        F.transform(places, lambda at: F.get("lines", at))
    )
    return joined.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text"),
    )


def digests(docs: DataFrame, rule: LineRule = LineRule()) -> DataFrame:
    """``dedup_lines`` with a digest of the text that stays."""
    return dedup_lines(docs, rule).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256")
    )
