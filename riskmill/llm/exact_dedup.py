"""Exact duplicates by sorting content: one shuffle, in DataFrame operations only.

Texts are normalised (every run of ASCII white space becomes one space) and sorted by their bytes, with a short key
(the first bytes and a hash) in front, so that most comparisons end early. Splitters sampled from the table cut that
order into ranges of about equal numbers of rows; a range is sorted by one task, which spills if it must. Equal texts
are then adjacent, and each row is compared with its neighbour in full. The row with the smallest identifier of a run
stays.

A text with very many copies fills several ranges: splitters also cut by identifier. Exactly then its key equals a
splitter's, and the runs of such keys (at most a few per range) are joined afterwards by their full text.

Defined cases: a null text is empty, and empty texts are equal to each other; a null identifier counts as larger than
all others; rows with equal text and equal identifier are copies of one another and all bear the identifier that stays
(``kept`` is true for one of them); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmill.llm.shared import documents
from riskmill.session import materialize

KEY_BYTES = 24
SAMPLES_PER_RANGE = 24
RANGES_PER_PARTITION = 4


def normalised(text: Column) -> Column:
    """Each run of tab, line feed, vertical tab, form feed, carriage return or space becomes one space."""
    spaces = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_replace(spaces, " {2,}", " ")


def splitters(rows: DataFrame, ranges: int) -> list[tuple]:
    """At most ``ranges`` - 1 keys (head, hash, doc_id) that cut the rows into about equal parts.

    The sample has about ``SAMPLES_PER_RANGE`` rows per range, whatever the table's size.
    """
    total = rows.count()
    if not total:
        return []
    share = min(1.0, SAMPLES_PER_RANGE * ranges / total)
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    keys = sorted(
        tuple(r) for r in sample.select("head", "hash", F.coalesce("doc_id", F.lit(2**63 - 1))).collect()
    )
    cuts = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    return sorted(set(cuts))


def range_of(cuts: list[tuple]) -> Column:
    """Number of splitters that do not lie above the row's key, by halving."""
    if not cuts:
        return F.lit(0)
    listed = F.from_json(
        F.lit(json.dumps([{"head": a, "hash": b, "doc_id": c} for a, b, c in cuts])),
        "array<struct<head:string,hash:bigint,doc_id:bigint>>",
    )
    key = F.struct(F.col("head"), F.col("hash"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])

    def halve(low, step):
        at = low + step
        return F.when((at <= F.lit(len(cuts))) & (F.get(listed, at - 1) <= key), at).otherwise(low)

    return F.aggregate(steps, F.lit(0), halve)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("body"))
    rows = rows.select(
        "doc_id", "body", F.hex(F.substring(F.encode("body", "utf-8"), 1, KEY_BYTES)).alias("head"),
        F.xxhash64("body").alias("hash"),
    )
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(rows, ranges)
    dense = sorted({(a, b) for a, b, _ in cuts})
    across = F.concat_ws("|", "head", F.col("hash").cast("string")).isin([f"{a}|{b}" for a, b in dense])
    ranged = rows.withColumn("range", range_of(cuts)).withColumn("across", across)

    order = Window.partitionBy("range").orderBy("head", "hash", "body", F.col("doc_id").asc_nulls_last())
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    runs = ranged.withColumn(
        "first", F.coalesce(F.lag("body").over(order) != F.col("body"), F.lit(True))
    ).withColumn("run", F.sum(F.col("first").cast("int")).over(running))
    narrow = runs.select(
        "range", "run", "doc_id", "first", "across", F.sha2(F.encode("body", "utf-8"), 256).alias("text_sha256"),
        F.when(F.col("first") & F.col("across"), F.col("body")).alias("body"),
    )
    same = Window.partitionBy("range", "run")
    placed = materialize(narrow.select(
        "*", F.min("doc_id").over(same).alias("least"), F.count("*").over(same).alias("n")
    ), "exact-runs")

    # Runs whose text goes on in other ranges: at most a few for each range.
    parts = placed.where("body IS NOT NULL").select("range", "run", "body", "least", "n")
    whole = parts.groupBy("body").agg(
        F.min("least").alias("all_least"), F.sum("n").alias("all_n"),
        F.min(F.struct(F.coalesce("least", F.lit(2**63 - 1)).alias("least"), "range", "run")).alias("holder"),
    )
    joined = parts.join(whole, "body").select(
        "range", "run", "all_least", "all_n",
        ((F.col("holder.range") == F.col("range")) & (F.col("holder.run") == F.col("run"))).alias("holds"),
    )
    out = placed.drop("body").join(F.broadcast(joined), ["range", "run"], "left")
    keep = F.when(F.col("all_n").isNull(), F.col("least")).otherwise(F.col("all_least"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("all_n", "n").alias("group_size"),
        (F.col("first") & F.coalesce("holds", F.lit(True))).alias("kept"), "text_sha256",
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """One row of every group of equal texts, with all its columns (the smallest doc_id).

    A row stays if its identifier and text are those kept; of rows that agree in both, one stays. Rows without an
    identifier are told apart by their text. Columns of any name come back as they were.
    """
    taken = {c.lower() for c in docs.columns}
    sha, keep, same, nth = (next(f"{n}{i}" for i in range(len(taken) + 1) if f"{n}{i}" not in taken)
                            for n in ("_sha", "_keep", "_same", "_nth"))
    kept = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias(keep), F.col("text_sha256").alias(same))
    keyed = docs.withColumn(sha, F.sha2(F.encode(normalised(docs["text"]), "utf-8"), 256))
    stays = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col(keep)) & (F.col(sha) == F.col(same)), "left_semi")
    once = Window.partitionBy("doc_id", sha).orderBy(sha)
    return stays.withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1).drop(sha, nth)
