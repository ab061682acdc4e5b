"""Packing of documents into few sequences of bounded length, by linear grouping.

A document is its ids and an end mark. Only documents longer than a sequence are cut: whole sequences from the end,
the rest is the first piece. What is decided centrally is decided on the histogram of piece lengths, which has at
most ``size`` rows however many documents there are:

1. Pieces above ``small`` are sorted by length and cut into groups of equal cardinality; within a group every length
   counts as the longest one (rounded up).
2. The few rounded sizes are packed by configurations (multisets that fit a sequence): column generation on the
   linear programme, with a knapsack over the dual prices, then rounded down; what remains is packed best-fit.
3. Actual lengths replace the rounded ones, slot by slot in order of length, so the bins of one configuration fall
   into few classes of equal content.
4. The small pieces go into the freed room by best fit, longest first.

Every class of bins then owns runs of ranks of each length. Pieces get their rank within their length from a
distributed count (length, bucket of the key), and a sorted search in the runs gives sequence and offset. No group of
pieces is gathered anywhere.

Defined cases: a null or empty text is one piece, the end mark alone; repeated rows are packed as pieces of their own; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmill.llm.bpe import codec, vocabulary
from riskmill.llm.shared import documents, in_slices, with_fields
from riskmill.session import materialize

SIZE = 1024
END = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Packing:
    """``groups`` rounded sizes for pieces longer than ``small``; the column generation ends within
    ``slack`` of the linear optimum, or after ``rounds``."""

    size: int = SIZE
    small: int = 256
    groups: int = 96
    rounds: int = 1500
    slack: float = 1e-3


@dataclass
class Bins:
    """``count`` equal bins: lengths with their multiplicity, and the room left."""

    count: int
    room: int
    content: list[tuple[int, int]] = field(default_factory=list)

    def with_more(self, count: int, length: int, times: int) -> Bins:
        return Bins(count, self.room - length * times, [*self.content, (length, times)])


def cut(docs: DataFrame, path: str, size: int = SIZE, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, with ``ids`` if ``keep_ids``."""
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids
    last = np.array([end], "<u4")

    def make(doc_ids, texts):
        out = {name: [] for name, _ in fields}
        for doc_id, encoded in zip(doc_ids, codec(content.value).encode_many(texts), strict=True):
            ids = np.concatenate([encoded, last])
            first = len(ids) % size or size
            for piece, to in enumerate(range(first, len(ids) + 1, size)):
                start = max(0, to - size) if piece else 0
                part = ids[start:to]
                values = (doc_id, piece, start, to - start, zlib.crc32(part), part.astype(np.int32) if keep_ids else None)
                for (name, _), value in zip(fields, values, strict=False):
                    out[name].append(value)
        return out

    return documents(docs).mapInArrow(in_slices(make, pa.schema(fields)), PIECES + ", ids array<int>" * keep_ids)


def equal_groups(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Cuts (length, count), longest first, into groups of equal cardinality; a length may fall into several."""
    total = sum(n for _, n in lengths)
    each = -(-total // groups) if total else 0
    out, room = [], 0
    for length, n in lengths:
        while n:
            if not room:
                out.append([])
                room = each
            took = min(room, n)
            out[-1].append((length, took))
            room -= took
            n -= took
    return out


def configurations(sizes: list[int], wanted: list[int], how: Packing) -> list[tuple[np.ndarray, float]]:
    """Configurations (how many of each size) and how often each is used, from the linear programme.

    Starts from bins of one size. Each round prices the sizes by the current basis and looks, by a knapsack over the
    length, for a configuration worth more than one bin.
    """
    n, size = len(sizes), how.size
    s, demand = np.array(sizes), np.array(wanted, float)
    basis = np.diag([size // x for x in sizes]).astype(float)
    used = demand / np.diag(basis)
    for _ in range(how.rounds):
        inverse = np.linalg.inv(basis)
        prices = np.ones(n) @ inverse
        best, pick = np.zeros(size + 1), np.full(size + 1, -1)
        for room in range(int(s.min()), size + 1):
            fit = np.flatnonzero(s <= room)
            worth = best[room - s[fit]] + prices[fit]
            k = int(worth.argmax())
            best[room], pick[room] = worth[k], fit[k]
            if best[room - 1] >= best[room]:
                best[room], pick[room] = best[room - 1], -1
        if best[size] <= 1 + how.slack:
            break
        column, room = np.zeros(n), size
        while room > 0:
            if pick[room] < 0:
                room -= 1
            else:
                column[pick[room]] += 1
                room -= int(s[pick[room]])
        step = inverse @ column
        rising = step > 1e-9
        ratio = np.where(rising, used / np.where(rising, step, 1), np.inf)
        leave = int(ratio.argmin())
        used = np.maximum(used - ratio[leave] * step, 0)
        used[leave] = ratio[leave]
        basis[:, leave] = column
    return [(basis[:, j].astype(int), float(used[j])) for j in range(n)]


def best_fit(bins: list[Bins], lengths: list[tuple[int, int]], size: int) -> list[Bins]:
    """Adds (length, count), longest first, each to the fullest bin that has room, else to a new one."""
    by_room: dict[int, list[Bins]] = {}
    for b in bins:
        by_room.setdefault(b.room, []).append(b)
    for length, n in sorted(lengths, reverse=True):
        for room in sorted(r for r in by_room if r >= length):
            times = room // length
            kept = []
            while n and by_room[room]:
                b = by_room[room].pop()
                full = min(b.count, n // times)
                parts = [b.with_more(full, length, times)] if full else []
                n -= full * times
                left = b.count - full
                if left and n and n < times:
                    parts.append(b.with_more(1, length, n))
                    left, n = left - 1, 0
                if left:
                    kept.append(Bins(left, b.room, b.content))
                for p in parts:
                    by_room.setdefault(p.room, []).append(p)
            by_room[room] += kept
            if not n:
                break
        if n:
            times = size // length
            for count, k in ((n // times, times), (1, n % times)):
                if count and k:
                    by_room.setdefault(size - k * length, []).append(Bins(count, size - k * length, [(length, k)]))
    return [b for same in by_room.values() for b in same]


def plan(histogram: dict[int, int], how: Packing = Packing()) -> list[Bins]:
    """Classes of equal bins that hold every length of the histogram as often as it occurs."""
    whole = [Bins(histogram[how.size], 0, [(how.size, 1)])] if histogram.get(how.size) else []
    rest = sorted(((x, n) for x, n in histogram.items() if x < how.size and n), reverse=True)
    groups = equal_groups([p for p in rest if p[0] > how.small], how.groups)
    merged: dict[int, list[tuple[int, int]]] = {}
    for g in groups:
        merged.setdefault(g[0][0], []).extend(g)
    sizes = sorted(merged, reverse=True)
    bins, small = [], [p for p in rest if p[0] <= how.small]
    if sizes:
        # Within a group the longest go first, so that the bins of a configuration stay alike.
        queues = {x: [list(p) for p in merged[x]] for x in sizes}
        wanted = [sum(n for _, n in merged[x]) for x in sizes]
        for column, used in configurations(sizes, wanted, how):
            bins += _substitute(column, int(used + 1e-6), sizes, queues, how.size)
        small += [(x, n) for q in queues.values() for x, n in q if n]
    counted: dict[int, int] = {}
    for x, n in small:
        counted[x] = counted.get(x, 0) + n
    return whole + best_fit(bins, list(counted.items()), how.size)


def _substitute(column, times: int, sizes, queues, size: int) -> list[Bins]:
    """``times`` bins of a configuration, filled with actual lengths; bins of equal content are one class."""
    out = []
    slots = [(sizes[i], int(k)) for i, k in enumerate(column) if k]
    while times:
        # So many bins take the same lengths: each slot's size has that many of its next length left.
        run, content = times, []
        for x, k in slots:
            head = next((p for p in queues[x] if p[1]), None)
            if head is None or head[1] < k:
                run = 0
                break
            run = min(run, head[1] // k)
        if run:
            for x, k in slots:
                head = next(p for p in queues[x] if p[1])
                head[1] -= run * k
                content.append((head[0], k))
        else:  # one bin across the border of two lengths
            run = 1
            for x, k in slots:
                for p in queues[x]:
                    took = min(k, p[1])
                    if took:
                        p[1] -= took
                        k -= took
                        content.append((p[0], took))
        if not content:
            break
        out.append(Bins(run, size - sum(a * b for a, b in content), content))
        times -= run
    return out


def slots(bins: list[Bins]) -> dict[str, np.ndarray]:
    """For each class of bins and each length in it: the first rank it takes, and where those pieces lie."""
    rows, taken, sequence = [], {}, 0
    for b in bins:
        offset = 0
        for length, times in b.content:
            rows.append((length, taken.get(length, 0), times, sequence, offset))
            taken[length] = taken.get(length, 0) + times * b.count
            offset += times * length
        sequence += b.count
    rows.sort()
    names = ("length", "first", "times", "sequence", "offset")
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(names)}


def place(pieces: DataFrame, how: Packing = Packing()) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``.

    ``pieces`` is read several times, so it should be a written table. The histogram (at most ``size`` rows) and the
    runs of ranks derived from it are all that the driver sees.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = slots(plan(counts, how))
    shared = spark.sparkContext.broadcast(runs)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts))
    keyed = pieces.withColumn("_bucket", bucket)
    sums = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = (
        keyed.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(starts, ["length", "_bucket"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .drop("_before", "_bucket")
    )
    names = pieces.columns
    schema = with_fields(pieces.schema, sequence_id="long", offset="long")

    def run(batches):
        r = shared.value
        borders = np.array([(a, b) for a, b in zip(r["length"], r["first"], strict=True)],
                           [("l", np.int64), ("f", np.int64)])
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            wanted = np.empty(batch.num_rows, borders.dtype)
            wanted["l"], wanted["f"] = batch.column("length").to_numpy(), rank
            k = np.searchsorted(borders, wanted, "right") - 1
            nth = rank - r["first"][k]
            sequence = r["sequence"][k] + nth // r["times"][k]
            offset = r["offset"][k] + nth % r["times"][k] * r["length"][k]
            columns = [batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, how: Packing = Packing(), end: int = END, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document with their place: cut, written to the shared folder, placed."""
    return place(materialize(cut(docs, path, how.size, end, keep_ids), "pieces"), how)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of placed pieces with ids: at most one sequence's pieces per group."""
    return (
        packed.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"))
    )
