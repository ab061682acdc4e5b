"""Exact linearly interpolated quantiles in three scans, whatever the number of rows and their spread.

``percentile`` keeps every distinct value of a column in one task. Here

1. a sketch of every column, whose rank error is known, brackets each wanted rank between two values;
2. every bracket is sketched again by itself, and its rows and those below are counted, which brackets the rank
   within some millionths of the rows;
3. rows are counted between these narrow intervals and listed, by value, inside them.

The third scan counts the whole column, so it shows whether a wanted rank really lies in its interval. Should a
sketch have erred, the part that holds the rank is searched the same way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.functions.scalars import q

#: A sketched rank is off by at most rows / ACCURACY; a bracket is cut at STEPS - 1 sketched places.
ACCURACY, STEPS = 10_000, 64
INF = math.inf


def _value(column: str) -> Column:
    number = q(column).cast("double")
    return F.when(~F.isnan(number), number)


def _sketch(value: Column, probs) -> Column:
    listed = ", ".join(f"{min(max(p, 0.0), 1.0)!r}D" for p in probs)
    return F.percentile_approx(value, F.expr(f"array({listed})"), ACCURACY)


def _joined(intervals) -> list[tuple[float, float]]:
    """The intervals in order, those that touch as one."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _brackets(df: DataFrame, ranks: dict[str, list[int]], sizes: dict[str, int]) -> dict:
    """First scan: two values around each rank of each column."""
    margin = 2 / ACCURACY
    probs = {c: [r / max(1, sizes[c] - 1) for r in own] for c, own in ranks.items()}
    row = df.agg(*[
        F.struct(_sketch(_value(c), [p - margin for p in own]).alias("lo"),
                 _sketch(_value(c), [p + margin for p in own]).alias("hi")).alias(f"s{i}")
        for i, (c, own) in enumerate(probs.items())
    ]).first()
    out = {}
    for i, (c, own) in enumerate(probs.items()):
        out[c] = [
            (lo if p > margin else -INF, hi if p < 1 - margin else INF)
            for p, lo, hi in zip(own, row[f"s{i}"]["lo"], row[f"s{i}"]["hi"], strict=True)
        ]
    return out


def _cells(df: DataFrame, intervals: dict) -> DataFrame:
    """A row per value of each column: the column's number, how many intervals begin up to it, itself if inside one."""
    def cell(i: int, value: Column, own) -> Column:
        starts, ends = (F.lit(list(side)).cast("array<double>") for side in zip(*own, strict=True))
        gap = F.size(F.filter(starts, lambda s: s <= value))
        inside = F.coalesce(value <= F.get(ends, gap - 1), F.lit(False))
        return F.when(value.isNotNull(), F.struct(
            F.lit(i).alias("i"), gap.alias("gap"), F.when(inside, value).alias("value"), value.alias("seen")
        ))

    cells = [cell(i, _value(c), own) for i, (c, own) in enumerate(intervals.items())]
    return df.select(F.inline(F.array_compact(F.array(*cells))))


def _narrowed(df: DataFrame, ranks: dict[str, list[int]], brackets: dict) -> dict:
    """Second scan: for each rank an interval that a sketch of its bracket puts it in."""
    grid = [k / STEPS for k in range(1, STEPS)]
    # Brackets of neighbouring ranks overlap and are searched as one.
    whole = {c: _joined(own) for c, own in brackets.items()}
    long = _cells(df, {c: whole[c] for c in ranks})
    rows = long.groupBy("i", "gap").agg(
        F.count("*").alias("rows"), F.count("value").alias("n"), _sketch(F.col("value"), grid).alias("grid")
    ).collect()
    told = {}
    for i, c in enumerate(ranks):
        own = {r["gap"]: r for r in rows if r["i"] == i}
        for place, interval in enumerate(whole[c]):
            found = own.get(place + 1)
            below = sum(r["rows"] for gap, r in own.items() if gap <= place)
            told[c, interval] = {"below": below, "n": found["n"] if found else 0, "grid": found and found["grid"]}
    # The sketch's error on both sides, and a place more for rounding.
    slack = 2 + math.ceil(2 * STEPS / ACCURACY)
    out = {}
    for c, own in ranks.items():
        out[c] = []
        for rank, bracket in zip(own, brackets[c], strict=True):
            lo, hi = next(w for w in whole[c] if w[0] <= bracket[0] and bracket[1] <= w[1])
            facts = told[c, (lo, hi)]
            inside = rank - facts["below"]
            if not 0 <= inside < facts["n"]:
                # The first sketch was wrong. The counts at this border show where to go on.
                out[c].append((lo, lo) if inside < 0 else (hi, hi))
                continue
            place = inside * STEPS // max(1, facts["n"])
            first, last = place - slack, place + slack
            out[c].append((facts["grid"][first - 1] if first >= 1 else lo, facts["grid"][last - 1] if last < STEPS else hi))
    return out


def _listed(df: DataFrame, intervals: dict) -> dict[str, list[tuple]]:
    """Third scan: per column, in order, (lowest value, highest value, rows); single values inside the intervals.

    Some millionths of the rows per interval reach the driver, and as many counts as there are gaps between them.
    """
    long = _cells(df, intervals)
    counted = long.groupBy("i", "gap", "value").agg(
        F.min("seen").alias("lo"), F.max("seen").alias("hi"), F.count("*").alias("n")
    )
    names, out = list(intervals), {c: [] for c in intervals}
    for r in counted.collect():
        out[names[r["i"]]].append((r["lo"], r["hi"], r["n"], r["value"] is not None))
    return {c: sorted(parts, key=lambda p: (p[0], p[1])) for c, parts in out.items()}


def order_statistics(df: DataFrame, wanted: dict[str, set[int]], sizes: dict[str, int]) -> dict:
    """Value at each 0-based rank of each column; ``sizes`` gives the number of values per column."""
    found: dict[tuple[str, int], float] = {}
    ranks = {c: sorted(own) for c, own in wanted.items() if own}
    brackets = _brackets(df, ranks, sizes) if ranks else {}
    while ranks:
        narrow = _narrowed(df, ranks, brackets)
        parts = _listed(df, {c: _joined(own) for c, own in narrow.items()})
        left: dict[str, list[int]] = {}
        after: dict[str, list[tuple[float, float]]] = {}
        for c, own in ranks.items():
            for rank in own:
                before = 0
                for lo, hi, n, single in parts[c]:
                    if rank < before + n:
                        break
                    before += n
                if single or lo == hi:
                    found[c, rank] = lo
                else:
                    left.setdefault(c, []).append(rank)
                    after.setdefault(c, []).append((lo, hi))
        ranks, brackets = left, after
    return found


def exact_quantiles(df: DataFrame, columns, probs, bounds: dict | None = None) -> dict:
    """``{column: [quantile per prob]}``; None for a column without values.

    ``bounds`` may pass in what is known: the number of values, or a tuple that begins with it, per column.
    """
    columns = list(columns)
    if bounds is None:
        row = df.agg(*[F.count(_value(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        sizes = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    else:
        sizes = {c: bounds[c][0] if isinstance(bounds[c], tuple) else bounds[c] for c in columns}
    places = {c: [(sizes[c] - 1) * p for p in probs] for c in columns if sizes[c]}
    wanted = {c: {f(x) for x in pos for f in (math.floor, math.ceil)} for c, pos in places.items()}
    found = order_statistics(df, wanted, sizes)
    result = {}
    for c in columns:
        if c not in places:
            result[c] = [None] * len(probs)
            continue
        values = []
        for x in places[c]:
            lo, hi = (found[c, f(x)] for f in (math.floor, math.ceil))
            values.append(lo if lo == hi else lo + (hi - lo) * (x - math.floor(x)))
        result[c] = values
    return result
