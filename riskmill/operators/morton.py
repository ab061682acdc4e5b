"""Order along a space-filling curve, so that rows close in several numeric columns get close codes.

Coordinates are cut into equal steps of one common width and their bits interleaved (Morton order). Two close rows may
still lie on both sides of a large cell's border; on grids shifted by fractions of the range, one of the orders has
them close together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.functions.scalars import q

CODE_BITS, MOST_BITS = 62, 52


def ranges(df: DataFrame, columns) -> list[tuple[float, float]]:
    """Smallest and largest value of each column; (0, 0) without any."""
    row = df.agg(*[F.struct(F.min(q(c)), F.max(q(c))).alias(f"r{i}") for i, c in enumerate(columns)]).first()
    return [tuple(float(x or 0.0) for x in row[f"r{i}"]) for i in range(len(columns))]


def _spread(byte: int, m: int) -> int:
    """The bits of a byte, ``m`` places apart."""
    return sum((byte >> k & 1) << (k * m) for k in range(8))


def _interleaved(steps: list[Column], bits: int) -> Column:
    """Bits of the columns in turn, the first column's above the others'."""
    m = len(steps)
    table = F.lit([_spread(b, m) for b in range(256)]).cast("array<bigint>")
    terms = []
    for i, x in enumerate(steps):
        for k in range(0, bits, 8):
            byte = F.shiftright(x, k).bitwiseAND(F.lit((1 << min(8, bits - k)) - 1)).cast("int")
            terms.append(F.shiftleft(F.get(table, byte), k * m + m - 1 - i))
    return reduce(lambda a, b: a.bitwiseOR(b), terms)


def morton_code(columns, spans: list[tuple[float, float]], shift: float = 0.0) -> list[Column]:
    """Two numbers below 2^62 whose order, the first before the second, is that of the curve.

    ``shift`` (0 to 1) moves the grid by a share of the widest column's range. Together the numbers hold up to 52 bits
    of each column, so that crowds stay in order beside far outliers.
    """
    each = CODE_BITS // len(columns)
    if not each:
        raise ValueError(f"at most {CODE_BITS} columns have a place in a code")
    total = min(2 * each, MOST_BITS)
    low = max(0, total - each)
    width = max((hi / 2 - lo / 2 for lo, hi in spans), default=0.0) * 2 or 1.0
    steps = [
        F.least(
            F.greatest(F.floor(((q(c) - F.lit(lo)) / F.lit(width) + F.lit(shift)) * F.lit(2.0 ** (total - 1))), F.lit(0)),
            F.lit((1 << total) - 1),
        ).cast("bigint")
        for c, (lo, _) in zip(columns, spans, strict=True)
    ]
    high = _interleaved([F.shiftright(x, low) for x in steps], total - low)
    if not low:
        return [high, F.lit(0).cast("bigint")]
    return [high, _interleaved([x.bitwiseAND(F.lit((1 << low) - 1)) for x in steps], low)]
