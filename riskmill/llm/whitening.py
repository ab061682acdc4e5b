"""Embedding whitening by QDWH spectral divide-and-conquer.

Vectors become integers (64 times each entry, rounded down, plus 1,000,000), whose sums are exact.

1. One scan gives the number of vectors and the exact sum of every dimension; a second one the covariance, of entries
   centred before they are multiplied (the integer part of the mean is taken off exactly).
2. The covariance is a matrix as wide as a vector. Its spectrum is divided on the driver: the polar factor of the
   covariance shifted by a point inside the spectrum, from the QR-based dynamically weighted Halley iteration, is the
   matrix sign; (sign + 1) / 2 projects on the components above the point. A QR factorisation of the projector times a
   fixed random matrix gives bases of both invariant subspaces, and each is divided in turn, until one direction is left
   or a block is a multiple of the identity.
3. Centre, directions and scales are broadcast (as wide as a vector times the number of components), and every vector is
   projected. A third scan measures the covariance of what comes out.

Defined cases: a vector is left out if it is null or holds a null, NaN, infinite entry, or one whose integer doesn't fit 62
bits; empty vectors have no components. Vectors of several lengths are as many fit lists, each whitened for itself. A null
identifier is kept, rows that repeat one count each. A component without variance (constant entries, fewer vectors than
dimensions, a single vector) has ``whitened`` null; ``explained`` is null if nothing varies, ``identity_error`` is over the
components that vary and null without any. ``deviation`` is null where it doesn't fit a long. Equal eigenvalues get
some orthonormal basis of their space. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
#: Rows that numpy holds at once, and the bound of a scaled entry.
ROWS, LARGEST = 4096, 2.0**61


@dataclass(frozen=True)
class Whitening:
    components: int = 32
    #: A component varies if its eigenvalue is above this share of the largest one, times the width.
    least: float = 2.0**-50


@dataclass(frozen=True)
class Fitted:
    """One vector length: ``n`` vectors with ``sums``; eigenvalues (falling) and directions in columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    varying: int
    error: float | None = None

    @property
    def scales(self) -> np.ndarray:
        """Directions over the root of their eigenvalue, of the varying components."""
        return self.directions[:, : self.varying] / np.sqrt(self.values[: self.varying])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that stay, as doubles."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fits = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / SCALE))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(fits, F.lit(False)))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most ``ROWS`` rows with vectors of one length, and their integers as a matrix."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            length = np.asarray(part.column("v").value_lengths())
            for d in np.unique(length):
                own = part if (length == d).all() else part.filter(pa.array(length == d))
                c = own.column("v").flatten().to_numpy().reshape(-1, d)
                yield own, np.floor(SCALE * c).astype(np.int64) + OFFSET


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums as Python integers, also where they leave 64 bits."""
    bound = int(np.abs(x).max()) * len(x)
    return [int(s) for s in (x if bound < 1 << 62 else x.astype(object)).sum(0)]


def counted(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per vector length the number of vectors and the exact sum of every dimension."""
    schema = pa.schema([("d", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("s", pa.decimal128(38, 0))])

    def run(batches):
        held: dict[int, tuple[int, list[int]]] = {}
        for _, x in blocks(batches):
            n, sums = held.get(x.shape[1], (0, [0] * x.shape[1]))
            held[x.shape[1]] = n + len(x), [a + b for a, b in zip(sums, exact_sums(x), strict=True)]
        for d, (n, sums) in held.items():
            columns = {"d": [d] * d, "j": list(range(d)), "n": [n] * d, "s": [Decimal(s) for s in sums]}
            yield pa.RecordBatch.from_pydict(columns, schema=schema)

    parts = rows.mapInArrow(run, "d int, j int, n long, s decimal(38, 0)")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("d", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("d", "j").collect():
        out.setdefault(r["d"], (int(r["n"]), []))[1].append(int(r["s"]))
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n in double precision: whole parts are subtracted as integers first."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def cross_products(rows: DataFrame, given: dict[int, tuple[int, list[int], np.ndarray | None]]) -> dict[int, np.ndarray]:
    """Per vector length the mean product of every two columns of the centred vectors.

    ``given`` has per length n, sums and, if not None, a matrix that the centred vectors are multiplied by first. A task
    returns the upper triangle of one sum; those are added up in the cluster.
    """
    shared = rows.sparkSession.sparkContext.broadcast(given)
    schema = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())])

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for _, x in blocks(batches):
            n, sums, by = shared.value[x.shape[1]]
            y = centred(x, n, sums)
            y = y if by is None else y @ by
            held[x.shape[1]] = held.get(x.shape[1], 0) + y.T @ y
        for d, product in held.items():
            i, j = np.triu_indices(len(product))
            columns = [pa.array(np.full(len(i), d, np.int32)), pa.array(i, pa.int32()), pa.array(j, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(product[i, j])], schema=schema)

    parts = rows.mapInArrow(run, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s"))
    told = parts.toArrow()
    lengths, i, j, s = (told.column(c).to_numpy() for c in "dijs")
    out: dict[int, np.ndarray] = {}
    for d, (n, _, by) in given.items():
        width, own = d if by is None else by.shape[1], lengths == d
        out[d] = matrix = np.zeros((width, width))
        matrix[i[own], j[own]] = matrix[j[own], i[own]] = s[own] / n
    return out


def polar(a: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix, by the QR-based dynamically weighted Halley iteration.

    ``low`` bounds the smallest singular value of the iterate from below and rises to 1; a matrix that is singular to
    working precision takes some rounds more.
    """
    d = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / (np.sqrt(d) * np.linalg.norm(np.linalg.inv(x), 1))
    except np.linalg.LinAlgError:
        low = 0.0
    low, one = min(max(low, 1e-17), 1.0), np.eye(d)
    for _ in range(rounds):
        r = np.cbrt(4 * (1 - low**2) / low**4)
        s = np.sqrt(1 + r)
        u = s + np.sqrt(max(0.0, 8 - 4 * r + 8 * (2 - low**2) / (low**2 * s))) / 2
        v = (u - 1) ** 2 / 4
        w = u + v - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(w) * x, one]))
        after = v / w * x + (u - v / w) / np.sqrt(w) * (q[:d] @ q[d:].T)
        after = (after + after.T) / 2
        low = min(1.0, low * (u + v * low**2) / (1 + w * low**2))
        moved = np.linalg.norm(after - x)
        x = after
        if moved <= 1e-9 * np.sqrt(d) and 1 - low < 1e-9:
            break
    return x


def split(a: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, int] | None:
    """(basis, matrix in that basis, k): the first k directions and the others are invariant subspaces.

    None if the block is a multiple of the identity within ``tolerance``.
    """
    d = len(a)
    mean = np.trace(a) / d
    spread = np.linalg.norm(a - mean * np.eye(d))
    if d == 1 or spread <= tolerance:
        return None
    draws = np.random.default_rng(d)
    mix = draws.standard_normal((d, d))
    # Eigenvalues lie on both sides of their mean; other points serve where one lies on the point itself.
    points = [np.median(a.diagonal()), mean, *(mean + spread / np.sqrt(d) * draws.uniform(-1, 1, 30))]
    for point in points:
        sign = polar(a - point * np.eye(d))
        rank = (np.trace(sign) + d) / 2
        k = int(round(rank))
        if not 0 < k < d or abs(rank - k) > 1e-6:
            continue
        projector, basis = (sign + np.eye(d)) / 2, mix
        for _ in range(3):
            # Of the projector's image, the first k directions span its range, and the others what it takes to zero.
            basis, _ = np.linalg.qr(projector @ basis)
            turned = basis.T @ a @ basis
            if np.linalg.norm(turned[k:, :k]) <= tolerance:
                return basis, (turned + turned.T) / 2, k
    raise ArithmeticError(f"a block of {d} directions could not be divided")


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (in columns) of a symmetric matrix, by dividing its spectrum."""
    tolerance = 8 * len(a) * np.finfo(float).eps * np.linalg.norm(a)
    open_blocks, done = [(a, np.eye(len(a)))], []
    while open_blocks:
        block, within = open_blocks.pop()
        parts = split(block, tolerance)
        if parts is None:
            done.append(within)
            continue
        basis, turned, k = parts
        open_blocks.append((turned[:k, :k], within @ basis[:, :k]))
        open_blocks.append((turned[k:, k:], within @ basis[:, k:]))
    vectors, _ = np.linalg.qr(np.hstack(done))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    # Of the two signs, that with the largest entry above zero.
    leading = vectors[np.abs(vectors).argmax(0), np.arange(len(a))]
    return values, vectors * np.where(leading < 0, -1.0, 1.0)


def fit(rows: DataFrame, how: Whitening = Whitening()) -> dict[int, Fitted]:
    """The whitening of every vector length among ``rows`` (vec_id, v), with its measured identity error."""
    sums = counted(rows)
    covariance = cross_products(rows, {d: (n, s, None) for d, (n, s) in sums.items()})
    out = {}
    for d, (n, s) in sums.items():
        values, vectors = spectrum(covariance[d])
        k = min(how.components, d)
        varying = int((values[:k] > how.least * d * values[0]).sum()) if values[0] > 0 else 0
        out[d] = Fitted(n, s, values, vectors[:, :k], varying)
    measured = cross_products(rows, {d: (f.n, f.sums, f.scales) for d, f in out.items()})
    for d, f in out.items():
        if f.varying:
            error = float(np.abs(measured[d] - np.eye(f.varying)).max())
            out[d] = replace(f, error=error)
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over the dimensions of (n x - S) squared; None where one doesn't fit a long."""
    apart = x - np.array([s // n for s in sums], np.int64)
    over = np.array([s % n for s in sums])
    bound = n * (int(np.abs(apart).max()) + 1)
    if bound * bound * x.shape[1] < 1 << 63:
        return ((n * apart - over) ** 2).sum(1).tolist()
    exact = ((n * apart.astype(object) - over.astype(object)) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whitened(
    vectors: DataFrame, how: Whitening = Whitening(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector and component.

    ``vectors`` is read four times, so it should be a table.
    """
    rows = usable(vectors, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    fitted = rows.sparkSession.sparkContext.broadcast(fit(rows, how))

    def run(batches):
        for batch, x in blocks(batches):
            f = fitted.value[x.shape[1]]
            rows, k = x.shape[0], f.directions.shape[1]
            scores = np.zeros((rows, k))
            scores[:, : f.varying] = centred(x, f.n, f.sums) @ f.scales
            total = f.values.sum()
            shares = np.maximum(f.values[:k], 0) / (total if total > 0 else 1)
            missing = np.tile(np.arange(k) >= f.varying, rows)
            of = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, f.n)),
                    pa.array(deviations(x, f.n, f.sums), pa.int64()).take(pa.array(of)),
                    pa.array(scores.ravel(), mask=missing),
                    pa.array(np.tile(shares, rows), mask=np.full(rows * k, not total > 0)),
                    pa.array([f.error] * (rows * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(
        run,
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double",
    )
