"""Whitening beside exact integers and a library's eigenvectors; the divided spectrum by its residuals."""

from fractions import Fraction
from math import floor, inf, nan, sqrt

import numpy as np
import pytest

from riskmill.llm import whitening
from riskmill.llm.whitening import Whitening

COLUMNS = "vec_id long, embedding array<double>, label int, v string, component string"


def frame(spark, rows, columns=COLUMNS):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], columns)


def brute(rows, components=32):
    """(vec_id, component) -> n, deviation, whitened, explained, in exact fractions up to the eigenvectors."""
    rows = [(i, [floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    n, d = len(rows), len(rows[0][1])
    sums = [sum(x[j] for _, x in rows) for j in range(d)]
    away = [[Fraction(n * x[j] - sums[j], n) for j in range(d)] for _, x in rows]
    y = np.array([[float(a) for a in row] for row in away])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for (i, x), row in zip(rows, y, strict=True):
        deviation = sum((n * x[j] - sums[j]) ** 2 for j in range(d))
        for c in range(min(components, d)):
            out[i, c + 1] = n, deviation, float(row @ vectors[:, c]) / sqrt(values[c]), values[c] / values.sum()
    return out


def agree(found, wanted):
    assert {(r["vec_id"], r["component"]) for r in found} == set(wanted)
    flip = {}
    for r in found:
        n, deviation, whitened, explained = wanted[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["explained"] == pytest.approx(explained, rel=1e-9) and r["identity_error"] < 1e-9
        if abs(whitened) > 1e-3:
            flip.setdefault(r["component"], r["whitened"] * whitened > 0)
        assert r["whitened"] == pytest.approx(whitened if flip.get(r["component"], True) else -whitened, abs=1e-8)


def test_equals_exact_integers_and_library_directions(spark):
    draws = np.random.default_rng(1)
    x = draws.standard_normal((300, 7)) @ draws.standard_normal((7, 7)) * 40 + draws.standard_normal(7) * 1000
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    agree(whitening.whitened(frame(spark, rows).repartition(5)).collect(), brute(rows))
    agree(whitening.whitened(frame(spark, rows), Whitening(components=3)).collect(), brute(rows, 3))


def test_rows_that_stay_out_and_repeats(spark):
    good = [(1, [1.0, 2.0]), (2, [3.0, -4.5]), (None, [0.5, 0.25]), (3, [8.0, 1.0]), (3, [9.0, 1.0])]
    bad = [(10, None), (11, [1.0, None]), (12, [nan, 1.0]), (13, [1.0, inf]), (14, [-inf, 1.0]), (15, []),
           (16, [1e300, 0.0])]
    found = whitening.whitened(frame(spark, good + bad)).collect()
    assert len(found) == 10 and {r["vec_id"] for r in found} == {1, 2, 3, None} and {r["n"] for r in found} == {5}
    x = np.array([[floor(64 * c) for c in v] for _, v in good])
    spread = {c: sorted(r["whitened"] for r in found if r["component"] == c) for c in (1, 2)}
    for c in (1, 2):
        assert np.mean(spread[c]) == pytest.approx(0, abs=1e-12) and np.var(spread[c]) == pytest.approx(1)
    assert {r["deviation"] for r in found} == {int(((5 * row - x.sum(0)) ** 2).sum()) for row in x}


def test_no_variance_few_rows_and_several_lengths(spark):
    same = whitening.whitened(frame(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same] == [(None, None, None, 0)] * 4
    # Two vectors vary in one direction, whatever the width.
    two = whitening.whitened(frame(spark, [(1, [2.0, 3.0, 4.0]), (2, [2.5, 3.0, 4.0])])).collect()
    assert sorted(r["whitened"] for r in two if r["component"] == 1) == pytest.approx([-1.0, 1.0])
    assert all(r["whitened"] is None for r in two if r["component"] > 1) and len(two) == 6
    assert {r["explained"] for r in two if r["component"] == 1} == {1.0}
    mixed = whitening.whitened(frame(spark, [(1, [1.0]), (2, [2.0]), (3, [4.0, 1.0]), (4, [1.0, 2.0]), (5, [0.0, 0.0])]))
    assert {(r["vec_id"], r["n"]) for r in mixed.collect()} == {(1, 2), (2, 2), (3, 3), (4, 3), (5, 3)}
    assert whitening.whitened(frame(spark, [(1, None)])).collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(1, [3e13, 1.0]), (2, [-3e13, 2.0]), (3, [1e10, -5.0])]
    wanted = brute(rows)
    for r in whitening.whitened(frame(spark, rows)).collect():
        deviation = wanted[r["vec_id"], 1][1]
        assert r["deviation"] == (deviation if deviation < 1 << 63 else None)
    small = [(1, [1e7, 1.0]), (2, [-1e7, 2.0]), (3, [1e5, -5.0])]
    assert all(r["deviation"] == brute(small)[r["vec_id"], 1][1] for r in whitening.whitened(frame(spark, small)).collect())


@pytest.mark.parametrize("d", [1, 2, 3, 17, 80])
@pytest.mark.parametrize("kind", ["random", "ties", "rank", "spread", "identity"])
def test_divided_spectrum(d, kind):
    draws = np.random.default_rng(d)
    turn, _ = np.linalg.qr(draws.standard_normal((d, d)))
    values = {
        "random": draws.uniform(0, 5, d), "ties": np.arange(d) // 3 + 1.0, "rank": np.maximum(np.arange(d) - d // 2, 0.0),
        "spread": 10.0 ** -np.linspace(0, 9, d), "identity": np.full(d, 2.0),
    }[kind]
    a = turn @ np.diag(values) @ turn.T
    a = (a + a.T) / 2
    found, vectors = whitening.spectrum(a)
    top = max(values.max(), 1)
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-13 * d * top
    assert np.linalg.norm(a @ vectors - vectors * found) <= 1e-13 * d * top
    assert np.linalg.norm(vectors.T @ vectors - np.eye(d)) <= 1e-12


def test_polar_factor_is_the_sign():
    draws = np.random.default_rng(3)
    turn, _ = np.linalg.qr(draws.standard_normal((9, 9)))
    values = np.array([-3.0, -1e-9, 1e-12, 2.0, 5.0, -7.0, 1.0, 4.0, -0.5])
    sign = whitening.polar((turn * values) @ turn.T)
    assert np.abs(sign - (turn * np.sign(values)) @ turn.T).max() < 1e-3
    assert np.abs(sign @ sign - np.eye(9)).max() < 1e-12


def test_given_embeddings(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.select("vec_id", "embedding").collect()]
    agree(whitening.whitened(table).collect(), brute(rows))
