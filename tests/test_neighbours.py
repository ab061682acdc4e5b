import numpy as np
import pytest

from riskmill.operators import neighbours, prefix
from riskmill.operators.morton import morton_code, ranges
from riskmill.operators.neighbours import nearest_rows


def brute(rows, m, cost, k):
    """Nearest keys by full comparison; rows are (key, numbers..., nominal...)."""
    rows = sorted(rows)
    keys = [r[0] for r in rows]
    x = np.array([r[1 : 1 + m] for r in rows], dtype=float)
    names = np.array([[str(v) for v in r[1 + m :]] for r in rows], dtype=object).reshape(len(rows), -1)
    found = {}
    for i in range(len(rows)):
        dist = sum((x[i, j] - x[:, j]) * (x[i, j] - x[:, j]) for j in range(m))
        dist = dist + cost * (names[i] != names).sum(axis=1)
        order = np.lexsort((keys, dist))
        found[keys[i]] = [keys[j] for j in order if j != i][:k]
    return found


def check(spark, rows, schema, numeric, nominal, cost, k=5):
    df = spark.createDataFrame(rows, schema)
    got = nearest_rows(df, "k", numeric, nominal, cost, k).select("k", "near.key").collect()
    assert {r["k"]: r["key"] for r in got} == brute(rows, len(numeric), cost, k)
    assert len(got) == len(rows)


@pytest.mark.parametrize("rows_per_range", [prefix.ROWS_PER_RANGE, 25])
def test_crowds_copies_and_outliers(spark, monkeypatch, rows_per_range):
    """A third are copies of one row, a crowd sits far away, some categories are rare."""
    for module in (prefix, neighbours):
        monkeypatch.setattr(module, "ROWS_PER_RANGE", rows_per_range)
    rng = np.random.default_rng(5)
    rows = [(i, 1.0, "a", 0) for i in range(100)]
    rows += [(100 + i, float(rng.normal(1000, 0.01)), "b", 1) for i in range(100)]
    rows += [(200 + i, float(rng.uniform(-2000, 3000)), str(rng.choice(list("abcd"))), int(i % 2)) for i in range(60)]
    rows += [(300, 1000.0, "rare", 0), (301, 1e6, "a", 1), (302, -0.0, "a", 0), (303, 0.0, "a", 0)]
    check(spark, rows, "k long, x double, c string, f int", ["x"], ["c", "f"], 90.0)


def test_many_nominal_columns(spark):
    rng = np.random.default_rng(8)
    domains = (["M", "F", "O"], ["Y", "N"], list("pqrst"), ["u", "r"], list("wxyz"), [0, 1], [0, 1])
    rows = [
        (i, round(float(rng.uniform(0, 90)), 1), *[d[int(rng.integers(len(d)) * rng.integers(2))] for d in domains])
        for i in range(160)
    ]
    nominal = [f"c{i}" for i in range(7)]
    schema = "k long, x double, " + ", ".join(f"c{i} {'int' if i > 4 else 'string'}" for i in range(7))
    check(spark, rows, schema, ["x"], nominal, 400.0)


def test_several_numeric_columns(spark):
    rng = np.random.default_rng(9)
    rows = [(i, *[float(v) for v in rng.normal(0, 1, 4)], "ab"[i % 2]) for i in range(150)]
    # A third share their first number.
    rows = [(r[0], 0.5 if r[0] % 3 == 0 else r[1], *r[2:]) for r in rows]
    numeric = ["a", "b", "c", "d"]
    check(spark, rows, "k long, a double, b double, c double, d double, n string", numeric, ["n"], 1.3, k=3)


def test_no_nominal_columns_and_few_profiles(spark):
    rows = [(i, float(i % 3)) for i in range(30)]
    check(spark, rows, "k long, x double", ["x"], [], 1.0)


def test_missing_category_is_a_value(spark):
    rows = [(i, float(i), None if i % 4 == 0 else "a") for i in range(40)]
    check(spark, rows, "k long, x double, c string", ["x"], ["c"], 50.0)


def test_crowded_cells_are_dealt_out(spark, monkeypatch):
    """Isolated rows ask for coarse cells that hold a crowd."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 15)
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal(0, 0.1)), float(rng.normal(0, 0.1)), "ab"[i % 2]) for i in range(200)]
    rows += [(300 + i, float(rng.uniform(-50, 50)), float(rng.uniform(-50, 50)), "abc"[i % 3]) for i in range(30)]
    check(spark, rows, "k long, x double, y double, c string", ["x", "y"], ["c"], 2.0)


def fetched(spark, monkeypatch, n):
    """Pairs that the search fetches for n rows, uniform in a square."""
    rng = np.random.default_rng(n)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 1, (n, 2)))]
    pairs, fetch = [], neighbours._Search.fetch

    def counted(self, *args):
        out = fetch(self, *args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(neighbours._Search, "fetch", counted)
    df = spark.createDataFrame(rows, "k long, x double, y double")
    lists = nearest_rows(df, "k", ["x", "y"], [], 1.0, 5)
    assert lists.where("size(near) = 5").count() == n
    monkeypatch.setattr(neighbours._Search, "fetch", fetch)
    return sum(pairs)


def test_fetched_pairs_grow_with_the_rows(spark, monkeypatch):
    """Two columns of the same spread: pairs in proportion to the rows, not to their square."""
    few, many = (fetched(spark, monkeypatch, n) for n in (1000, 4000))
    assert many <= 5 * few
    assert few <= 40 * 1000


def test_curve_codes_are_interleaved_bits(spark):
    rng = np.random.default_rng(6)
    rows = [(float(a), float(b)) for a, b in rng.uniform(-3, 5, (200, 2))] + [(-3.0, -3.0), (5.0, 5.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    spans = ranges(df, ["x", "y"])
    width = max(b - a for a, b in spans)
    high, low = morton_code(["x", "y"], spans, 1 / 3)
    for r in df.select("x", "y", high.alias("high"), low.alias("low")).collect():
        steps = [int(((v - lo) / width + 1 / 3) * 2.0**51) for v, (lo, _) in zip((r["x"], r["y"]), spans, strict=True)]
        wanted = 0
        for bit in range(51, -1, -1):
            for x in steps:
                wanted = wanted << 1 | (x >> bit & 1)
        assert abs(((r["high"] << 42) | r["low"]) - wanted) <= 1 << 42
        assert ((r["high"] << 42) | r["low"]) >> 46 == wanted >> 46
