import math

import numpy as np
import pytest

from riskmill.operators import profile, quantiles

PROBS = (0.0, 0.25, 0.5, 0.75, 0.999, 1.0)


def scans(monkeypatch, run):
    """What ``run`` returns, and how often it had rows computed."""
    frame, seen = type(run.__closure__[0].cell_contents), []
    for name in ("first", "collect"):
        real = getattr(frame, name)
        monkeypatch.setattr(frame, name, lambda self, *a, real=real, name=name, **k: (seen.append(name), real(self, *a, **k))[1])
    out = run()
    monkeypatch.undo()
    # first() collects in turn.
    return out, len(seen) - seen.count("first")


def test_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    columns = {
        "spread": rng.normal(0, 1e6, 4000),
        "crowded": np.concatenate([rng.uniform(0, 1e-9, 3990), [1e12] * 10]),
        "repeated": np.concatenate([np.full(2500, 7.0), rng.uniform(0, 10, 1500)]),
        "constant": np.full(4000, -3.5),
    }
    rows = list(zip(*[v.tolist() for v in columns.values()], strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    for accuracy, steps in ((quantiles.ACCURACY, quantiles.STEPS), (40, 10)):
        # A rough sketch leaves more to the counts, and the results are the same.
        monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
        monkeypatch.setattr(quantiles, "STEPS", steps)
        got = quantiles.exact_quantiles(df, columns, PROBS)
        for c, values in columns.items():
            assert got[c] == pytest.approx(np.quantile(values, PROBS).tolist(), rel=1e-12), c


def test_three_scans_over_300_decades(spark, monkeypatch):
    rng = np.random.default_rng(8)
    values = (10.0 ** rng.uniform(-290, 10, 6000) * rng.choice([-1, 1], 6000)).tolist()
    df = spark.createDataFrame([(v, float(i % 3)) for i, v in enumerate(values)], "x double, y double").repartition(5)

    def run():
        return quantiles.exact_quantiles(df, ["x", "y"], PROBS, {"x": 6000, "y": 6000})

    got, count = scans(monkeypatch, run)
    assert count == 3
    assert got["x"] == pytest.approx(np.quantile(values, PROBS).tolist(), rel=1e-12)
    assert got["y"] == np.quantile([i % 3 for i in range(6000)], PROBS).tolist()


def test_a_wrong_sketch_costs_scans_but_no_result(spark, monkeypatch):
    values = np.random.default_rng(1).normal(0, 1, 3000)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    real = quantiles._brackets
    for wrong in ((-9.0, -8.0), (0.5, 0.6), (8.0, 9.0)):
        monkeypatch.setattr(quantiles, "_brackets", lambda *a, wrong=wrong: {c: [wrong] * len(v) for c, v in real(*a).items()})
        got = quantiles.exact_quantiles(df, ["x"], PROBS)
        assert got["x"] == pytest.approx(np.quantile(values, PROBS).tolist(), rel=1e-12)


def test_the_largest_double_stays_finite(spark):
    top = 1.7976931348623157e308
    df = spark.createDataFrame([(-top,), (0.0,), (top,), (math.inf,), (-math.inf,)], "x double")
    assert quantiles.exact_quantiles(df, ["x"], (0.0, 0.25, 0.5, 0.75, 1.0))["x"] == [-math.inf, -top, 0.0, top, math.inf]


def test_missing_nan_and_infinite(spark):
    df = spark.createDataFrame(
        [(1.0, None), (math.nan, None), (None, None), (3.0, None), (math.inf, None)], "a double, b double"
    )
    got = quantiles.exact_quantiles(df, ["a", "b"], (0.0, 0.5, 1.0))
    assert got == {"a": [1.0, 3.0, math.inf], "b": [None, None, None]}


def test_sketched_quartiles_are_close(spark):
    df = spark.range(10_001).withColumnRenamed("id", "x")
    row = profile.describe_numeric(df, ["x"], exact=False).first()
    assert abs(row["q50"] - 5000) < 50


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,)] * 7, "x double")
    rows = profile.histogram(df, "x", 4).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [0, 0, 7, 0] and rows[0]["lo"] == 1.5 and rows[-1]["hi"] == 2.5


def test_brackets_are_sketched_in_one_aggregate(spark, monkeypatch):
    """A row is sketched in its own bracket only, however many ranks are wanted."""
    import numpy as np

    from riskmill.operators import quantiles as module

    asked, sketch = [], module._sketch
    monkeypatch.setattr(module, "_sketch", lambda value, probs: asked.append(1) or sketch(value, probs))
    df = spark.range(40_000).selectExpr("pow(id % 9973, 2) AS x")
    probs = [i / 32 for i in range(1, 32)]
    found = module.exact_quantiles(df, ["x"], probs)["x"]
    expected = np.quantile([float(i % 9973) ** 2 for i in range(40_000)], probs)
    assert np.allclose(found, expected, rtol=1e-12) and len(asked) == 3
