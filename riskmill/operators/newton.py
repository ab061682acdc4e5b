"""Many logistic regressions fitted side by side: one scan of the rows per step of all of them.

Rows carry a tag, and every fit names the tags it learns from, its class weights and its own scaling. Equal rows are
collapsed to one with their number. A step joins the rows with the current coefficients of the fits that use their tag and
sums what Newton's method needs per fit and combination of nominal values; those sums are opened into gradient and Gram
entries, which are added up per pair of slots. Only these (the square of the number of slots per fit) reach the driver,
which solves a small system per fit.

Minimised is 0.5 |w|^2 / c + sum of weighted losses, without a penalty on the intercept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.functions.scalars import add_all, logistic, q
from riskmill.operators.models import LinearScorer, strategy_factors
from riskmill.operators.profile import value_counts
from riskmill.session import materialize
from riskmill.spec import FeatureSpec

#: The driver holds a square matrix of this width per fit at most.
MOST_SLOTS = 1_500
STEPS = 60


@dataclass(frozen=True)
class Fit:
    """A logistic regression on the rows of ``tags``, weighted by ``strategy``."""

    name: str
    tags: tuple[str, ...]
    strategy: str


@dataclass
class _State:
    """Coefficients on scaled columns: intercept, numeric, binary, categorical values."""

    fit: Fit
    means: np.ndarray
    scales: np.ndarray
    weights: tuple[float, float]
    beta: np.ndarray
    tried: np.ndarray
    value: float = np.inf
    step: np.ndarray | None = None
    done: bool = False


def too_wide(rows: DataFrame, spec: FeatureSpec) -> bool:
    """Whether the categories need more slots than a dense matrix should have."""
    fixed = 1 + len(spec.numeric) + len(spec.binary)
    return fixed + len(_domain(rows, spec, MOST_SLOTS + 1)) > MOST_SLOTS


def _domain(rows: DataFrame, spec: FeatureSpec, most: int) -> list[tuple[str, str]]:
    """(column, value) of at most ``most`` category values, in order."""
    if not spec.categorical:
        return []
    found = value_counts(rows, spec.categorical).filter("value is not null").select("column", "value")
    position = {c: i for i, c in enumerate(spec.categorical)}
    listed = [(r["column"], r["value"]) for r in found.limit(most).collect()]
    return sorted(listed, key=lambda pair: (position[pair[0]], pair[1]))


def _prepared(rows: DataFrame, spec: FeatureSpec, slots: list[tuple[str, str]]) -> DataFrame:
    """Collapsed rows: tag, y, copies, numbers x0, x1, ... and the other non-zero cells, written once."""
    first = 1 + len(spec.numeric)
    cells = [
        F.struct(F.lit(first + i).alias("i"), q(c).cast("double").alias("v")) for i, c in enumerate(spec.binary)
    ]
    data = rows
    for k, c in enumerate(spec.categorical):
        own = [(v, first + len(spec.binary) + i) for i, (column, v) in enumerate(slots) if column == c]
        known = rows.sparkSession.createDataFrame(own, f"value{k} string, slot{k} int")
        data = data.join(F.broadcast(known), q(c).cast("string") == F.col(f"value{k}"), "left")
        cells.append(F.when(F.col(f"slot{k}").isNotNull(), F.struct(F.col(f"slot{k}").alias("i"), F.lit(1.0).alias("v"))))
    held = F.filter(F.array(*cells), lambda s: s.isNotNull() & (s["v"] != 0)) if cells else F.array().cast(
        "array<struct<i:int,v:double>>"
    )
    numbers = [q(c).cast("double").alias(f"x{i}") for i, c in enumerate(spec.numeric)]
    kept = ["tag", "y", *[f"x{i}" for i in range(len(numbers))], "cells"]
    plain = data.select("tag", q(spec.target).cast("int").alias("y"), *numbers, held.alias("cells"))
    return materialize(plain.groupBy(*kept).agg(F.count("*").cast("double").alias("copies")), "collapsed")


def _states(rows: DataFrame, spec: FeatureSpec, fits: list[Fit], width: int) -> list[_State]:
    """Scaling and class weights of every fit, from one aggregate per tag."""
    per_tag = rows.groupBy("tag").agg(
        F.count_if(q(spec.target) == 0).alias("n0"), F.count_if(q(spec.target) == 1).alias("n1"),
        *[F.struct(F.count(q(c)), F.avg(q(c).cast("double")), F.var_pop(q(c).cast("double"))).alias(f"s{i}")
          for i, c in enumerate(spec.numeric)],
    )
    facts = {r["tag"]: r for r in per_tag.collect()}
    out = []
    for fit in fits:
        own = [facts[t] for t in fit.tags if t in facts]
        n0, n1 = sum(r["n0"] for r in own), sum(r["n1"] for r in own)
        if not n0 or not n1:
            raise ValueError("training rows must hold both classes")
        means, scales = [], []
        for i in range(len(spec.numeric)):
            n, mean, var = (np.array([r[f"s{i}"][k] or 0.0 for r in own], float) for k in range(3))
            center = float((n * mean).sum() / n.sum())
            spread = float((n * (var + (mean - center) ** 2)).sum() / n.sum()) ** 0.5
            means.append(center)
            scales.append(spread or 1.0)
        factors = strategy_factors(fit.strategy, n0, n1)
        out.append(_State(fit, np.array(means), np.array(scales), factors, np.zeros(width), np.zeros(width)))
    return out


def _sums(prepared: DataFrame, states: list[_State], m: int) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and Gram matrix of every open fit at the coefficients it tries."""
    params = prepared.sparkSession.createDataFrame(
        [
            (tag, s.fit.name, s.tried.tolist(), s.means.tolist(), s.scales.tolist(), *s.weights)
            for s in states for tag in s.fit.tags
        ],
        "tag string, fit string, beta array<double>, means array<double>, scales array<double>, w0 double, w1 double",
    )
    x = [((F.col(f"x{i}") - F.col("means")[i]) / F.col("scales")[i]).alias(f"x{i}") for i in range(m)]
    # A row per fit and tag, each as long as the fit has slots.
    used = prepared.join(F.broadcast(params), "tag").select(
        "fit", "y", "cells", "beta", *x, (F.col("copies") * F.when(F.col("y") == 1, F.col("w1")).otherwise(F.col("w0"))).alias("w"),
        F.aggregate("cells", F.col("beta")[0], lambda a, s: a + s["v"] * F.get("beta", s["i"])).alias("z0"),
    )
    z = add_all([F.col("z0"), *[F.col(f"x{i}") * F.col("beta")[i + 1] for i in range(m)]])
    scored = used.withColumn("z", z).withColumn("p", logistic(F.col("z")))
    y = F.col("y").cast("double")
    loss = F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - y * F.col("z")
    rows = scored.select(
        "fit", "cells", *[f"x{i}" for i in range(m)], (F.col("w") * loss).alias("loss"),
        (F.col("w") * (F.col("p") - y)).alias("r"), (F.col("w") * F.col("p") * (1 - F.col("p"))).alias("h"),
    )
    dense = ["1.0", *[f"x{i}" for i in range(m)]]
    pairs = [(i, j) for i in range(m + 1) for j in range(i, m + 1)]
    grouped = rows.groupBy("fit", "cells").agg(
        F.sum("loss").alias("loss"),
        *[F.sum(F.expr(f"r * {dense[i]}")).alias(f"r{i}") for i in range(m + 1)],
        *[F.sum(F.expr(f"h * {dense[i]} * {dense[j]}")).alias(f"h{i}_{j}") for i, j in pairs],
    )
    nothing = F.lit(0.0)

    def entry(i, j, h, r, value=nothing):
        as_int = lambda k: (F.lit(k) if isinstance(k, int) else k).cast("int")
        return F.struct(as_int(i).alias("i"), as_int(j).alias("j"), h.alias("h"), r.alias("r"), value.alias("loss"))

    fixed = F.array(*[
        entry(i, j, F.col(f"h{i}_{j}"), F.col(f"r{j}") if i == 0 else nothing, F.col("loss") if i == j == 0 else nothing)
        for i, j in pairs
    ])
    mixed = F.flatten(F.transform("cells", lambda s: F.array(*[
        entry(i, s["i"], s["v"] * F.col(f"h0_{i}"), s["v"] * F.col("r0") if i == 0 else nothing) for i in range(m + 1)
    ])))
    inner = F.flatten(F.transform("cells", lambda s: F.transform(
        F.filter("cells", lambda t: t["i"] >= s["i"]),
        lambda t: entry(s["i"], t["i"], s["v"] * t["v"] * F.col("h0_0"), nothing),
    )))
    entries = grouped.select("fit", F.inline(F.concat(fixed, mixed, inner)))
    summed = entries.groupBy("fit", "i", "j").agg(F.sum("h").alias("h"), F.sum("r").alias("r"), F.sum("loss").alias("loss"))
    width = len(states[0].beta)
    out = {s.fit.name: [0.0, np.zeros(width), np.zeros((width, width))] for s in states}
    for row in summed.collect():
        own = out[row["fit"]]
        own[2][row["i"], row["j"]] = own[2][row["j"], row["i"]] = row["h"]
        if row["i"] == 0:
            own[1][row["j"]] = row["r"]
            own[0] += row["loss"]
    return {name: tuple(own) for name, own in out.items()}


def _advance(state: _State, loss: float, gradient: np.ndarray, gram: np.ndarray, c: float, tol: float) -> None:
    """One Newton step; a step that made things worse is halved instead."""
    penalty = np.full(len(state.beta), 1 / c)
    penalty[0] = 0.0
    value = loss + 0.5 * float((penalty * state.tried**2).sum())
    if value > state.value + 1e-9 * abs(state.value):
        state.step = state.step / 2
    else:
        state.beta, state.value = state.tried, value
        full = gram + np.diag(penalty)
        # Without any variance left (all scores at 0 or 1) the intercept's row may vanish.
        state.step = -np.linalg.lstsq(full, gradient + penalty * state.beta, rcond=None)[0]
    state.done = bool(np.abs(state.step).max() <= tol * max(1.0, np.abs(state.beta).max()))
    state.tried = state.beta + state.step


def fit_many(
    rows: DataFrame, spec: FeatureSpec, fits: list[Fit], c: float = 1.0, tol: float = 1e-10
) -> dict[str, LinearScorer]:
    """The scorer of every fit. ``rows`` holds features, target and ``tag``, and is read a few times."""
    slots = _domain(rows, spec, MOST_SLOTS + 1)
    m, b = len(spec.numeric), len(spec.binary)
    width = 1 + m + b + len(slots)
    if width > MOST_SLOTS:
        raise ValueError(f"{width} slots are too many to fit together")
    prepared = _prepared(rows, spec, slots)
    states = _states(rows, spec, fits, width)
    for _ in range(STEPS):
        open_fits = [s for s in states if not s.done]
        if not open_fits:
            break
        sums = _sums(prepared, open_fits, m)
        for s in open_fits:
            _advance(s, *sums[s.fit.name], c, tol)
    else:
        raise ArithmeticError(f"not settled after {STEPS} steps: {[s.fit.name for s in states if not s.done]}")
    out = {}
    for s in states:
        w = [float(v) for v in s.tried]
        categorical = {column: {} for column in spec.categorical}
        for (column, value), weight in zip(slots, w[1 + m + b :], strict=True):
            categorical[column][value] = weight
        out[s.fit.name] = LinearScorer(
            w[0], {column: (float(s.means[i]), float(s.scales[i]), w[1 + i]) for i, column in enumerate(spec.numeric)},
            categorical, {column: w[1 + m + i] for i, column in enumerate(spec.binary)},
        )
    return out
