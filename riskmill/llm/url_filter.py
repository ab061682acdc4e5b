"""URL verdicts: rules where one fits, else logistic regression on hashed character n-grams of host and path.

Host and path are cut out by expressions in the JVM. A rule fits its host and all its subdomains if the path starts
with the rule's path; the longest rule wins. The model's labelled URLs are a bounded sample of those that a rule decides
(``Fit.per_class`` of each verdict, smallest hash first), so it carries the rules' taste over to other hosts.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged by the model like
any other; if the sample holds one verdict only, that verdict is given, and ``allow`` without any sample; repeated rows
are judged each for itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.llm.shared import with_fields

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The rules that the query applies.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


@dataclass(frozen=True)
class Fit:
    per_class: int = 4000
    slots: int = 1 << 14
    sizes: tuple[int, ...] = (2, 3, 4)
    ridge: float = 1.0
    steps: int = 200


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: up to ``?`` or ``#``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls."""
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule in reversed(longest):
        name, _, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        text = F.when(fits, F.lit(rule)).otherwise(text)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return text, verdict


def slots_of(host: str, path: str, how: Fit) -> np.ndarray:
    """Distinct slots of the character n-grams; host and path have n-grams of their own."""
    grams = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in how.sizes:
            grams.update(mark + text[i : i + n] for i in range(len(text) - n + 1))
    return np.unique(np.array([xxhash.xxh3_64_intdigest(g.encode("utf-8", "surrogatepass")) % how.slots for g in grams],
                              np.int64))


def fit(parts: DataFrame, how: Fit = Fit()) -> np.ndarray | None:
    """Weights with the bias last, from rows (host, path, verdict) that a rule decided."""
    rows = []
    for verdict in ("allow", "block"):
        pool = parts.where(F.col("verdict") == verdict).select("host", "path").distinct()
        rows += [(r["host"], r["path"], verdict == "allow")
                 for r in pool.orderBy(F.xxhash64("host", "path"), "host", "path").limit(how.per_class).collect()]
    if not rows:
        return None
    y = np.array([r[2] for r in rows], float)
    if y.min() == y.max():
        weights = np.zeros(how.slots + 1)
        weights[-1] = 1 if y[0] else -1
        return weights
    slots = [slots_of(h, p, how) for h, p, _ in rows]
    owner = np.repeat(np.arange(len(rows)), [len(s) for s in slots])
    at = np.concatenate(slots)
    value = np.repeat([1 / np.sqrt(len(s)) for s in slots], [len(s) for s in slots])
    balance = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b = np.zeros(how.slots), 0.0
    vw, vb = w, b
    step = 1 / (0.5 + how.ridge / len(y))
    for i in range(how.steps):
        total = np.bincount(owner, value * vw[at], len(y)) + vb
        error = balance * (1 / (1 + np.exp(-np.clip(total, -60, 60))) - y)
        new_w = vw - step * (np.bincount(at, value * error[owner], how.slots) + how.ridge / len(y) ** 2 * vw)
        new_b = vb - step * error.sum()
        k = i / (i + 3)
        vw, vb = new_w + k * (new_w - w), new_b + k * (new_b - b)
        w, b = new_w, new_b
    return np.append(w, b)


def judge(pages: DataFrame, rules=RULES, how: Fit = Fit()) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page; ``score`` is the model's probability of allow."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.withColumn("rule", rule).withColumn("verdict", verdict)
    weights = fit(parts, how)
    if weights is None:
        weights = np.append(np.zeros(how.slots), 1.0)
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    schema = with_fields(parts.schema, score="double")

    def run(batches):
        w = shared.value
        for batch in batches:
            score = []
            for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                s = slots_of(h, p, how)
                score.append(1 / (1 + np.exp(-np.clip(w[s].sum() / np.sqrt(max(1, len(s))) + w[-1], -60, 60))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())],
                                             names=[*batch.schema.names, "score"])

    scored = parts.mapInArrow(run, schema)
    own = F.when(F.col("score") >= 0.5, F.lit("allow")).otherwise(F.lit("block"))
    return scored.withColumn("verdict", F.coalesce("verdict", own))
