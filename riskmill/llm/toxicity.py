"""Toxicity by cumulative-link ordinal regression: one weight per text feature, shared by ordered thresholds.

``P(grade > k) = sigmoid(w·x - t_k)`` with ``t_0 <= t_1 <= ...``; the expected severity is the sum of these
probabilities. Features are sparse: the distinct words of a text and the beginnings (3 to 6 bytes) of its longer
words, so that inflected and compounded insults count too. A text's sum is the sum over its distinct words, hence
scoring needs one table look-up per word.

Labels say toxic or not. Grades above the first are made from the fitting sample: toxic documents with more telling
words than their median are grade 2, the others grade 1, clean documents grade 0.

The model is fitted on a bounded sample of labelled rows (``Fit.per_class`` documents of each class, those with
the smallest hash of their identifier). Only that sample reaches the driver.

Defined cases: a null or empty text has no features and gets the score of a text without any telling word; without
labels of both classes nothing can be told, and every score is 0; repeated rows are scored each for itself; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.llm.shared import WordCache, documents, in_slices, kept, labelled_sample

MARKS = b".,;:!?\"'()[]{}<>*#&$%|-_"
SCORES = "doc_id long, expected_severity double, severity int, score double, toxic int"


@dataclass(frozen=True)
class Fit:
    """``features`` telling features at most; a feature needs ``least`` toxic documents of the sample,
    log-odds of ``odds`` and a surplus of ``deviations`` standard deviations over chance.

    These bounds keep out noise only; the ridge weighs what is left, so rare words of a rare language count. Its
    penalty fades with the number of rows. Chosen on even identifiers of sf0.1 alone (fitted and judged on halves).
    """

    per_class: int = 5000
    features: int = 4000
    least: int = 3
    odds: float = 1.5
    deviations: float = 3.0
    ridge: float = 2.0
    steps: int = 300


def word_features(word: bytes) -> list[bytes]:
    """The bare word and, of longer words, its beginnings."""
    bare = word.lower().strip(MARKS)
    if not bare:
        return []
    return [bare] + [bare[:n] + b"*" for n in (3, 4, 5, 6) if len(bare) > n]


@dataclass(frozen=True)
class Model:
    """Log-odds, name and weight of each telling feature by its hash, and the ordered thresholds."""

    told: dict[int, tuple[float, bytes, float]]
    thresholds: tuple[float, ...]

    def word_weight(self, word: bytes) -> float:
        """Of a word's features the most telling one speaks, so that a beginning doesn't count several times."""
        found = [self.told.get(xxhash.xxh3_64_intdigest(f)) for f in word_features(word)]
        return max((f for f in found if f), default=(0.0, b"", 0.0))[2]

    def exceed(self, total: np.ndarray) -> np.ndarray:
        """P(grade > k) for every total and threshold."""
        return 1 / (1 + np.exp(-np.clip(total[:, None] - np.array(self.thresholds)[None, :], -60, 60)))


def fit_ordinal(x: np.ndarray, grades: np.ndarray, levels: int, ridge: float, steps: int):
    """Weights (none negative) and thresholds that minimise the cumulative-link loss with a quadratic penalty.

    Each document counts in every threshold's two-sided question; the lowest grade weighs as much as the others
    together. Accelerated gradient steps of the length that the curvature allows; thresholds are kept in order.
    """
    n, d = x.shape
    above = (grades[:, None] > np.arange(levels - 1)[None, :]).astype(np.float32)
    weight = np.zeros(n, np.float32)
    for g in range(levels):
        weight[grades == g] = (0.5 if g == 0 else 0.5 / (levels - 1)) / max(1, (grades == g).sum())
    # For features that are not negative, row sums bound the curvature of each weight.
    rows = weight * (x.sum(1) + 1)
    step_w = 1 / (0.25 * (levels - 1) * (x.T @ rows) + ridge / n)
    step_t = 1 / (0.25 * rows.sum())
    w, t = np.zeros(d, np.float32), np.arange(levels - 1, dtype=np.float32)
    vw, vt = w.copy(), t.copy()
    for i in range(steps):
        p = 1 / (1 + np.exp(-np.clip((x @ vw)[:, None] - vt[None, :], -60, 60)))
        error = weight[:, None] * (p - above)
        new_w = np.maximum(vw - step_w * (x.T @ error.sum(1) + ridge / n * vw), 0)
        new_t = np.maximum.accumulate(vt + step_t * error.sum(0))
        momentum = i / (i + 3)
        vw, vt = new_w + momentum * (new_w - w), new_t + momentum * (new_t - t)
        w, t = new_w, new_t
    return w, t


def fit(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> Model:
    """A model from a bounded sample of labelled documents, of which the distinct words reach the driver."""
    sample = labelled_sample(docs, labels, "toxic", how.per_class)
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int32()), ("words", pa.binary())])

    def run(batches):
        for batch in batches:
            texts = [t.as_py().encode("utf-8", "surrogatepass").split() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("mark"),
                pa.array([b" ".join(sorted(set(t))) for t in texts], pa.binary()),
            ], schema=schema)

    rows = sorted(sample.mapInArrow(run, "doc_id long, mark int, words binary").collect())
    return fit_rows([(r["mark"], bytes(r["words"]).split()) for r in rows], how)


def fit_rows(rows: list[tuple[int, list[bytes]]], how: Fit = Fit()) -> Model:
    """A model from (label, distinct words); near copies of a row (equal smallest hashes) count once."""
    seen, once = set(), []
    for row in rows:
        mark = tuple(sorted(map(xxhash.xxh3_64_intdigest, row[1]))[:4])
        if (row[0], mark) not in seen:
            seen.add((row[0], mark))
            once.append(row)
    rows = once
    texts = [r[1] for r in rows]
    toxic = np.array([r[0] for r in rows], bool)
    if not toxic.any() or toxic.all():
        return Model({}, (60.0, 60.0))
    yes, no = {}, {}
    for words, mark in zip(texts, toxic, strict=True):
        into = yes if mark else no
        for f in {f for w in words for f in word_features(w)}:
            into[f] = into.get(f, 0) + 1
    total_yes, total_no = toxic.sum(), (~toxic).sum()
    share = total_yes / len(rows)
    odds = {}
    for f, n in yes.items():
        c = no.get(f, 0)
        if n >= how.least and n - (n + c) * share >= how.deviations * np.sqrt((n + c) * share * (1 - share)):
            odds[f] = np.log((n + 0.1) / total_yes) - np.log((c + 0.5) / total_no)
    strong = sorted((f for f, v in odds.items() if v >= how.odds), key=lambda f: (-yes[f], f))[: how.features]
    place = {f: i for i, f in enumerate(strong)}
    x = np.zeros((len(texts), len(strong)), np.float32)
    hits = np.zeros(len(texts))
    for i, words in enumerate(texts):
        for w in words:
            mine = [f for f in word_features(w) if f in place]
            if mine:
                x[i, place[max(mine, key=lambda f: (odds[f], f))]] += 1
                hits[i] += 1
    border = float(np.median(hits[toxic & (hits > 0)])) if (toxic & (hits > 0)).any() else np.inf
    grades = np.where(toxic, np.where(hits > border, 2, 1), 0)
    w, t = fit_ordinal(x, grades, 3, how.ridge, how.steps)
    told = {xxhash.xxh3_64_intdigest(f): (float(odds[f]), f, float(w[i])) for f, i in place.items()}
    return Model(told, tuple(map(float, t)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, expected_severity, severity, score, toxic): the whole text of every document.

    ``score`` is the probability of any toxicity, ``toxic`` says whether it reaches a half.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("expected_severity", pa.float64()), ("severity", pa.int32()),
                        ("score", pa.float64()), ("toxic", pa.int32())])

    def make(ids, texts):
        model = shared.value
        look = kept(("severity", model), lambda: WordCache(model.word_weight, 150_000)).__getitem__
        total = np.array([sum(map(look, set(t.encode("utf-8", "surrogatepass").split()))) for t in texts], float)
        p = model.exceed(total)
        return {"doc_id": ids, "expected_severity": p.sum(1), "severity": (p >= 0.5).sum(1).astype(np.int32),
                "score": p[:, 0], "toxic": (p[:, 0] >= 0.5).astype(np.int32)}

    return documents(docs).mapInArrow(in_slices(make, schema), SCORES)
