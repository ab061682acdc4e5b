"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of terms: the forms of its words (case, digits, marks at the end), words as such, and how much
repeats. Counts are damped, weighted by inverse document frequency and projected on the leading directions of the labelled
sample (latent semantic analysis). The sample's vectors are broadcast; every document is compared with all of them in
blocks of exact cosine products, and the nearest ones vote with their similarity as weight.

The model is fitted on a bounded sample of labelled rows (``Fit.per_class`` documents of each class, those with
the smallest hash of their identifier), so what is broadcast has a fixed size: ``terms`` x ``directions`` and
2 x ``per_class`` x ``directions`` numbers. Only the sample's counts reach the driver.

Defined cases: a null or empty text has the terms of an empty text and is scored like any other; without labels of
both classes every score is 0.5; ties between neighbours go to the one earlier in the sample; repeated rows are
scored each for itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.llm.shared import WordCache, documents, in_slices, kept, labelled_sample


@dataclass(frozen=True)
class Fit:
    per_class: int = 2000
    terms: int = 1024
    directions: int = 48
    neighbours: int = 15
    sharpness: float = 8.0


def form(word: bytes) -> bytes:
    """The case of a word's letters, its length class and the marks after it."""
    text = word.decode("utf-8", "replace")
    core = text.rstrip(".,;:!?\"')(#&$%*|/\\-_=+~^@<>[]{}")
    marks = text[len(core) :][:3]
    if not core:
        kind = "-"
    elif core.isalpha():
        kind = "A" if core.isupper() and len(core) > 1 else "a" if core.islower() else "Aa" if core[1:].islower() else "aA"
    elif core.isdigit():
        kind = "0"
    else:
        kind = "x"
    return f"{kind}{min(len(core), 30) // 6}{marks}".encode()


class Terms:
    """Term numbers of words, and the counts of a text."""

    def __init__(self, terms: int):
        self.terms = terms
        half = terms // 2
        self.forms = WordCache(lambda w: xxhash.xxh3_64_intdigest(form(w)) % half, 100_000)
        self.words = WordCache(lambda w: half + xxhash.xxh3_64_intdigest(w.lower()) % (terms - half), 100_000)

    def __call__(self, text: str) -> np.ndarray:
        """Damped shares of the terms, and classes of the share of repeats, as one vector."""
        words = text.encode("utf-8", "surrogatepass").split()
        out = np.zeros(self.terms + 24, np.float32)
        n = len(words)
        if not n:
            out[self.terms] = 1
            return out
        forms = self.forms.of(words, np.int64)
        own = self.words.of(words, np.int64)
        out[: self.terms // 2] = np.sqrt(np.bincount(forms, minlength=self.terms // 2)[: self.terms // 2] / n)
        counts = np.bincount(own, minlength=self.terms)[self.terms // 2 :]
        out[self.terms // 2 : self.terms] = 0.5 * np.sqrt(counts / n)
        again = sum(map(bytes.__eq__, words, words[1:])) / n
        distinct = len(set(words)) / n
        lines = text.split("\n")
        same_lines = 1 - len(set(lines)) / len(lines)
        out[self.terms + 1 + min(7, int(again * 8))] = 1
        out[self.terms + 9 + min(7, int(distinct * 8))] = 0.5
        out[self.terms + 17 + min(5, int(same_lines * 6))] = 0.7
        return out


@dataclass(frozen=True)
class Model:
    """Term weights, projection, and the labelled unit vectors."""

    how: Fit
    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        latent = (counts * self.idf) @ self.directions
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        """Share of the neighbours' weight that label 1 has."""
        cosine = self.project(counts) @ self.vectors.T
        k = min(self.how.neighbours, cosine.shape[1])
        few = [cosine[i : i + 64] for i in range(0, max(1, len(cosine)), 64)]
        near = np.concatenate([np.argpartition(-rows, k - 1, axis=1)[:, :k] for rows in few])
        best = np.take_along_axis(cosine, near, 1)
        weight = np.exp(self.how.sharpness * (best - 1))
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept for judging: crc32 of the identifier as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> Model | None:
    """A model from documents whose labels are not held out."""
    sample = labelled_sample(docs, labels, "quality", how.per_class, ~held_out(F.col("doc_id")))
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int32()), ("counts", pa.binary())])
    size = how.terms

    def run(batches):
        terms = kept(("terms", size), lambda: Terms(size))
        for batch in batches:
            counts = [terms(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(counts, pa.binary())], schema=schema
            )

    rows = sorted(sample.mapInArrow(run, "doc_id long, mark int, counts binary").collect())
    marks = np.array([r["mark"] for r in rows], np.float32)
    if not len(marks) or marks.min() == marks.max():
        return None
    counts = np.stack([np.frombuffer(r["counts"], np.float32) for r in rows])
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.3
    weighted = counts * idf
    values, axes = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    directions = axes[:, ::-1][:, : how.directions].astype(np.float32)
    plain = Model(how, idf, directions, np.empty((0, how.directions), np.float32), marks)
    return Model(how, idf, directions, plain.project(counts).astype(np.float32), marks)


def score(docs: DataFrame, model: Model | None, block: int = 512) -> DataFrame:
    """(doc_id, score, predicted) from the whole text of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    names = "doc_id long, score double, predicted int"
    if model is None:
        return documents(docs).select("doc_id", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(ids, texts):
        size = shared.value.how.terms
        terms = kept(("terms", size), lambda: Terms(size))
        # The counts of a text are wide, those of many short texts together far larger than the texts.
        parts = [texts[i : i + block] for i in range(0, len(texts), block)]
        votes = np.concatenate([shared.value.vote(np.stack([terms(t) for t in part])) for part in parts])
        votes = np.clip(votes.astype(float), 0, 1)
        return {"doc_id": ids, "score": votes, "predicted": (votes >= 0.5).astype(np.int32)}

    return documents(docs).mapInArrow(in_slices(make, schema), names)

