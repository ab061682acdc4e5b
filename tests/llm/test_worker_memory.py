"""What a worker process holds when several operators run in it one after another."""

import gc
import tracemalloc
import weakref
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from riskmill.llm import bpe, minhash, packing, quality, toxicity
from riskmill.llm.queries import vocabulary_path


class Here:
    """A frame whose functions run in this process, as they would in one worker."""

    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v)))

    def __init__(self, texts):
        self.batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})

    def where(self, _):
        return self

    def mapInArrow(self, run, _):
        return [row for batch in run(iter([self.batch])) for row in batch.to_pylist()]


@pytest.fixture(autouse=True)
def in_this_process(monkeypatch):
    for module in (bpe, minhash, packing, quality, toxicity):
        monkeypatch.setattr(module, "documents", lambda docs: docs)


def model(how=quality.Fit(), seed=0):
    draw, width = np.random.default_rng(seed), how.terms + 24
    numbers = [draw.normal(size=s).astype(np.float32) for s in (width, (width, how.directions), (600, how.directions))]
    return quality.Model(how, *numbers, (np.arange(600) % 2).astype(np.float32))


SEVERITY = toxicity.fit_rows([(i % 2, [b"bad%d" % (i % 3), b"awful"] if i % 2 else [b"fine", b"%d" % i]) for i in range(60)])
NEXT = {
    "quality": lambda docs: quality.score(docs, model()),
    "toxicity": lambda docs: toxicity.score(docs, SEVERITY),
    "minhash": lambda docs: minhash.shingle_sets(docs),
}


@pytest.mark.parametrize("name", NEXT)
def test_the_codec_goes_when_another_operator_runs(name):
    docs = Here(["some words to pack", ""])
    before = NEXT[name](docs)
    pieces = packing.cut(docs, vocabulary_path())
    own = weakref.ref(bpe.codec(bpe.vocabulary(vocabulary_path())))
    packing.cut(docs, vocabulary_path())
    assert own() is bpe.codec(bpe.vocabulary(vocabulary_path())), "held from task to task"
    after = NEXT[name](docs)
    gc.collect()
    assert own() is None
    assert after == before and packing.cut(docs, vocabulary_path()) == pieces


def test_models_that_follow_each_other_use_their_own_weights():
    docs = Here(["awful bad1", "fine"])
    other = toxicity.Model({}, (60.0, 60.0))
    first = toxicity.score(docs, SEVERITY)
    assert all(r["expected_severity"] < 1e-9 for r in toxicity.score(docs, other))
    assert toxicity.score(docs, SEVERITY) == first and first[0]["score"] > first[1]["score"]


def test_quality_of_many_short_texts_holds_counts_of_a_block_only():
    docs = Here([f"text number {i}" for i in range(6000)])
    fitted = model()
    quality.score(docs, fitted)
    tracemalloc.start()
    scores = quality.score(docs, fitted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The counts of all texts are 25 MB, those of a block 2 MB.
    assert len(scores) == 6000 and peak < 20e6
