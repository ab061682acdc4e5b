"""What the operators of this subpackage have in common."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmill.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier and text alone, so that no other column can clash; a null text is empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def with_fields(schema: T.StructType, **more: str) -> T.StructType:
    """A new schema with further fields; the given one belongs to its frame."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in more.items())).fields])


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, allowed: Column | None = None
) -> DataFrame:
    """(doc_id, text, mark) of at most ``per_class`` documents of each class.

    Those with the smallest hash of their identifier are taken, so the sample is the same however the tables are
    stored. Repeated labels of a document count once (the larger one), repeated documents too. ``allowed``
    restricts the labelled rows by their doc_id.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if allowed is not None:
        marks = marks.where(allowed)
    marks = marks.groupBy("doc_id").agg(F.max(label).cast("int").alias("mark"))
    classes = [marks.where(F.col("mark") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(classes[0].unionAll(classes[1]))
    rows = documents(docs).join(chosen, "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("mark").alias("mark"))


_kept: list = []


def kept(key, make: Callable):
    """``make()``, held by the worker process from task to task until another key is asked for.

    Spark gives a worker to one operator after another, so what each of them holds must not add up: there is one
    place, and what was in it is freed before the next value is made.
    """
    if not _kept or _kept[0] != key:
        _kept.clear()
        gc.collect()
        release()
        _kept[:] = [key, make()]
    return _kept[1]


def release() -> None:
    """Gives memory that is free back to the system, which the C library would keep for the life of the worker."""
    pa.system_memory_pool().release_unused()


def in_slices(
    make: Callable[[list, list[str]], dict], schema: pa.Schema, max_chars: int = 2_000_000
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over (doc_id, text): calls ``make(ids, texts)`` on slices of bounded text size.

    A slice holds at most ``max_chars`` characters, or a single longer text. Free memory is released batch by batch.
    """

    def run(batches):
        for batch in batches:
            ids, column = batch.column("doc_id").to_pylist(), batch.column("text")
            texts, held, first = [], 0, 0
            for i in range(len(ids)):
                text = column[i].as_py() or ""
                if texts and held + len(text) > max_chars:
                    yield pa.RecordBatch.from_pydict(make(ids[first:i], texts), schema=schema)
                    texts, held, first = [], 0, i
                texts.append(text)
                held += len(text)
            if texts:
                yield pa.RecordBatch.from_pydict(make(ids[first:], texts), schema=schema)
            del batch, ids, column, texts
            release()

    return run


def components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable identifier per node of undirected links (a, b): rows (node, root), linked nodes only.

    Alternates large and small stars: every node hands its larger neighbours to the smallest one it
    knows, until each component is one star. Neighbour minima are aggregates and hand-overs are joins,
    so that a node with very many links is never gathered in one place. Each round is written to the
    shared folder. Null ends and self-links are ignored.
    """
    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    stars = materialize(
        ends.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), label
    )
    for _ in range(max_rounds):
        both = stars.select(F.col("v").alias("n"), F.col("u").alias("o")).unionAll(
            stars.select(F.col("u").alias("n"), F.col("v").alias("o"))
        )
        least = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("o > n").join(least, "n").select(F.col("o").alias("v"), F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        after = materialize(small.unionAll(low.select("v", F.col("m").alias("u"))).distinct(), label)
        # Stars are stable once every node points at one root that points nowhere.
        roots = after.select(F.col("u").alias("v")).distinct()
        loose = after.join(roots, "v", "left_semi").limit(1).count()
        many = after.groupBy("v").count().where("count > 1").limit(1).count()
        stars = after
        if not loose and not many:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = stars.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return stars.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(own)


class WordCache(dict):
    """Values of words, made on first use.

    Two generations of at most ``limit`` words each bound the memory: a full young generation becomes the old
    one, and words still in use move back to the young one.
    """

    def __init__(self, make: Callable, limit: int = 200_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
            if isinstance(word, (str, bytes)) and len(word) > self.longest:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value

    def hold_all(self, values: dict) -> None:
        """Keeps values made elsewhere until the next generation but one, however many they are."""
        if len(self) + len(values) > self.limit:
            self.old = dict(self)
            self.clear()
        self.update(values)

    def of(self, words: list, dtype=np.uint64) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype, len(words))
