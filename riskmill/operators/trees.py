"""Forests and boosted trees of many fits, grown side by side on counted rows: a Spark job per level of all of them.

Rows come as cells: equal coded rows of one training set, with their number in either class. They are dealt to blocks, so
that a training set may span many tasks. A job takes the trees so far to every block, which adds up its rows by tree, open
node, column and code; the sums of all blocks meet per tree, where the best split of every open node is found. Only these
splits reach the driver, as with Spark's own learners.

A tree of a forest sees every row a Poisson(1) number of times. Of n equal rows it sees a Poisson(n) number, so that is
what is drawn per cell, and the work does not grow with the number of equal rows. Draws are made from the seed, the tree
and the place of the cell among the ordered cells of its block.

Splits, leaves and scores are those of Spark's learners: gini or variance, numbers between any two present values, a
category against all others, sibling leaves of a forest merged if they predict the same class; boosting by logistic loss
with a first tree on -1 and 1 and steps of ``step`` after it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.functions.scalars import q
from riskmill.operators.encode import Encoding
from riskmill.session import materialize, reliable_checkpoints

#: Cells of a block, numbers summed for a tree in one job, candidates for a split of a number, rounds between checkpoints.
BLOCK, SUMS, BINS, KEPT_ROUNDS = 20_000, 2_000_000, 32, 10


@dataclass(frozen=True)
class TreeFit:
    """A forest (``step`` None, ``rounds`` trees) or boosted trees, on one training set, with class weights."""

    data: int
    weights: tuple[float, float]
    rounds: int
    depth: int
    step: float | None = None
    seed: int = 42


@dataclass(frozen=True)
class Shape:
    """Columns of a training set: their codes, and the splits to choose from in the order of the vector's slots."""

    borders: tuple
    nominal: tuple[bool, ...]
    offsets: np.ndarray
    width: int
    columns: np.ndarray
    codes: np.ndarray
    slots: np.ndarray
    n_slots: int

    @classmethod
    def of(cls, encoding: Encoding, values: list[list[float]]) -> Shape:
        """``values`` holds the values present per numeric and binary column."""
        spec = encoding.spec
        numbers = iter(values)
        borders, nominal, sizes, columns, codes, slots, slot = [], [], [], [], [], [], 0
        for c in (*spec.numeric, *spec.categorical, *spec.binary):
            if c in spec.categorical:
                n = len(encoding.labels[c])
                own, size = None, n + 1
                slots += range(slot, slot + n)
                slot += n
            else:
                seen = sorted(next(numbers))
                seen = seen if len(seen) <= BINS else [seen[i * (len(seen) - 1) // (BINS - 1)] for i in range(BINS)]
                own = np.array([(a + b) / 2 for a, b in zip(seen, seen[1:], strict=False)])
                n, size = len(own), len(own) + 1
                slots += [slot] * n
                slot += 1
            columns += [len(sizes)] * n
            codes += range(n)
            borders.append(own)
            nominal.append(own is None)
            sizes.append(size)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return cls(
            tuple(borders), tuple(nominal), offsets[:-1], int(offsets[-1]), np.array(columns, np.int64),
            np.array(codes, np.int64), np.array(slots, np.int64), slot,
        )

    def coded(self, raw: np.ndarray) -> np.ndarray:
        if np.isnan(raw).any():
            raise ValueError("numeric and binary features must not be missing")
        own = [raw[:, j] if b is None else np.searchsorted(b, raw[:, j], "left") for j, b in enumerate(self.borders)]
        return np.stack(own, 1).astype(np.int32)

    def left_sums(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sums per node, code and statistic: those of the whole node, and of the left side of each split."""
        total = sums[:, : self.offsets[1] if len(self.offsets) > 1 else self.width].sum(1)
        parts = []
        for j, start in enumerate(self.offsets):
            end = self.offsets[j + 1] if j + 1 < len(self.offsets) else self.width
            own = sums[:, start : end - 1]
            parts.append(total[:, None] - own if self.nominal[j] else np.cumsum(own, 1))
        return total, np.concatenate(parts, 1)


@dataclass
class Tree:
    """Nodes in the order of their making; a node's children stand side by side. ``split`` is -1 in leaves."""

    split: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    sums: np.ndarray
    waiting: np.ndarray

    @classmethod
    def root(cls) -> Tree:
        one = lambda v: np.array([v], np.int32)
        return cls(one(-1), one(-1), one(0), np.zeros((1, 3)), one(0))

    def next_nodes(self, shape: Shape) -> np.ndarray:
        """The first waiting nodes, as many as are summed at once."""
        return self.waiting[: max(1, SUMS // (3 * shape.width))]

    def grow(self, asked: np.ndarray, found: tuple, depth: int, pure: bool) -> None:
        """Adds the splits ``found`` for the first ``asked`` waiting nodes."""
        totals, places, splits, left, right = found
        self.sums[asked] = totals
        nodes, first = asked[places], len(self.split)
        children = np.arange(first, first + 2 * len(nodes), dtype=np.int32)
        self.split[nodes], self.left[nodes] = splits, children[::2]
        sums = np.stack([left, right], 1).reshape(-1, 3)
        levels = np.repeat(self.depth[nodes] + 1, 2)
        self.split = np.concatenate([self.split, np.full(len(children), -1, np.int32)])
        self.left = np.concatenate([self.left, np.full(len(children), -1, np.int32)])
        self.depth, self.sums = np.concatenate([self.depth, levels]), np.concatenate([self.sums, sums])
        more = (levels < depth) & ((sums[:, 0] > 0) & (sums[:, 1] > 0) if pure else True)
        self.waiting = np.concatenate([self.waiting[len(asked) :], children[more]])

    def routed(self, x: np.ndarray, shape: Shape) -> np.ndarray:
        """The node that every row of codes has reached."""
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        nominal = np.array(shape.nominal)
        while len(rows):
            split = self.split[node[rows]]
            rows, split = rows[split >= 0], split[split >= 0]
            column, code = shape.columns[split], x[rows, shape.columns[split]]
            right = np.where(nominal[column], code == shape.codes[split], code > shape.codes[split])
            node[rows] = self.left[node[rows]] + right
        return node

    def merged(self, weights) -> Tree:
        """Sibling leaves that predict the same class become one leaf, from the bottom up."""
        w0, w1 = self.sums[:, 0] * weights[0], self.sums[:, 1] * weights[1]
        positive, split = w1 > w0, self.split.copy()
        for i in range(len(split) - 1, -1, -1):
            a = self.left[i]
            if split[i] >= 0 and split[a] < 0 and split[a + 1] < 0 and positive[a] == positive[a + 1]:
                split[i] = -1
        return Tree(split, self.left, self.depth, self.sums, self.waiting)


@dataclass
class Block:
    """Coded cells of a training set in one task, with the margins of its boosted fits."""

    data: int
    part: int
    raw: np.ndarray
    x: np.ndarray
    counts: np.ndarray
    margins: dict[int, np.ndarray] = field(default_factory=dict)

    def pulls(self, number: int, fit: TreeFit, tree: int) -> np.ndarray:
        """Rows of both classes that a tree sees, and the weighted sum of what it is to predict, per cell."""
        if fit.step is None:
            drawn = np.random.default_rng([fit.seed, tree, self.part]).poisson(self.counts)
            return np.column_stack([drawn, np.zeros(len(drawn))])
        margin = self.margins.get(number)
        if margin is None:
            up, down = 1.0, -1.0
        else:
            up, down = 4 / (1 + np.exp(2 * margin)), -4 / (1 + np.exp(-2 * margin))
        n0, n1 = self.counts.T
        return np.stack([n0, n1, n0 * fit.weights[0] * down + n1 * fit.weights[1] * up], 1)


def _sums(block: Block, tree: Tree, nodes: np.ndarray, pulls: np.ndarray, shape: Shape) -> np.ndarray:
    """``pulls`` added up per node, code of each column and statistic."""
    place = np.full(len(tree.split), -1)
    place[nodes] = np.arange(len(nodes))
    used = np.flatnonzero(pulls[:, 0] + pulls[:, 1] > 0)
    at = place[tree.routed(block.x[used], shape)]
    used, at = used[at >= 0], at[at >= 0]
    x, own = block.x[used], pulls[used].astype(float)
    index = (at[:, None] * shape.width + shape.offsets + x).ravel()
    size = len(nodes) * shape.width
    sums = [np.bincount(index, np.repeat(own[:, s], x.shape[1]), size) for s in range(3)]
    return np.stack(sums, 1).reshape(len(nodes), shape.width, 3)


def codes(df: DataFrame, encoding: Encoding) -> DataFrame:
    """``df`` with the columns c0, c1, ...: bin numbers, category positions and flags, as the fitted vectors have them."""
    spec = encoding.spec
    stages = encoding.transformer(df.sparkSession).stages
    steps = PipelineModel(stages=[s for s in stages[:-1] if not s.hasParam("dropLast")])
    names = [f"num__{c}" for c in spec.numeric] + [f"ix__{c}" for c in spec.categorical] + [f"bin__{c}" for c in spec.binary]
    coded = [q(name).cast("double").alias(f"c{j}") for j, name in enumerate(names)]
    return steps.transform(df).select(*[q(c) for c in df.columns], *coded)


def cells(rows: DataFrame, encoding: Encoding, data: int, asked: DataFrame | None = None) -> DataFrame:
    """Coded rows of training set ``data`` with their number per class; rows ``asked`` to be scored count in none."""
    target = encoding.spec.target
    parts = [codes(rows.select(*encoding.spec.features, target), encoding).withColumn("n", F.lit(1))]
    if asked is not None:
        parts.append(codes(asked.select(*encoding.spec.features, target), encoding).withColumn("n", F.lit(0)))
    both = parts[0] if asked is None else parts[0].unionByName(parts[1])
    names = [c for c in both.columns if c not in (*encoding.spec.features, target, "n")]
    return both.groupBy(*names).agg(
        F.sum(F.when(q(target) == 0, F.col("n")).otherwise(0)).alias("n0"),
        F.sum(F.when(q(target) == 1, F.col("n")).otherwise(0)).alias("n1"),
    ).select(F.lit(data).alias("data"), *names, "n0", "n1")


class Grower:
    """Blocks of cells (see ``cells``), and the fits on them."""

    def __init__(self, counted: DataFrame, encodings: dict[int, Encoding]):
        self.spark = counted.sparkSession
        self.counted = materialize(counted, "cells")
        spec = next(iter(encodings.values())).spec
        m, b = len(spec.numeric), len(spec.binary)
        self.names = [c for c in self.counted.columns if c not in ("data", "n0", "n1")]
        numbers = self.names[:m] + self.names[len(self.names) - b :] if b else self.names[:m]
        facts = self.counted.groupBy("data").agg(
            F.count("*").alias("n"), *[F.collect_set(F.when(F.col("n0") + F.col("n1") > 0, q(c))).alias(c) for c in numbers]
        ).collect()
        self.shapes = {r["data"]: Shape.of(encodings[r["data"]], [r[c] for c in numbers]) for r in facts}
        self.blocks_of = max(1, math.ceil(max(r["n"] for r in facts) / BLOCK))
        self.blocks = self._dealt().persist(StorageLevel.MEMORY_AND_DISK)

    def _dealt(self) -> RDD:
        shapes, names, parts = self.shapes, self.names, self.blocks_of
        order = {d: i for i, d in enumerate(sorted(shapes))}
        part = F.pmod(F.xxhash64(*[q(c) for c in names]), F.lit(parts)).cast("int")
        rows = self.counted.select("data", part.alias("part"), *names, "n0", "n1").rdd
        keyed = rows.map(lambda r: (order[r[0]] * parts + r[1], tuple(r)))

        def build(items) -> Iterator[Block]:
            own = [r for _, r in items]
            if own:
                data, part = own[0][:2]
                raw = np.array([r[2:-2] for r in own], float).reshape(len(own), len(names))
                counts = np.array([r[-2:] for r in own], np.int64)
                x = shapes[data].coded(raw)
                place = np.lexsort(raw.T) if len(names) else np.arange(len(own))
                yield Block(data, part, raw[place], x[place], counts[place])

        return keyed.partitionBy(parts * len(order), lambda k: k).mapPartitions(build, preservesPartitioning=True)

    def _best(self, blocks: RDD, fits: dict[int, TreeFit], trees: dict, asked: dict) -> dict:
        """(totals, places, splits, left sums, right sums) of the nodes ``asked`` per (fit, tree)."""
        shapes, sent = self.shapes, self.spark.sparkContext.broadcast((fits, {k: trees[k] for k in asked}, asked))

        def add_up(block: Block):
            fits, trees, asked = sent.value
            for (number, t), nodes in asked.items():
                if fits[number].data == block.data:
                    pulls = block.pulls(number, fits[number], t)
                    yield (number, t), _sums(block, trees[number, t], nodes, pulls, shapes[block.data])

        def choose(item):
            (number, t), sums = item
            fits, _, asked = sent.value
            return (number, t), _choice(sums, fits[number], shapes[fits[number].data], asked[number, t], t)

        summed = blocks.flatMap(add_up).reduceByKey(np.add, len(shapes) * min(self.blocks_of, 8))
        found = dict(summed.map(choose).collect())
        sent.unpersist()
        return found

    def _grow_all(self, blocks: RDD, fits: dict[int, TreeFit], trees: dict) -> None:
        """Grows every tree to its end, a job for the waiting nodes of all of them.

        A training set whose cells all lie in one block (of at most BLOCK cells) needs no sums of others, so that
        all levels of its trees are grown in the same job.
        """
        if self.blocks_of == 1:
            shapes = self.shapes

            def grown(block: Block):
                for (number, t), tree in trees.items():
                    fit, shape = fits[number], shapes[block.data]
                    if fit.data == block.data:
                        pulls = block.pulls(number, fit, t)
                        while len(tree.waiting):
                            nodes = tree.next_nodes(shape)
                            found = _choice(_sums(block, tree, nodes, pulls, shape), fit, shape, nodes, t)
                            tree.grow(nodes, found, fit.depth, fit.step is None)
                        yield (number, t), tree

            trees.update(blocks.flatMap(grown).collect())
            return
        while True:
            asked = {k: t.next_nodes(self.shapes[fits[k[0]].data]) for k, t in trees.items() if len(t.waiting)}
            if not asked:
                return
            found = self._best(blocks, fits, trees, asked)
            for key, nodes in asked.items():
                fit = fits[key[0]]
                trees[key].grow(nodes, found[key], fit.depth, fit.step is None)

    def forests(self, fits: dict[int, TreeFit]) -> dict[int, list[Tree]]:
        """The trees of every forest."""
        trees = {(number, t): Tree.root() for number, fit in fits.items() for t in range(fit.rounds)}
        self._grow_all(self.blocks, fits, trees)
        return {n: [trees[n, t].merged(fit.weights) for t in range(fit.rounds)] for n, fit in fits.items()}

    def forest_scores(self, fits: dict[int, TreeFit], forests: dict[int, list[Tree]]) -> DataFrame:
        """(fit, data, codes, score) of every cell: the mean of the trees' shares of class 1."""
        shapes, sent = self.shapes, self.spark.sparkContext.broadcast((fits, forests))

        def run(block: Block):
            fits, forests = sent.value
            shape = shapes[block.data]
            for number, fit in fits.items():
                if fit.data == block.data:
                    shares = [_share(t, fit.weights)[t.routed(block.x, shape)] for t in forests[number]]
                    yield from _score_rows(number, block, np.mean(shares, 0))

        return self._frame(self.blocks.flatMap(run))

    def boosted_scores(self, fits: dict[int, TreeFit]) -> DataFrame:
        """(fit, data, codes, score) of every cell by boosted trees, grown round by round."""
        reliable_checkpoints(self.spark)
        shapes, state, before = self.shapes, self.blocks, []
        for r in range(max(fit.rounds for fit in fits.values())):
            own = {n: fit for n, fit in fits.items() if r < fit.rounds}
            trees = {(n, r): Tree.root() for n in own}
            self._grow_all(state, own, trees)
            for old in before:
                old.unpersist()
            steps = {}
            for n, fit in own.items():
                tree = trees[n, r]
                w = tree.sums[:, 0] * fit.weights[0] + tree.sums[:, 1] * fit.weights[1]
                steps[n] = fit.data, tree, (1.0 if r == 0 else fit.step) * tree.sums[:, 2] / w

            def moved(block: Block, steps=steps) -> Block:
                margins = dict(block.margins)
                for n, (data, tree, values) in steps.items():
                    if data == block.data:
                        margins[n] = margins.get(n, 0.0) + values[tree.routed(block.x, shapes[data])]
                return Block(block.data, block.part, block.raw, block.x, block.counts, margins)

            before = [state] if state is not self.blocks else []
            state = state.map(moved, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
            if r % KEPT_ROUNDS == KEPT_ROUNDS - 1:
                state.checkpoint()

        def run(block: Block):
            for number, margin in block.margins.items():
                yield from _score_rows(number, block, 1 / (1 + np.exp(-2 * margin)))

        scores = self._frame(state.flatMap(run))
        for old in (*before, state):
            old.unpersist()
        return scores

    def _frame(self, rows: RDD) -> DataFrame:
        schema = "fit int, data int, " + "".join(f"{c} double, " for c in self.names) + "score double"
        return materialize(self.spark.createDataFrame(rows, schema), "cell-scores")

    def close(self) -> None:
        self.blocks.unpersist()


def _score_rows(number: int, block: Block, scores: np.ndarray):
    for raw, score in zip(block.raw.tolist(), scores.tolist(), strict=True):
        yield (number, block.data, *raw, score)


def _share(tree: Tree, weights) -> np.ndarray:
    w0, w1 = tree.sums[:, 0] * weights[0], tree.sums[:, 1] * weights[1]
    return w1 / np.maximum(w0 + w1, 1e-300)


def _choice(sums: np.ndarray, fit: TreeFit, shape: Shape, nodes: np.ndarray, tree: int) -> tuple:
    """The best split of each node; nodes without one are left out of the places."""
    total, left = shape.left_sums(sums)
    right = total[:, None] - left
    if not left.shape[1]:
        empty = np.zeros(0, np.int64)
        return total, empty, empty, np.zeros((0, 3)), np.zeros((0, 3))
    allowed = (left[:, :, 0] + left[:, :, 1] > 0) & (right[:, :, 0] + right[:, :, 1] > 0)
    w0, w1 = fit.weights

    def worth(s):
        """What a side of a split adds to its gain."""
        w = s[..., 0] * w0 + s[..., 1] * w1
        top = (s[..., 0] * w0) ** 2 + (s[..., 1] * w1) ** 2 if fit.step is None else s[..., 2] ** 2
        return top / np.where(w > 0, w, 1.0)

    whole = total[:, 0] * w0 + total[:, 1] * w1
    gain = (worth(left) + worth(right) - worth(total)[:, None]) / np.where(whole > 0, whole, 1.0)[:, None]
    if fit.step is None:
        taken = math.ceil(math.sqrt(shape.n_slots))
        for i, node in enumerate(nodes):
            slots = np.random.default_rng([fit.seed, tree, int(node), 1]).permutation(shape.n_slots)[:taken]
            allowed[i] &= np.isin(shape.slots, slots)
    gain = np.where(allowed, gain, -np.inf)
    best = gain.argmax(1)
    # A forest's sums are whole numbers times weights: what is left of a gain of none is rounding.
    places = np.flatnonzero(gain[np.arange(len(best)), best] > (1e-12 if fit.step is None else 0.0))
    chosen = best[places]
    return total, places, chosen, left[places, chosen], right[places, chosen]


NODE = (
    "treeID int, nodeData struct<id:int, prediction:double, impurity:double, impurityStats:array<double>, rawCount:bigint, "
    "gain:double, leftChild:int, rightChild:int, split:struct<featureIndex:int, leftCategoriesOrThreshold:array<double>, "
    "numCategories:int>>"
)


def node_rows(trees: list[Tree], shape: Shape, weights) -> Iterator[tuple]:
    """The nodes of a forest as Spark saves them, children after their parents and without gaps."""
    for number, tree in enumerate(trees):
        number_of, order = {0: 0}, [0]
        for i in order:
            if tree.split[i] >= 0:
                for child in (int(tree.left[i]), int(tree.left[i]) + 1):
                    number_of[child] = len(order)
                    order.append(child)
        w = tree.sums[:, :2] * np.array(weights)
        whole = np.maximum(w.sum(1), 1e-300)
        impurity = 1 - ((w / whole[:, None]) ** 2).sum(1)
        for i in order:
            stats = [float(v) for v in w[i]]
            split, gain, children = (-1, [], -1), -1.0, (-1, -1)
            if tree.split[i] >= 0:
                s, a = int(tree.split[i]), int(tree.left[i])
                column, code, slot = int(shape.columns[s]), int(shape.codes[s]), int(shape.slots[s])
                split = (slot, [0.0], 2) if shape.nominal[column] else (slot, [float(shape.borders[column][code])], -1)
                children = number_of[a], number_of[a + 1]
                gain = float(impurity[i] - (whole[a] * impurity[a] + whole[a + 1] * impurity[a + 1]) / whole[i])
            yield number, (
                number_of[i], float(stats[1] > stats[0]), float(impurity[i]), stats, int(tree.sums[i, :2].sum()), gain,
                *children, split,
            )
