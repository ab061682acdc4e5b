"""Exact stratified splits as a handful of cut keys.

Rows are ordered inside each class by a seeded digest of their key. A split is then a set of cut
keys per class. Digests are uniform, so where the key of a wanted rank lies can be calculated: at
rank / rows of the digests, give or take six deviations. Fitting takes three scans, whatever the
number of rows and classes: class sizes, counts on a grid over these stretches and between them,
and the keys of the grid cells that hold the ranks. Applying compares every row with the cuts of its
class, without moving any row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.functions.hashing import order_key
from riskmill.functions.scalars import add_all, one_row, percent, q, safe_div

#: Hex digits of a digest that count as its position; grid cells that all stretches share.
DIGITS = 13
SPAN = 16**DIGITS
CELLS = 65_536


@dataclass(frozen=True)
class SplitPlan:
    """Cut keys per class; part i holds the rows after cut i-1 up to and including cut i."""

    target: str
    key: str
    seed: int
    salt: str
    cuts: dict

    def apply(self, df: DataFrame, out: str) -> DataFrame:
        """Adds the part of every row; the order key is computed once per row, and no row is moved."""
        rank_key = F.col("__rank_key")
        part = F.when(F.lit(False), F.lit(0))
        for label, keys in self.cuts.items():
            index = add_all([(rank_key > F.lit(k)).cast("int") for k in keys]) if keys else F.lit(0)
            part = part.when(q(self.target) == F.lit(label), index)
        keyed = df.withColumn("__rank_key", order_key(self.seed, self.salt, q(self.key)))
        return keyed.withColumn(out, part).drop("__rank_key")


def _stretches(ranks: dict, totals: dict) -> dict:
    """Per class the disjoint parts [lo, hi) of the digest positions that hold the wanted ranks, in order."""
    out = {}
    for label, own in ranks.items():
        n, merged = totals[label], []
        for rank in sorted(own):
            share = rank / n
            # Six deviations, and some rows more where few rows make the normal law a poor guide.
            margin = 6 * math.sqrt(share * (1 - share) / n) + 40 / n
            lo, hi = (min(max(int(x * SPAN), 0), SPAN) for x in (share - margin, share + margin))
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(hi, merged[-1][1])
            else:
                merged.append([lo, hi])
        out[label] = merged
    return out


def _placed(keyed: DataFrame, stretches: dict, cells: int) -> DataFrame:
    """Rows of the classes searched with ``gap`` (2 i + 1 in the i-th stretch, even numbers between) and grid ``cell``."""
    spark, kind = keyed.sparkSession, keyed.schema["label"].dataType.simpleString()
    rows = [(label, [x for s in own for x in s]) for label, own in stretches.items()]
    borders = spark.createDataFrame(rows, f"label {kind}, borders array<bigint>")
    position = F.conv(F.substring("rank_key", 1, DIGITS), 16, 10).cast("bigint")
    placed = keyed.join(F.broadcast(borders), "label").withColumn("position", position)
    gap = F.size(F.filter("borders", lambda b: b <= F.col("position")))
    lo, hi = F.get("borders", F.col("gap") - 1), F.get("borders", F.col("gap"))
    # Cells as wide as a stretch needs; a position's offset in its stretch is below 2^52.
    cell = F.floor((F.col("position") - lo) / F.greatest(F.ceil((hi - lo) / F.lit(cells)), F.lit(1)))
    return placed.withColumn("gap", gap).withColumn("cell", F.when(F.col("gap") % 2 == 1, cell).otherwise(F.lit(0)))


def fit_cuts(df: DataFrame, target: str, key: str, ranks_for, seed: int, salt: str) -> SplitPlan:
    """Finds the keys at the 1-based ranks ``ranks_for(class_counts)[label]`` of each class."""
    keyed = df.filter(q(target).isNotNull()).select(
        q(target).alias("label"), order_key(seed, salt, q(key)).alias("rank_key")
    )
    # A row per class.
    totals = {r["label"]: r["count"] for r in keyed.groupBy("label").count().orderBy("label").collect()}
    wanted = ranks_for(totals)
    found = {(label, i): "" for label, ranks in wanted.items() for i, rank in enumerate(ranks) if rank <= 0}
    left = {(label, i): rank for label, ranks in wanted.items() for i, rank in enumerate(ranks) if rank > 0}
    stretches = _stretches({label: [r for r in ranks if r > 0] for label, ranks in wanted.items() if max(ranks, default=0) > 0}, totals)
    while left:
        cells = max(16, CELLS // max(1, sum(map(len, stretches.values()))))
        placed = _placed(keyed, stretches, cells)
        # At most CELLS counts (16 for each stretch beyond), and one for every gap between stretches.
        counts: dict = {}
        for r in placed.groupBy("label", "gap", "cell").count().collect():
            counts.setdefault(r["label"], []).append((r["gap"], r["cell"], r["count"]))
        at, again = {}, {}
        for (label, i), rank in left.items():
            for gap, cell, n in sorted(counts[label]):
                if rank <= n:
                    break
                rank -= n
            if gap % 2:
                at[label, i] = (gap, cell, rank)
            else:
                # Outside its stretch, once in a billion: the gap is searched next.
                ends = [0, *[x for s in stretches[label] for x in s], SPAN]
                again.setdefault(label, []).append([ends[gap], ends[gap + 1]])
        if at:
            found |= _keys_at(placed, at, key)
        left = {cut: rank for cut, rank in left.items() if cut not in at}
        stretches = {label: [list(x) for x in sorted(set(map(tuple, own)))] for label, own in again.items()}
    cuts = {label: tuple(found[label, i] for i in range(len(r))) for label, r in wanted.items()}
    return SplitPlan(target, key, seed, salt, cuts)


def _keys_at(placed: DataFrame, at: dict, key: str) -> dict:
    """The key at each (gap, cell, rank inside the cell): cells hold a millionth part of the deviation's rows."""
    spark, kind = placed.sparkSession, placed.schema["label"].dataType.simpleString()
    cells = sorted({(label, gap, cell) for (label, _), (gap, cell, _) in at.items()}, key=repr)
    chosen = spark.createDataFrame(cells, f"label {kind}, gap int, cell bigint")
    rows = placed.join(F.broadcast(chosen), ["label", "gap", "cell"]).groupBy("label", "gap", "cell", "rank_key").count()
    listed: dict = {}
    for r in rows.collect():
        listed.setdefault((r["label"], r["gap"], r["cell"]), []).append((r["rank_key"], r["count"]))
    found = {}
    for (label, i), (gap, cell, rank) in at.items():
        for rank_key, n in sorted(listed[label, gap, cell]):
            if rank <= n:
                break
            rank -= n
        if rank != n:
            raise ValueError(f"{key} is not unique: {rank_key.split('|', 1)[1]} appears {n} times")
        found[label, i] = rank_key
    return found


def class_quotas(totals: dict, draws: int) -> dict:
    """Shares ``draws`` among the classes in proportion, the largest remainders rounded up."""
    n = sum(totals.values())
    exact = {label: (c * draws) / n for label, c in totals.items()}
    quotas = {label: math.floor(x) for label, x in exact.items()}
    short = draws - sum(quotas.values())
    by_remainder = sorted(totals, key=lambda label: (quotas[label] - exact[label], label))
    for label in by_remainder[:short]:
        quotas[label] += 1
    return quotas


def test_quotas(totals: dict, test_size: float) -> dict:
    """Rows of each class that go to the test part of ceil(test_size * n) rows."""
    n = sum(totals.values())
    # The tolerance keeps 0.2 * 5 at 1 rather than the next integer above its binary value.
    n_test = math.ceil(test_size * n - 1e-9)
    train = class_quotas(totals, n - n_test)
    return {label: c - train[label] for label, c in totals.items()}


def fit_split(df: DataFrame, target: str, key: str, test_size: float = 0.2, seed: int = 42) -> SplitPlan:
    return fit_cuts(
        df, target, key,
        lambda totals: {label: [n] for label, n in test_quotas(totals, test_size).items()},
        seed, "split",
    )


def stratified_split(df: DataFrame, target: str, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: 'train' or 'test', with exact class counts in both."""
    parted = fit_split(df, target, key, test_size, seed).apply(df, "split")
    return parted.withColumn("split", F.when(F.col("split") == 0, "test").when(F.col("split") == 1, "train"))


def fold_sizes(totals: dict, k: int) -> dict:
    """Rows per class and fold, dealt out in class order so that folds differ by one row at most."""
    sizes, start = {}, 0
    for label, n in totals.items():
        sizes[label] = [
            (start + n - 1 - i) // k - (start - 1 - i) // k for i in range(k)
        ]
        start += n
    return sizes


def fold_ranks(totals: dict, k: int) -> dict:
    ranks = {}
    for label, sizes in fold_sizes(totals, k).items():
        ranks[label] = [sum(sizes[: i + 1]) for i in range(k - 1)]
        if min(sizes) == 0:
            raise ValueError(f"class {label} has fewer than {k} rows")
    return ranks


def fit_kfold(df: DataFrame, target: str, key: str, k: int = 5, seed: int = 42) -> SplitPlan:
    return fit_cuts(df, target, key, lambda totals: fold_ranks(totals, k), seed, "fold")


def stratified_kfold(df: DataFrame, target: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..k-1; class counts per fold differ by one row at most."""
    return fit_kfold(df, target, key, k, seed).apply(df, "fold")


def split_integrity(df: DataFrame, split_df: DataFrame, target: str, key: str) -> DataFrame:
    """What a split must hold: nothing lost, nothing twice, nothing in both parts."""
    before = df.agg(
        F.count("*").alias("rows_before"), F.count_if(q(target) == 1).alias("positives_before")
    )
    per_key = split_df.groupBy(q(key)).agg(*[
        F.count_if((F.col("split") == part) & cond).alias(name)
        for part in ("train", "test")
        for name, cond in ((f"{part}_rows", F.lit(True)), (f"{part}_positives", q(target) == 1))
    ])
    after = per_key.agg(
        *[F.sum(f"{part}_{what}").alias(f"{part}_{what}") for what in ("rows", "positives") for part in ("train", "test")],
        F.count_if((F.col("train_rows") > 0) & (F.col("test_rows") > 0)).alias("shared_keys"),
        F.count_if(F.col("train_rows") + F.col("test_rows") != 1).alias("bad_keys"),
    )
    return after.select("*", *one_row(before)    ).withColumn(
        "ok",
        (F.col("train_rows") + F.col("test_rows") == F.col("rows_before"))
        & (F.col("train_positives") + F.col("test_positives") == F.col("positives_before"))
        & (F.col("shared_keys") == 0) & (F.col("bad_keys") == 0),
    )


def split_distribution(split_df: DataFrame, target: str) -> DataFrame:
    """Rows and share of each class in each part: ``split, label, n, pct``."""
    from riskmill.operators.profile import class_distribution

    return class_distribution(split_df, target, by=("split",))


def majority_baseline(df: DataFrame, target: str) -> DataFrame:
    """Accuracy of always answering with the majority class, and its recall on class 1."""
    counted = df.agg(
        F.count_if(q(target) == 0).alias("n0"), F.count_if(q(target) == 1).alias("n1")
    )
    majority = F.when(F.col("n1") > F.col("n0"), 1).otherwise(0)
    return counted.select(
        majority.alias("majority_class"),
        safe_div(F.greatest("n0", "n1").cast("double"), F.col("n0") + F.col("n1")).alias("accuracy"),
        F.when(F.col("n1") > F.col("n0"), 1.0).otherwise(0.0).alias("recall"),
        percent(F.greatest("n0", "n1"), F.col("n0") + F.col("n1")).alias("accuracy_pct"),
    )
