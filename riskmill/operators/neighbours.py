"""Exact nearest rows of mixed-type rows, without comparing all pairs.

The squared distance of two rows is the sum of squared numeric differences plus a fixed cost per
differing nominal column. Equal rows are collapsed to one profile first. The search then runs in
two steps, each over profiles with at most ``d`` differing nominal columns, for d = 0, 1, ...: of
d + 1 blocks of nominal columns such profiles agree in one at least, so a profile has a copy per
block.

1. *Bound.* Rows next to each other on a space-filling curve through the numeric columns give every
   profile a distance that is certainly not exceeded by its k-th neighbour. Three shifted curves keep
   it within a constant of the true distance, so it shrinks as the rows get denser. A profile is done
   as soon as ``d`` mismatches alone cost more than its bound.
2. *Fetch.* All profiles within the bound are fetched by an equi-join on the block's values and on
   grid cells as wide as the bound, and ranked. Cells that hold very many profiles are dealt to
   several tasks.

Both steps are exact whatever the data looks like: the bound only has to be an upper one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmill.functions.scalars import add_all, q
from riskmill.operators.morton import morton_code, ranges
from riskmill.operators.prefix import ROWS_PER_RANGE, value_cuts, with_range
from riskmill.session import materialize

GRID_COLUMNS = 3
CELL_ROWS = 10_000
SHIFTS = (0.0, 1 / 3, 2 / 3)
NO_LEVEL = -9999


def _profile_id(numeric, nominal) -> Column:
    return F.md5(F.to_json(F.struct(*[q(c) for c in (*numeric, *nominal)]), {"ignoreNullFields": "false"}))


def profiled(rows: DataFrame, numeric, nominal) -> DataFrame:
    """Numeric columns as doubles (with one zero only) and the id of each row's profile."""
    plain = rows.select(
        *[(q(c).cast("double") + F.lit(0.0)).alias(c) if c in numeric else q(c) for c in rows.columns]
    )
    return plain.withColumn("pid", _profile_id(numeric, nominal))


def build_profiles(rows: DataFrame, key: str, numeric, nominal, keep: int) -> DataFrame:
    """One row per profile with its ``keep`` smallest keys.

    No row's neighbour list can hold more than ``keep`` of them, so a group of copies of any size
    shrinks to that many entries before it is gathered.
    """
    first = Window.partitionBy("pid").orderBy(q(key))
    kept = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= keep)
    return kept.groupBy("pid").agg(
        *[F.first(q(c)).alias(f"v{i}") for i, c in enumerate((*numeric, *nominal))],
        F.array_sort(F.collect_list(q(key))).alias("members"),
    )


class _Curve:
    """One curve through the numeric columns, cut into parts of bounded size.

    A range that a single repeated code makes too large is divided further by profile id; a part
    only has to hold enough rows for a bound.
    """

    def __init__(self, profiles: DataFrame, columns, spans, shift: float):
        self.code = morton_code(columns, spans, shift)
        codes = profiles.select(self.code[0].cast("double").alias("code"))
        self.cuts = value_cuts(codes, "code")
        self.split: dict[int, int] = {}
        if self.cuts:
            sizes = with_range(codes, "code", self.cuts, "part").groupBy("part").count()
            # A row per range.
            self.split = {
                r["part"]: -(-r["count"] // ROWS_PER_RANGE)
                for r in sizes.filter(F.col("count") > 4 * ROWS_PER_RANGE).collect()
            }

    def add(self, data: DataFrame) -> DataFrame:
        coded = data.withColumns({"code": self.code[0].cast("double"), "high": self.code[0], "low": self.code[1]})
        ranged = with_range(coded, "code", self.cuts, "range_id").drop("code")
        sub = F.lit(0)
        for part, n in self.split.items():
            sub = F.when(F.col("range_id") == part, F.pmod(F.xxhash64("pid"), F.lit(n)).cast("int")).otherwise(sub)
        return ranged.withColumn("part", F.struct("range_id", sub.alias("sub")))


class _Search:
    def __init__(self, profiles: DataFrame, m: int, c: int, cost: float, k: int):
        self.profiles, self.m, self.c, self.cost, self.k = profiles, m, c, cost, k
        self.values = [f"v{i}" for i in range(m + c)]

    def distance(self, left, right) -> Column:
        numeric = add_all([(left(i) - right(i)) * (left(i) - right(i)) for i in range(self.m)])
        return numeric + F.lit(self.cost) * self.mismatches(left, right) if self.c else numeric

    def mismatches(self, left, right) -> Column:
        return add_all([
            (~left(i).eqNullSafe(right(i))).cast("int") for i in range(self.m, self.m + self.c)
        ])

    def blocks(self, d: int) -> list[list[int]]:
        """d + 1 blocks of nominal columns; with ``d`` mismatches at least one block agrees."""
        if d >= self.c:
            return [[]]
        cuts = [self.m + self.c * j // (d + 1) for j in range(d + 2)]
        return [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]

    def shared_groups(self, d: int) -> Column:
        """One text per block, of the values that have to agree."""
        groups = []
        for n, kept in enumerate(self.blocks(d)):
            parts = [F.coalesce(F.col(f"v{i}").cast("string"), F.lit("\u0002")) for i in kept]
            groups.append(F.concat_ws("\u0001", F.lit(str(n)), *parts))
        return F.array(*groups)

    def first_agreeing(self, left, right, d: int) -> Column:
        """The first block in which two profiles agree: there, and only there, they are paired."""
        first = F.lit(-1)
        for n, kept in reversed(list(enumerate(self.blocks(d)))):
            first = F.when(reduce(lambda a, i: a & left(i).eqNullSafe(right(i)), kept, F.lit(True)), n).otherwise(first)
        return first

    def tighten(self, bounds: DataFrame, d: int, curves) -> DataFrame:
        """Lowers ``bound`` by the distances to the rows next in order inside each shared group."""
        open_rows = bounds.filter(F.col("bound") >= F.lit(d * self.cost))
        wanted = open_rows.select("pid", "need", F.explode(self.shared_groups(d)).alias("grp"))
        data = self.profiles.select(
            "pid", *self.values, F.explode(self.shared_groups(d)).alias("grp")
        ).join(wanted.select("grp").distinct(), "grp", "left_semi")
        found = []
        for curve in curves:
            near = Window.partitionBy("grp", "part").orderBy("high", "low", "pid").rowsBetween(-self.k, self.k)
            packed = curve.add(data).select(
                "pid", "grp", *self.values,
                F.collect_list(F.struct("pid", *self.values)).over(near).alias("near"),
            )
            others = F.filter("near", lambda s: s["pid"] != F.col("pid"))
            ranked = F.array_sort(F.transform(
                others, lambda s: self.distance(lambda i: F.col(f"v{i}"), lambda i: s[f"v{i}"])
            ))
            found.append(packed.select("pid", "grp", ranked.alias("ranked")))
        bound = F.try_element_at("ranked", F.col("need"))
        lower = (
            reduce(DataFrame.unionByName, found)
            .join(wanted, ["pid", "grp"])
            .groupBy("pid").agg(F.min(bound).alias("found"))
        )
        return bounds.join(lower, "pid", "left").withColumn(
            "bound", F.least("bound", F.coalesce("found", F.lit(float("inf"))))
        ).drop("found")

    def radius(self, d: int, floor_radius: float) -> Column:
        """Numeric distance left after ``d`` mismatches, a little wider than needed."""
        spare = F.greatest(F.col("bound") - F.lit(d * self.cost), F.lit(0.0))
        return F.greatest(F.sqrt(spare) * (1 + 1e-9), F.lit(floor_radius))

    def level(self, d: int, floor_radius: float) -> Column:
        """Power of two that is at least twice the radius; NO_LEVEL (one cell) without a bound."""
        power = F.ceil(F.log2(self.radius(d, floor_radius) * 2)).cast("int")
        return F.when(F.col("bound") == float("inf"), F.lit(NO_LEVEL)).otherwise(power)

    def levels_in_use(self, bounds: DataFrame, depth: int, floor_radius: float) -> list[list[int]]:
        """The few distinct levels of each step."""
        return list(bounds.agg(*[
            F.collect_set(F.when(F.col("bound") >= F.lit(d * self.cost), self.level(d, floor_radius))).alias(f"d{d}")
            for d in range(depth + 1)
        ]).first())

    def fetch(self, bounds: DataFrame, d: int, levels: list[int], floor_radius: float) -> DataFrame:
        """Other profiles with exactly ``d`` mismatches within the bound: one row per pair."""
        queries = bounds.filter(F.col("bound") >= F.lit(d * self.cost)).select(
            "pid", "bound", *self.values,
            self.radius(d, floor_radius).alias("radius"), self.level(d, floor_radius).alias("level"),
            F.posexplode(self.shared_groups(d)).alias("block", "grp"),
        )
        width = F.when(F.col("level") != NO_LEVEL, F.pow(F.lit(2.0), F.col("level")))

        def cell(value: Column) -> Column:
            return F.coalesce(F.floor(value / width).cast("bigint"), F.lit(0))

        left = queries
        for i in self.grid:
            left = left.select(
                "*",
                F.explode(F.sequence(
                    cell(F.col(f"v{i}") - F.col("radius")), cell(F.col(f"v{i}") + F.col("radius"))
                )).alias(f"cell{i}"),
            )
        right = self.profiles.select(
            F.col("pid").alias("other"), "members", *self.values,
            F.explode(self.shared_groups(d)).alias("grp"),
        ).select("*", F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"))
        for i in self.grid:
            right = right.withColumn(f"cell{i}", cell(F.col(f"v{i}")))
        place = ["grp", "level", *[f"cell{i}" for i in self.grid]]
        # Cells with very many profiles: these are dealt to several tasks, and those asking go to each.
        crowded = right.groupBy(*place).agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"))
        crowded = materialize(
            crowded.filter("parts > 1").join(left.select(*place).distinct(), place, "left_semi"), "crowded-cells"
        )
        parts = F.coalesce("parts", F.lit(1))
        left = left.join(crowded, place, "left").select(
            "pid", "bound", "block", *self.values, *place,
            F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"),
        )
        right = right.join(crowded, place, "left").select(
            "other", "members", *[F.col(v).alias(f"o_{v}") for v in self.values], *place,
            F.pmod(F.xxhash64("other"), parts).cast("int").alias("salt"),
        )
        a, b = (lambda i: F.col(f"v{i}")), (lambda i: F.col(f"o_v{i}"))
        distance = self.distance(a, b)
        wrong = self.mismatches(a, b) if self.c else F.lit(0)
        joined = left.join(right, [*place, "salt"]).filter(
            (F.col("pid") != F.col("other")) & (wrong == d) & (distance <= F.col("bound"))
            & (self.first_agreeing(a, b, d) == F.col("block"))
        )
        return joined.select(
            "pid", distance.alias("dist"), "members", *[F.col(f"o_{v}").alias(v) for v in self.values]
        )

    def run(self) -> DataFrame:
        """``pid, near``: the k + 1 rows closest to each profile, its own rows included."""
        need = F.lit(self.k + 1) - F.size("members")
        bounds = self.profiles.filter(need > 0).select(
            "pid", *self.values, need.alias("need"), F.lit(float("inf")).alias("bound")
        )
        numbers = self.values[: self.m]
        spans = ranges(self.profiles, numbers)
        # The columns with the widest ranges tell rows apart best.
        self.grid = sorted(range(self.m), key=lambda i: spans[i][0] - spans[i][1])[:GRID_COLUMNS]
        curves = [_Curve(self.profiles, numbers, spans, x) for x in (SHIFTS if self.m > 1 else SHIFTS[:1])]
        depth = -1
        for d in range(self.c + 1):
            bounds = materialize(self.tighten(bounds, d, curves), "neighbour-bounds")
            widest = bounds.agg(F.max("bound")).first()[0]
            if widest is None:
                break
            depth = d
            if widest < (d + 1) * self.cost:
                break
        reach = max(abs(x) for span in spans for x in span)
        floor_radius = max(self.cost**0.5 * 1e-6, reach * 2.0**-50, 1e-300)
        pairs = [self.profiles.select("pid", F.lit(0.0).alias("dist"), "members", *self.values)]
        if depth >= 0:
            for d, levels in enumerate(self.levels_in_use(bounds, depth, floor_radius)):
                if levels:
                    pairs.append(self.fetch(bounds, d, levels, floor_radius))
        nearest = Window.partitionBy("pid").orderBy("dist", F.col("members")[0])
        kept = (
            reduce(DataFrame.unionByName, pairs)
            .withColumn("nth", F.row_number().over(nearest))
            .filter(F.col("nth") <= self.k + 1)
        )
        # At most k + 1 profiles with k + 1 keys each.
        lists = F.transform("members", lambda key: F.struct(
            F.col("dist").alias("dist"), key.alias("key"), *[F.col(v).alias(v) for v in self.values]
        ))
        gathered = F.array_sort(F.flatten(F.collect_list("entries")))
        return kept.select("pid", lists.alias("entries")).groupBy("pid").agg(
            F.slice(gathered, 1, self.k + 1).alias("near")
        )


def nearest_rows(rows: DataFrame, key: str, numeric, nominal, mismatch_cost: float, k: int) -> DataFrame:
    """Adds ``near`` to every row: its k nearest other rows, closest first, ties by key.

    Entries hold ``dist`` (squared), ``key`` and the feature values ``v0, v1, ...`` in the order
    of ``numeric`` then ``nominal``.
    """
    if not numeric:
        raise ValueError("nearest rows need a numeric column")
    tagged = materialize(profiled(rows, numeric, nominal), "neighbour-rows")
    profiles = materialize(build_profiles(tagged, key, numeric, nominal, k + 1), "neighbour-profiles")
    lists = _Search(profiles, len(numeric), len(nominal), mismatch_cost, k).run()
    others = F.filter("near", lambda s: s["key"] != q(key))
    return tagged.join(lists, "pid").withColumn("near", F.slice(others, 1, k)).drop("pid")
