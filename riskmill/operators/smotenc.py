"""Synthetic minority rows for mixed-type tables (SMOTE-NC, Chawla et al. 2002).

Every minority row is the base of equally many synthetic rows, the remainder going to rows chosen
by a seeded order, so the number of new rows is exact and no global row index is needed. Numeric
values lie between the base and one of its k nearest minority rows; nominal values are the most
frequent ones among those k, ties going to the smallest value.
"""

from __future__ import annotations

from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.functions.hashing import uniform_draw
from riskmill.functions.scalars import q
from riskmill.operators.neighbours import nearest_rows
from riskmill.operators.split import fit_cuts
from riskmill.spec import FeatureSpec


def minority_facts(df: DataFrame, spec: FeatureSpec) -> dict:
    """Class counts, the minority label and the cost of a nominal mismatch."""
    row = df.agg(
        *[F.count_if(q(spec.target) == c).alias(f"n{c}") for c in (0, 1)],
        *[
            F.struct(
                F.stddev_pop(F.when(q(spec.target) == c, q(x).cast("double"))).alias("std"),
                F.count_if((q(spec.target) == c) & (q(x).isNull() | F.isnan(q(x).cast("double")))).alias("missing"),
            ).alias(f"s{c}_{i}")
            for c in (0, 1) for i, x in enumerate(spec.numeric)
        ],
    ).first()
    minority = 1 if row["n1"] <= row["n0"] else 0
    stats = [row[f"s{minority}_{i}"] for i in range(len(spec.numeric))]
    if any(s["missing"] for s in stats):
        raise ValueError("numeric features of the minority class must not be missing")
    spread = round(median(s["std"] or 0.0 for s in stats), 6)
    return {
        "minority": minority, "n_min": row[f"n{minority}"], "n_maj": row[f"n{1 - minority}"],
        # With no spread at all a mismatch has to count for something.
        "cost": spread * spread or 1.0,
    }


def most_frequent(values: Column) -> Column:
    """Most frequent element of a short array, the smallest one among ties."""
    counted = F.transform(F.array_distinct(values), lambda v: F.struct(
        (-F.size(F.filter(values, lambda x: x.eqNullSafe(v)))).alias("neg"), v.alias("v")
    ))
    return F.array_min(counted)["v"]


def minority_neighbours(df: DataFrame, spec: FeatureSpec, k: int = 5) -> DataFrame:
    """The minority rows with their k nearest minority rows in ``near``."""
    facts = minority_facts(df, spec)
    if facts["n_min"] <= k:
        raise ValueError(f"{k} neighbours need more than {k} minority rows, found {facts['n_min']}")
    rows = df.filter(q(spec.target) == facts["minority"]).select(spec.key, *spec.numeric, *spec.nominal)
    return nearest_rows(rows, spec.key, spec.numeric, spec.nominal, facts["cost"], k)


def synthetic_rows(df: DataFrame, spec: FeatureSpec, ratio: float = 0.5, k: int = 5, seed: int = 42) -> DataFrame | None:
    """The new rows only, with ``base_key`` and ``copy``; None when the ratio is already reached."""
    facts = minority_facts(df, spec)
    n_min = facts["n_min"]
    n_new = int(ratio * facts["n_maj"] - n_min)
    if n_new <= 0:
        return None
    if n_min <= k:
        raise ValueError(f"{k} neighbours need more than {k} minority rows, found {n_min}")
    rows = df.filter(q(spec.target) == facts["minority"]).select(spec.key, *spec.numeric, *spec.nominal)
    near = nearest_rows(rows, spec.key, spec.numeric, spec.nominal, facts["cost"], k)
    each, extra = divmod(n_new, n_min)
    labelled = near.withColumn(spec.target, F.lit(facts["minority"]))
    first = fit_cuts(rows.withColumn(spec.target, F.lit(facts["minority"])), spec.target, spec.key,
                     lambda totals: {label: [extra] for label in totals}, seed, "base")
    copies = F.lit(each) + (F.col("__turn") == 0).cast("int")
    key = q(spec.key)
    drawn = first.apply(labelled, "__turn").select(
        "*", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))).alias("copy")
    ).select(
        "*",
        F.element_at("near", F.floor(uniform_draw(seed, "nbr", key, F.col("copy")) * k).cast("int") + 1).alias("mate"),
        uniform_draw(seed, "gap", key, F.col("copy")).alias("gap"),
    )
    m = len(spec.numeric)
    numeric = [
        (q(c) + F.col("gap") * (F.col("mate")[f"v{i}"] - q(c))).alias(c) for i, c in enumerate(spec.numeric)
    ]
    # A field of an array of structs is the array of that field's values.
    nominal = [most_frequent(F.col("near")[f"v{m + i}"]).alias(c) for i, c in enumerate(spec.nominal)]
    return drawn.select(
        F.lit(None).cast(df.schema[spec.key].dataType).alias(spec.key), *numeric, *nominal,
        F.col(spec.target).cast(df.schema[spec.target].dataType).alias(spec.target),
        key.alias("base_key"), "copy",
    )


def smotenc(df: DataFrame, spec: FeatureSpec, ratio: float = 0.5, k: int = 5, seed: int = 42) -> DataFrame:
    """Originals and synthetic rows, told apart by ``is_synthetic``; for training rows only."""
    columns = [spec.key, *spec.features, spec.target]
    plain = df.select(*[q(c).cast("double").alias(c) if c in spec.numeric else q(c) for c in columns])
    originals = plain.withColumn("is_synthetic", F.lit(False))
    new = synthetic_rows(df, spec, ratio, k, seed)
    if new is None:
        return originals
    return originals.unionByName(new.select(*columns).withColumn("is_synthetic", F.lit(True)))


def balance_report(before: DataFrame, after: DataFrame, target: str) -> DataFrame:
    """Class counts before and after, and the rows added: ``label, n_before, n_after, added``."""
    from riskmill.operators.profile import class_distribution

    b = class_distribution(before, target).select("label", F.col("n").alias("n_before"))
    a = class_distribution(after, target).select("label", F.col("n").alias("n_after"))
    return b.join(a, "label").withColumn("added", F.col("n_after") - F.col("n_before"))
