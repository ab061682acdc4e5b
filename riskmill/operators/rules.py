"""Data-quality rules: what makes a value suspicious, counted for all rules in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.functions.scalars import outside, q

# What is said before and after the number of suspicious rows.
MESSAGES = {
    "at_most": ("{column} <= {bound} found in ", " rows"),
    "below": ("{column} < {bound} found in ", " rows"),
    "negative": ("negative {column} found in ", " rows"),
    "not_in": ("{column} has ", " values outside {allowed}"),
}
NO_VIOLATION = "No invalid/impossible values detected in the checked columns."


@dataclass(frozen=True)
class Rule:
    """``kind`` is ``at_most`` (value <= bound is suspicious), ``below`` (value < bound) or ``not_in``."""

    column: str
    kind: str
    bound: float = 0
    domain: tuple = ()

    def broken(self) -> Column:
        value = q(self.column)
        if self.kind == "not_in":
            return outside(value, self.domain)
        number = F.when(~F.isnan(value.cast("double")), value)
        hit = number <= F.lit(self.bound) if self.kind == "at_most" else number < F.lit(self.bound)
        return F.coalesce(hit, F.lit(False))

    def message(self, n: Column) -> Column:
        kind = "negative" if self.kind == "below" and self.bound == 0 else self.kind
        allowed = ",".join(str(v) for v in self.domain)
        before, after = MESSAGES[kind]
        names = {"column": self.column, "bound": f"{self.bound:g}", "allowed": f"{{{allowed}}}"}
        return F.concat(F.lit(before.format(**names)), n.cast("string"), F.lit(after.format(**names)))


def at_most(column: str, bound: float = 0) -> Rule:
    return Rule(column, "at_most", bound)


def below(column: str, bound: float = 0) -> Rule:
    return Rule(column, "below", bound)


def not_in(column: str, domain) -> Rule:
    return Rule(column, "not_in", domain=tuple(domain))


def rule_counts(df: DataFrame, rules) -> DataFrame:
    """Every rule with the rows that break it: ``seq, column, rule, n``."""
    counted = df.agg(*[F.count_if(r.broken()).alias(f"r{i}") for i, r in enumerate(rules)])
    return counted.select(F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("seq"), F.lit(r.column).alias("column"), F.lit(r.kind).alias("rule"),
            F.col(f"r{i}").alias("n"), r.message(F.col(f"r{i}")).alias("message"),
        )
        for i, r in enumerate(rules)
    ])))


def violations_report(df: DataFrame, rules) -> DataFrame:
    """One line per failing rule, or a single line saying that there is none."""
    counted = df.agg(*[F.count_if(r.broken()).alias(f"r{i}") for i, r in enumerate(rules)])
    lines = F.filter(
        F.array(*[
            F.struct(
                F.lit(i).alias("seq"), F.lit(r.column).alias("column"), F.col(f"r{i}").alias("n"),
                r.message(F.col(f"r{i}")).alias("message"),
            )
            for i, r in enumerate(rules)
        ]),
        lambda s: s["n"] > 0,
    )
    none = F.array(F.struct(
        F.lit(-1).alias("seq"), F.lit(None).cast("string").alias("column"), F.lit(0).cast("bigint").alias("n"),
        F.lit(NO_VIOLATION).alias("message"),
    ))
    return counted.select(F.inline(F.when(F.size(lines) > 0, lines).otherwise(none)))


def violating_rows(df: DataFrame, rules) -> DataFrame:
    """The rows that break a rule, once per broken rule, with the rule's column."""
    names = F.filter(
        F.array(*[F.when(r.broken(), F.lit(r.column)) for r in rules]), lambda c: c.isNotNull()
    )
    return df.select("*", F.explode(names).alias("broken_column"))


def value_equals_counts(df: DataFrame, pairs) -> DataFrame:
    """Rows holding each chosen value: ``column, value, n``; a None value counts missing ones."""
    def hit(c, v):
        return q(c).isNull() if v is None else q(c) == F.lit(v)

    counted = df.agg(*[F.count_if(hit(c, v)).alias(f"e{i}") for i, (c, v) in enumerate(pairs)])
    return counted.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(None if v is None else str(v)).cast("string").alias("value"),
            F.col(f"e{i}").alias("n"),
        )
        for i, (c, v) in enumerate(pairs)
    ])))


def numeric_extremes(df: DataFrame, columns) -> DataFrame:
    counted = df.agg(*[
        F.struct(
            F.min(F.nanvl(q(c).cast("double"), F.lit(None))).alias("lo"),
            F.max(F.nanvl(q(c).cast("double"), F.lit(None))).alias("hi"),
        ).alias(f"s{i}")
        for i, c in enumerate(columns)
    ])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"s{i}.lo").alias("min"), F.col(f"s{i}.hi").alias("max"))
        for i, c in enumerate(columns)
    ])))
