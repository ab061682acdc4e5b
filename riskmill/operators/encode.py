"""Turning mixed-type rows into numbers: population z-scores, one-hot slots, flags as they are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmill.functions.scalars import q
from riskmill.operators.profile import value_counts
from riskmill.spec import FeatureSpec

MAX_CATEGORIES = 100_000


@dataclass(frozen=True)
class Encoding:
    """What was learned from training rows: means, deviations and category values in order."""

    spec: FeatureSpec
    means: dict
    scales: dict
    labels: dict
    #: Cut points of numeric columns, for encodings that number bins instead of scaling.
    cuts: dict | None = None

    @classmethod
    def fit(cls, df: DataFrame, spec: FeatureSpec) -> Encoding:
        """Learns from the rows given and nothing else."""
        return cls.fit_with(df, spec, {})[0]

    @classmethod
    def fit_with(cls, df: DataFrame, spec: FeatureSpec, facts: dict[str, Column]):
        """The encoding and some further aggregates of the same pass over the rows.

        A constant column keeps its scale (divided by 1). Category values are listed only where
        their number is known to be small enough for a model.
        """
        row = df.agg(
            *[expr.alias(name) for name, expr in facts.items()],
            *[F.struct(F.avg(q(c)).alias("mean"), F.stddev_pop(q(c)).alias("std")).alias(f"__n{i}")
              for i, c in enumerate(spec.numeric)],
            *[F.approx_count_distinct(q(c)).alias(f"__c{i}") for i, c in enumerate(spec.categorical)],
        ).first()
        for i, c in enumerate(spec.categorical):
            if row[f"__c{i}"] > MAX_CATEGORIES:
                raise ValueError(f"{c} has about {row[f'__c{i}']} values, too many for one-hot slots")
        stats = {c: row[f"__n{i}"] for i, c in enumerate(spec.numeric)}
        labels: dict[str, list] = {c: [] for c in spec.categorical}
        if spec.categorical:
            found = value_counts(df, spec.categorical).filter("value is not null")
            for row_found in found.select("column", "value").collect():
                labels[row_found["column"]].append(row_found["value"])
        encoding = cls(
            spec,
            {c: s["mean"] for c, s in stats.items()},
            {c: s["std"] or 1.0 for c, s in stats.items()},
            {c: tuple(sorted(v)) for c, v in labels.items()},
        )
        return encoding, {name: row[name] for name in facts}

    def scaled(self, column: str) -> Column:
        return (q(column).cast("double") - F.lit(self.means[column])) / F.lit(self.scales[column])

    def binned(self, df: DataFrame) -> DataFrame:
        """``df`` with every number replaced by one that stands for its bin (the bin's lower border)."""
        out = {}
        for c in self.spec.numeric:
            own = self.cuts[c]
            borders = F.lit([own[0] - 1.0 if own else 0.0, *own]).cast("array<double>")
            out[c] = F.when(q(c).isNotNull(), F.get(borders, F.expr(self._bin_number(c))))
        return df.withColumns(out) if out else df

    def _bin_number(self, c: str) -> str:
        """SQL for the number of cuts that a value reaches."""
        own = ", ".join(f"{x!r}D" for x in self.cuts[c])
        return f"size(filter(CAST(array({own}) AS ARRAY<DOUBLE>), t -> t <= CAST(`{c}` AS DOUBLE)))"

    def slots(self) -> list[str]:
        """Names of the vector positions, in order."""
        return (
            [f"num__{c}" for c in self.spec.numeric]
            + [f"cat__{c}_{v}" for c in self.spec.categorical for v in self.labels[c]]
            + [f"bin__{c}" for c in self.spec.binary]
        )

    def transformer(self, spark: SparkSession) -> PipelineModel:
        """The same encoding as ML stages that add a sparse ``features`` vector and can be saved."""
        spec = self.spec
        numbers = [
            f"(CAST(`{c}` AS DOUBLE) - ({self.means[c]!r}D)) / {self.scales[c]!r}D AS `num__{c}`" if self.cuts is None
            else f"IF(`{c}` IS NULL, NULL, CAST({self._bin_number(c)} AS DOUBLE)) AS `num__{c}`"
            for c in spec.numeric
        ] + [f"CAST(`{c}` AS DOUBLE) AS `bin__{c}`" for c in spec.binary]
        stages = [SQLTransformer(statement=f"SELECT *, {', '.join(numbers)} FROM __THIS__")] if numbers else []
        if spec.categorical:
            indexed = [f"ix__{c}" for c in spec.categorical]
            indexer = StringIndexerModel.from_arrays_of_labels(
                [list(self.labels[c]) for c in spec.categorical],
                inputCols=list(spec.categorical), outputCols=indexed, handleInvalid="keep",
            )
            # The extra index of unseen values is the one that dropLast leaves all zero.
            one_hot = OneHotEncoder(
                inputCols=indexed, outputCols=[f"cat__{c}" for c in spec.categorical], dropLast=True
            )
            # The indexer states the number of values in the column metadata, which is all that is fitted.
            blank = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in spec.categorical))
            stages += [indexer, one_hot.fit(indexer.transform(blank))]
        assembler = VectorAssembler(
            inputCols=[f"num__{c}" for c in spec.numeric] + [f"cat__{c}" for c in spec.categorical]
            + [f"bin__{c}" for c in spec.binary],
            outputCol="features", handleInvalid="error",
        )
        return PipelineModel(stages=[*stages, assembler])


def encode(df: DataFrame, encoding: Encoding) -> DataFrame:
    return encoding.transformer(df.sparkSession).transform(df)


def scale_numeric(df: DataFrame, encoding: Encoding) -> DataFrame:
    """Key and the z-scores of the numeric features."""
    spec = encoding.spec
    return df.select(spec.key, *[encoding.scaled(c).alias(f"num__{c}") for c in spec.numeric])


def encode_long(df: DataFrame, encoding: Encoding, keep=()) -> DataFrame:
    """The encoded matrix as ``slot, value`` rows without its zeros.

    A value not seen in training has no row, which is the all-zero encoding.
    """
    spec = encoding.spec
    cells = [F.struct(F.lit(f"num__{c}").alias("slot"), encoding.scaled(c).alias("value")) for c in spec.numeric]
    for c in spec.categorical:
        text = q(c).cast("string")
        seen = text.isin(*encoding.labels[c]) if encoding.labels[c] else F.lit(False)
        cells.append(F.when(seen, F.struct(
            F.concat(F.lit(f"cat__{c}_"), text).alias("slot"), F.lit(1.0).alias("value")
        )))
    cells += [F.struct(F.lit(f"bin__{c}").alias("slot"), q(c).cast("double").alias("value")) for c in spec.binary]
    present = F.filter(F.array(*cells), lambda s: s.isNotNull() & (s["value"] != 0.0))
    return df.select(spec.key, *keep, F.inline(present))


def write_encoded(parts: DataFrame, encoding: Encoding, path: str) -> None:
    """The encoded rows of every part of a split as Parquet, one folder per part."""
    rows = encode_long(parts, encoding, keep=("split", encoding.spec.target))
    rows.hint("rebalance", F.col("split")).write.partitionBy("split").parquet(path)


def slot_names(df: DataFrame, encoding: Encoding) -> DataFrame:
    """``position, slot`` of every vector position."""
    names = list(enumerate(encoding.slots()))
    return df.sparkSession.createDataFrame(names, "position int, slot string")
