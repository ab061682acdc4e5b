"""Candidates: one classifier with one way of handling the class imbalance."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.functions.scalars import add_all, logistic, q, safe_div
from riskmill.operators.encode import Encoding
from riskmill.operators.quantiles import exact_quantiles
from riskmill.operators.smotenc import smotenc
from riskmill.operators.trees import NODE, Grower, TreeFit, cells, node_rows
from riskmill.session import materialize, new_folder, reliable_checkpoints
from riskmill.spec import FeatureSpec

LOGISTIC = "Logistic Regression"
FOREST = "Random Forest"
BOOSTING = "Gradient Boosting"
EXTREME = "Extreme Boosting"

# The compared candidates, in order.
CANDIDATES = (
    (LOGISTIC, "baseline"),
    (LOGISTIC, "class_weight"),
    (LOGISTIC, "smotenc"),
    (FOREST, "baseline"),
    (FOREST, "class_weight"),
    (FOREST, "smotenc"),
    (BOOSTING, "baseline"),
    (BOOSTING, "sample_weight"),
    (EXTREME, "baseline"),
    (EXTREME, "scale_pos_weight"),
)
BALANCED = ("class_weight", "sample_weight")
STRATEGIES = ("baseline", "smotenc", "scale_pos_weight", *BALANCED)
#: Bins of a numeric column that trees may split between: as many as Spark's learners look at.
BINS = 32


@dataclass(frozen=True)
class ModelSettings:
    """Library defaults of the compared classifiers; tree depth is bounded by Spark (30)."""

    c: float = 1.0
    max_iter: int = 1000
    tol: float = 1e-7
    forest_trees: int = 100
    forest_depth: int = 30
    boosting_rounds: int = 100
    boosting_depth: int = 3
    boosting_step: float = 0.1
    extreme_rounds: int = 100
    extreme_depth: int = 6
    extreme_step: float = 0.3
    ratio: float = 0.5
    neighbours: int = 5
    seed: int = 42


@dataclass(frozen=True)
class Fitted:
    """A fitted candidate: its encoding, and encoder plus classifier as one saveable model."""

    model: str
    strategy: str
    encoding: Encoding
    stages: PipelineModel
    weight_total: float

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with the probability of class 1 in ``score``."""
        return score_with(self.stages, df)


def score_with(stages: PipelineModel, df: DataFrame) -> DataFrame:
    scored = stages.transform(df)
    return scored.select(*[q(c) for c in df.columns], vector_to_array(F.col("probability"))[1].alias("score"))


def strategy_factors(strategy: str, n0: int, n1: int) -> tuple[float, float]:
    """Weights of a negative and a positive training row under a strategy, from the class counts."""
    if strategy in BALANCED:
        return (n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)
    return 1.0, n0 / n1 if strategy == "scale_pos_weight" else 1.0


def strategy_weight(spec: FeatureSpec, strategy: str, n0: int, n1: int) -> Column:
    """Weight of a training row under a strategy."""
    negative, positive = strategy_factors(strategy, n0, n1)
    return F.when(q(spec.target) == 1, F.lit(positive)).otherwise(F.lit(negative))


def collapse_rows(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Equal training rows as one row with their number in ``copies``.

    For a loss that is a weighted sum over rows this is the same problem on fewer rows.
    """
    return df.groupBy(*spec.features, spec.target).agg(F.count("*").cast("double").alias("copies"))


def _classifier(model: str, weight_total: float, s: ModelSettings):
    shared = {"labelCol": "label", "featuresCol": "features", "weightCol": "row_weight"}
    if model == LOGISTIC:
        # Spark minimises the mean loss, so the penalty of a summed loss shrinks with the weight.
        return LogisticRegression(
            **shared, maxIter=s.max_iter, tol=s.tol, regParam=1.0 / (s.c * weight_total),
            elasticNetParam=0.0, standardization=False, family="binomial",
        )
    if model == FOREST:
        return RandomForestClassifier(
            **shared, numTrees=s.forest_trees, maxDepth=s.forest_depth, featureSubsetStrategy="sqrt",
            minInstancesPerNode=1, seed=s.seed,
        )
    if model in (BOOSTING, EXTREME):
        first = model == BOOSTING
        return GBTClassifier(
            **shared, maxIter=s.boosting_rounds if first else s.extreme_rounds,
            maxDepth=s.boosting_depth if first else s.extreme_depth,
            stepSize=s.boosting_step if first else s.extreme_step,
            minInstancesPerNode=1, seed=s.seed,
        )
    raise ValueError(f"Unknown model: {model}")


def tree_fit(model: str, strategy: str, facts: dict, s: ModelSettings, data: int = 0) -> TreeFit:
    """A forest or boosting as a fit on training set ``data``, whose class counts are in ``facts``."""
    weights = strategy_factors(strategy, facts["n0"], facts["n1"])
    if model == FOREST:
        return TreeFit(data, weights, s.forest_trees, s.forest_depth, seed=s.seed)
    if model == BOOSTING:
        return TreeFit(data, weights, s.boosting_rounds, s.boosting_depth, s.boosting_step)
    return TreeFit(data, weights, s.extreme_rounds, s.extreme_depth, s.extreme_step)


def _forest(rows: DataFrame, encoding: Encoding, encoder: PipelineModel, fit: TreeFit, s: ModelSettings):
    """A forest grown on counted rows, as the model that Spark's own learner returns."""
    spark = rows.sparkSession
    grower = Grower(cells(rows, encoding, fit.data), {fit.data: encoding})
    trees = grower.forests({0: fit})[0]
    grower.close()
    # Spark's learner on two rows makes the saved model; its nodes are replaced.
    both = F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("label")
    two = encoder.transform(rows.limit(1)).select("features", both, F.lit(1.0).alias("row_weight"))
    path = new_folder(spark, "forest")
    _classifier(FOREST, fit.weights[0], s).fit(two).write().save(path)
    shape, weights = grower.shapes[fit.data], fit.weights
    numbered = spark.sparkContext.parallelize(list(enumerate(trees)), min(len(trees), 16))
    nodes = numbered.flatMap(lambda item: ((item[0], n) for _, n in node_rows([item[1]], shape, weights)))
    spark.createDataFrame(nodes, NODE, verifySchema=False).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def bin_cuts(rows: DataFrame, spec: FeatureSpec, bins: int = BINS) -> dict:
    """Exact quantiles of every numeric column, as cuts of about equally full bins."""
    found = exact_quantiles(rows, spec.numeric, [i / bins for i in range(1, bins)])
    return {c: tuple(sorted({x for x in cuts if x is not None})) for c, cuts in found.items()}


def learn(rows: DataFrame, spec: FeatureSpec, binned: bool = False) -> tuple[Encoding, dict]:
    """The encoding of training rows (numbers ``binned`` or scaled) and their class counts."""
    encoding, facts = Encoding.fit_with(rows, spec, {
        "n0": F.count_if(q(spec.target) == 0), "n1": F.count_if(q(spec.target) == 1),
    })
    if not facts["n0"] or not facts["n1"]:
        raise ValueError("training rows must hold both classes")
    return (replace(encoding, cuts=bin_cuts(rows, spec)) if binned else encoding), facts


def fit_candidate(
    train: DataFrame, spec: FeatureSpec, model: str, strategy: str, settings: ModelSettings = ModelSettings(),
    resampled: DataFrame | None = None, learned: tuple[Encoding, dict] | None = None,
) -> Fitted:
    """Resample, learn the encoding from the resampled rows, fit the classifier.

    Only ``train`` is looked at. ``resampled`` and ``learned`` may pass in its resampled rows and
    what was learned from the fitted rows when several candidates share them. Equal rows are
    collapsed to weighted ones, which is the same problem for logistic regression, and for boosting
    once numbers are binned: with no more values than bins, all of them are split candidates and
    none come from a sample. Forests draw how often each of their trees sees the rows of a cell.
    """
    if model not in (LOGISTIC, FOREST, BOOSTING, EXTREME):
        raise ValueError(f"Unknown model: {model}")
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy: {strategy}")
    rows = train
    if strategy == "smotenc":
        rows = resampled if resampled is not None else materialize(
            smotenc(train, spec, settings.ratio, settings.neighbours, settings.seed), "resampled"
        )
    rows = rows.select(*spec.features, spec.target)
    encoding, facts = learned or learn(rows, spec, binned=model != LOGISTIC)
    n0, n1 = facts["n0"], facts["n1"]
    weight_total = float(n0 + n0 if strategy == "scale_pos_weight" else n0 + n1)
    encoder = encoding.transformer(train.sparkSession)
    if model == FOREST:
        fitted = _forest(rows, encoding, encoder, tree_fit(model, strategy, facts, settings), settings)
        return Fitted(model, strategy, encoding, PipelineModel(stages=[*encoder.stages, fitted]), weight_total)
    if encoding.cuts is not None:
        rows = encoding.binned(rows)
    data = collapse_rows(rows, spec)
    weight = F.col("copies") * strategy_weight(spec, strategy, n0, n1)
    prepared = encoder.transform(data).select(
        "features", q(spec.target).cast("double").alias("label"), weight.alias("row_weight")
    )
    if model in (BOOSTING, EXTREME):
        reliable_checkpoints(train.sparkSession)
    fitted = _classifier(model, weight_total, settings).fit(prepared)
    return Fitted(
        model, strategy, encoding,
        PipelineModel(stages=[*encoder.stages, fitted]), weight_total,
    )


@dataclass(frozen=True)
class LinearScorer:
    """A logistic regression as one native expression over the raw feature columns."""

    intercept: float
    numeric: dict
    categorical: dict
    binary: dict

    @classmethod
    def from_table(cls, table: DataFrame, spec: FeatureSpec) -> LinearScorer:
        """The scorer of a stored coefficient table (a row per slot of the encoding)."""
        rows = {r["slot"]: r for r in table.collect()}
        labels = {c: [s.removeprefix(f"cat__{c}_") for s in rows if s.startswith(f"cat__{c}_")] for c in spec.categorical}
        return cls(
            rows["(intercept)"]["coefficient"],
            {c: (rows[f"num__{c}"]["mean"], rows[f"num__{c}"]["scale"], rows[f"num__{c}"]["coefficient"])
             for c in spec.numeric},
            {c: {v: rows[f"cat__{c}_{v}"]["coefficient"] for v in labels[c]} for c in spec.categorical},
            {c: rows[f"bin__{c}"]["coefficient"] for c in spec.binary},
        )

    @classmethod
    def from_fitted(cls, fitted: Fitted) -> LinearScorer:
        spec, enc = fitted.encoding.spec, fitted.encoding
        classifier = fitted.stages.stages[-1]
        weights = dict(zip(enc.slots(), classifier.coefficients.toArray().tolist(), strict=True))
        return cls(
            float(classifier.intercept),
            {c: (enc.means[c], enc.scales[c], weights[f"num__{c}"]) for c in spec.numeric},
            {c: {v: weights[f"cat__{c}_{v}"] for v in enc.labels[c]} for c in spec.categorical},
            {c: weights[f"bin__{c}"] for c in spec.binary},
        )

    def linear(self, column=q) -> Column:
        """The linear score; ``column`` maps a feature name to its value."""
        terms = [F.lit(self.intercept)]
        terms += [
            (column(c).cast("double") - F.lit(mean)) / F.lit(scale) * F.lit(w)
            for c, (mean, scale, w) in self.numeric.items()
        ]
        for c, weights in self.categorical.items():
            # Unseen values weigh nothing, like their all-zero encoding.
            pairs = [F.lit(x) for item in weights.items() for x in item]
            terms.append(F.coalesce(F.try_element_at(F.create_map(*pairs), column(c).cast("string")), F.lit(0.0)))
        terms += [column(c).cast("double") * F.lit(w) for c, w in self.binary.items()]
        return add_all(terms)

    def probability(self, column=q) -> Column:
        return logistic(self.linear(column))

    def table(self, spark) -> DataFrame:
        """The tidy coefficient table: ``slot, coefficient, mean, scale``."""
        rows = [("(intercept)", self.intercept, None, None)]
        rows += [(f"num__{c}", w, m, s) for c, (m, s, w) in self.numeric.items()]
        rows += [(f"cat__{c}_{v}", w, None, None) for c, ws in self.categorical.items() for v, w in ws.items()]
        rows += [(f"bin__{c}", w, None, None) for c, w in self.binary.items()]
        return spark.createDataFrame(rows, "slot string, coefficient double, mean double, scale double")


def lr_gradient(train: DataFrame, fitted: Fitted, c: float = 1.0) -> DataFrame:
    """Gradient of the penalised mean loss at the fitted coefficients, per slot.

    At the optimum it is zero everywhere, whichever solver found it.
    """
    from riskmill.operators.encode import encode_long

    spec = fitted.encoding.spec
    scorer = LinearScorer.from_fitted(fitted)
    counts = train.agg(
        F.count_if(q(spec.target) == 0).alias("n0"), F.count_if(q(spec.target) == 1).alias("n1")
    ).first()
    weight = strategy_weight(spec, fitted.strategy, counts["n0"], counts["n1"])
    residual = (scorer.probability() - q(spec.target).cast("double")) * weight
    rows = train.withColumn("residual", residual)
    slots = encode_long(rows, fitted.encoding, keep=("residual",)).groupBy("slot").agg(
        F.sum(F.col("value") * F.col("residual")).alias("pull")
    )
    intercept = rows.agg(F.sum("residual").alias("pull")).select(F.lit("(intercept)").alias("slot"), "pull")
    penalty = scorer.table(train.sparkSession).select(
        "slot", F.when(F.col("slot") == "(intercept)", 0.0).otherwise(F.col("coefficient")).alias("penalised")
    )
    return slots.unionByName(intercept).join(F.broadcast(penalty), "slot").select(
        "slot",
        (safe_div(F.lit(1.0), F.lit(c * fitted.weight_total)) * F.col("penalised")
         + F.col("pull") / F.lit(fitted.weight_total)).alias("gradient"),
    )
