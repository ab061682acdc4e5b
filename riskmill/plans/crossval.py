"""Leakage-free cross-validation, candidate selection and the one evaluation on test rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmill.functions.scalars import one_row, q
from riskmill.operators.choose import cv_summary, select_candidate
from riskmill.operators.metrics import all_metrics, fold_metrics
from riskmill.operators.models import (
    CANDIDATES, FOREST, LOGISTIC, Fitted, ModelSettings, fit_candidate, learn, tree_fit,
)
from riskmill.operators.newton import Fit, fit_many, too_wide
from riskmill.operators.smotenc import smotenc
from riskmill.operators.split import stratified_kfold, stratified_split
from riskmill.operators.trees import Grower, cells, codes
from riskmill.session import materialize, new_folder
from riskmill.spec import FeatureSpec

PARALLEL_FITS = 8
SCORED = "model string, strategy string, seq int, fold int, key string, label int, score double"


def split_rows(df: DataFrame, spec: FeatureSpec, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Key, features, target and ``split``, written once for every later reader."""
    columns = df.select(spec.key, *spec.features, spec.target)
    return materialize(stratified_split(columns, spec.target, spec.key, test_size, seed), "split", ("split",))


def fold_rows(train: DataFrame, spec: FeatureSpec, k: int = 5, seed: int = 42) -> DataFrame:
    """Training rows with ``fold``, written by fold so that a fit reads its own folds only."""
    return materialize(stratified_kfold(train, spec.target, spec.key, k, seed), "folds", ("fold",))


def _run_all(spark: SparkSession, jobs) -> list:
    """Runs small driver loops side by side; each of them is a series of Spark jobs."""
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def _scored(fitted: Fitted, rows: DataFrame, spec: FeatureSpec, seq: int, fold: int) -> DataFrame:
    return fitted.score(rows).select(
        F.lit(fitted.model).alias("model"), F.lit(fitted.strategy).alias("strategy"),
        F.lit(seq).alias("seq"), F.lit(fold).alias("fold"),
        q(spec.key).cast("string").alias("key"), q(spec.target).cast("int").alias("label"), "score",
    )


def out_of_fold_scores(
    folds: DataFrame, spec: FeatureSpec, candidates=CANDIDATES, k: int = 5,
    settings: ModelSettings = ModelSettings(),
) -> DataFrame:
    """Every training row scored once per candidate by the model that has not seen its fold.

    Resampled rows are made and encodings are learned once per fold and shared. All logistic
    regressions are fitted side by side, a scan of the rows per step of all of them (one by one only
    if categories need more slots than fit a dense matrix; the optimum is the same). All forests, and
    all boosted trees, grow side by side on counted rows, a job per level of all of them. Scores are
    written as soon as they exist.
    """
    spark = folds.sparkSession
    unknown = [c for c in candidates if c not in CANDIDATES]
    if unknown:
        raise ValueError(f"Unknown candidates: {unknown}")
    path = new_folder(spark, "scores")
    resampled: dict[int, DataFrame] = {}
    learned: dict[tuple[int, bool, bool], tuple] = {}

    def train_rows(fold: int) -> DataFrame:
        return folds.filter(F.col("fold") != fold)

    def prepare(fold: int, synthetic: bool):
        rows = train_rows(fold)
        if synthetic:
            new = smotenc(rows, spec, settings.ratio, settings.neighbours, settings.seed)
            rows = resampled[fold] = materialize(new, f"resampled-{fold}")
        if (synthetic, True) in kinds:
            learned[fold, synthetic, True] = learn(rows, spec, binned=True)
        if (synthetic, False) in kinds:
            learned[fold, synthetic, False] = learn(rows, spec)

    def fit(seq: int, model: str, strategy: str, fold: int):
        synthetic = strategy == "smotenc"
        fitted = fit_candidate(
            train_rows(fold), spec, model, strategy, settings, resampled.get(fold), learned[fold, synthetic, False],
        )
        held_out = folds.filter(F.col("fold") == fold)
        _scored(fitted, held_out, spec, seq, fold).write.parquet(f"{path}/fit={seq}-{fold}")

    def fit_logistic(strategies: list[str]):
        """All folds of all logistic candidates: every fit names the rows it learns from by their tag."""
        columns = [*spec.features, spec.target]
        rows = folds.select(*columns, F.concat(F.lit("fold "), F.col("fold").cast("string")).alias("tag"))
        for fold, new in resampled.items():
            rows = rows.unionByName(new.select(*columns, F.lit(f"resampled {fold}").alias("tag")))
        tags = {
            (s, fold): (f"resampled {fold}",) if s == "smotenc" else tuple(f"fold {g}" for g in range(k) if g != fold)
            for s in strategies for fold in range(k)
        }
        fits = [Fit(f"{s} {fold}", tags[s, fold], s) for s, fold in tags]
        scorers = fit_many(rows, spec, fits, settings.c)
        parts = [
            folds.filter(F.col("fold") == fold).select(
                F.lit(LOGISTIC).alias("model"), F.lit(s).alias("strategy"),
                F.lit(CANDIDATES.index((LOGISTIC, s))).alias("seq"), F.lit(fold).alias("fold"),
                q(spec.key).cast("string").alias("key"), q(spec.target).cast("int").alias("label"),
                scorers[f"{s} {fold}"].probability().alias("score"),
            )
            for s, fold in tags
        ]
        reduce(DataFrame.unionByName, parts).write.parquet(f"{path}/fit=logistic")

    def fit_trees(chosen: list[tuple[str, str]]):
        """All folds of tree candidates: held-out rows are cells of their training set that count in no class."""
        fits, named, encodings, counted, asked = {}, [], {}, [], []
        for m, s in chosen:
            seq = CANDIDATES.index((m, s))
            for fold in range(k):
                synthetic = s == "smotenc"
                data, number = 2 * fold + synthetic, seq * k + fold
                encoding, facts = learned[fold, synthetic, True]
                fits[number] = tree_fit(m, s, facts, settings, data)
                named.append((number, m, s, seq, fold))
                if data not in encodings:
                    rows = resampled[fold] if synthetic else train_rows(fold)
                    held_out = folds.filter(F.col("fold") == fold)
                    encodings[data] = encoding
                    counted.append(cells(rows, encoding, data, held_out))
                    asked.append(codes(held_out.select(
                        F.lit(data).alias("data"), q(spec.key).cast("string").alias("key"),
                        q(spec.target).cast("int").alias("label"), *spec.features,
                    ), encoding).drop(*spec.features))
        grower = Grower(reduce(DataFrame.unionByName, counted), encodings)
        if chosen[0][0] == FOREST:
            scores = grower.forest_scores(fits, grower.forests(fits))
        else:
            scores = grower.boosted_scores(fits)
        grower.close()
        names = spark.createDataFrame(named, "fit int, model string, strategy string, seq int, fold int")
        rows = reduce(DataFrame.unionByName, asked).join(scores, ["data", *grower.names])
        kept = ["model", "strategy", "seq", "fold", "key", "label", "score"]
        family = chosen[0][0].split()[-1].lower()
        rows.join(F.broadcast(names), "fit").select(*kept).write.parquet(f"{path}/fit=trees-{family}")

    strategies = [s for m, s in candidates if m == LOGISTIC]
    together = bool(strategies) and not too_wide(folds, spec)
    alone = [(m, s) for m, s in candidates if m == LOGISTIC and not together]
    forests = [c for c in candidates if c[0] == FOREST]
    boosted = [c for c in candidates if c[0] not in (LOGISTIC, FOREST)]
    # What the other fits need learned: from resampled rows or not, with binned numbers or not.
    kinds = {(s == "smotenc", m != LOGISTIC) for m, s in alone + forests + boosted}
    needed = {synthetic for synthetic, _ in kinds} | {True for s in strategies if s == "smotenc"}
    _run_all(spark, [lambda a=(fold, synthetic): prepare(*a) for synthetic in sorted(needed) for fold in range(k)])
    jobs = [lambda: fit_logistic(strategies)] if together else []
    jobs += [lambda own=own: fit_trees(own) for own in (boosted, forests) if own]
    _run_all(spark, jobs + [
        lambda a=(CANDIDATES.index((m, s)), m, s, fold): fit(*a) for m, s in alone for fold in range(k)
    ])
    return spark.read.schema(SCORED).parquet(path)


def cv_fold_metrics(scores: DataFrame) -> DataFrame:
    """Recall, precision, F1 and ROC-AUC per candidate and fold."""
    return fold_metrics(scores, ("model", "strategy", "seq", "fold"))


def cv_results(scores: DataFrame) -> DataFrame:
    """One row per candidate: means over folds, deviation of recall."""
    return cv_summary(cv_fold_metrics(scores), ("model", "strategy", "seq"))


def oof_check(folds: DataFrame, scores: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Rows per candidate, and those without exactly one score; the second has to be 0."""
    keys = folds.select(q(spec.key).cast("string").alias("key"))
    per_key = scores.groupBy("model", "strategy", "key").agg(F.count("*").alias("n"))
    seen = per_key.join(keys.withColumn("known", F.lit(1)), "key", "left")
    total = folds.agg(F.count("*")).scalar()
    return seen.groupBy("model", "strategy").agg(
        F.count("*").alias("keys"), F.count_if((F.col("n") != 1) | F.col("known").isNull()).alias("bad_keys"),
    ).withColumn("missing_keys", total - F.col("keys"))


def evaluate_once(fitted: Fitted, test: DataFrame, spec: FeatureSpec, threshold: float = 0.5) -> DataFrame:
    """All metrics of one fitted candidate on rows it has never seen, as one row."""
    scored = materialize(_scored(fitted, test, spec, 0, 0), "test-scores")
    return all_metrics(scored, threshold)


def candidate_summary(
    rows: DataFrame, spec: FeatureSpec, candidates=CANDIDATES, k: int = 5,
    settings: ModelSettings = ModelSettings(), seed: int = 42,
) -> DataFrame:
    """Compare by cross-validation on training rows, refit the winner on all of them, test once."""
    split = split_rows(rows, spec, seed=seed)
    train, test = (split.filter(F.col("split") == part).drop("split") for part in ("train", "test"))
    folds = fold_rows(train, spec, k, seed)
    results = materialize(cv_results(out_of_fold_scores(folds, spec, candidates, k, settings)), "cv-results")
    winner = select_candidate(results).first()
    fitted = fit_candidate(train, spec, winner["model"], winner["strategy"], settings)
    tested = evaluate_once(fitted, test, spec)
    cv = select_candidate(results).select(
        "model", "strategy", *[F.col(f"mean_{m}").alias(f"cv_mean_{m}") for m in ("recall", "precision", "f1", "roc_auc")],
        "selection_note",
    )
    names = ("accuracy", "precision", "recall", "f1_score", "roc_auc", "specificity")
    return cv.select("*", *one_row(tested.select(*[F.col(m).alias(f"test_{m}") for m in names])))

