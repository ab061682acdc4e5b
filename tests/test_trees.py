"""Trees grown side by side on counted rows, beside Spark's own learners."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmill.operators import models, trees
from riskmill.operators.models import BOOSTING, EXTREME, FOREST, ModelSettings, fit_candidate, learn, tree_fit
from riskmill.plans import crossval
from riskmill.plans.fixtures import RISK_SPEC, risk_events
from riskmill.session import materialize, new_folder
from riskmill.sources import store

QUICK = ModelSettings(forest_trees=8, boosting_rounds=4, extreme_rounds=4)


@pytest.fixture(scope="module")
def folds(spark, sf_dir):
    return crossval.fold_rows(risk_events(spark, sf_dir), RISK_SPEC, 2)


def test_boosted_trees_are_those_of_sparks_learner(folds):
    candidates = [(BOOSTING, "sample_weight"), (EXTREME, "scale_pos_weight")]
    scores = crossval.out_of_fold_scores(folds, RISK_SPEC, candidates, 2, QUICK)
    for model, strategy in candidates:
        single = fit_candidate(folds.where("fold <> 0"), RISK_SPEC, model, strategy, QUICK)
        own = crossval._scored(single, folds.where("fold = 0"), RISK_SPEC, 0, 0).select("key", F.col("score").alias("one"))
        both = own.join(scores.where((F.col("model") == model) & (F.col("fold") == 0)), "key")
        worst = both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("one") - F.col("score"))).alias("d")).first()
        assert worst["n"] == own.count() and worst["d"] < 1e-9


def test_blocks_together_grow_the_trees_of_one_block(folds, monkeypatch):
    """Boosting draws nothing, so cells dealt over many tasks have to give the same scores."""
    rows = folds.where("fold <> 0")
    encoding, facts = learn(rows, RISK_SPEC, binned=True)
    fits = {7: tree_fit(EXTREME, "scale_pos_weight", facts, QUICK)}

    def scored():
        grower = trees.Grower(trees.cells(rows, encoding, 0, folds.where("fold = 0")), {0: encoding})
        scores = {tuple(r)[:-1]: r["score"] for r in grower.boosted_scores(fits).collect()}
        forest = grower.forests({1: tree_fit(FOREST, "baseline", facts, QUICK)})[1]
        return grower.blocks_of, scores, forest

    one, expected, _ = scored()
    monkeypatch.setattr(trees, "BLOCK", 60)
    many, found, forest = scored()
    assert one == 1 and many > 2 and expected.keys() == found.keys()
    assert max(abs(found[k] - expected[k]) for k in found) < 1e-9
    assert len(forest) == 8 and all(abs(t.sums[0, :2].sum() - facts["n0"] - facts["n1"]) < 200 for t in forest)


def test_a_grid_takes_few_jobs(spark, folds):
    spark.sparkContext.setJobGroup("grid", "few jobs")
    many = ModelSettings(boosting_rounds=20, extreme_rounds=20)
    crossval.out_of_fold_scores(folds, RISK_SPEC, [(BOOSTING, "baseline"), (EXTREME, "baseline")], 2, many)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("grid")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Spark's learners need a job per level of each of 80 trees.
    assert len(jobs) < 120


def test_a_forest_draws_every_copy(spark, sf_dir):
    """Of a thousand equal rows a tree sees about a thousand, whatever the way they are stored."""
    once = risk_events(spark, sf_dir).withColumn("x_num", F.floor(F.col("x_num") / 50).cast("double"))
    rows = materialize(once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("copy"), "copies")
    fitted = fit_candidate(rows, RISK_SPEC, FOREST, "class_weight", QUICK)
    path = new_folder(spark, "bundle")
    store.save_bundle(spark, fitted, path)
    nodes = spark.read.parquet(f"{path}/model/stages/*_RandomForestClassifier_*/data").select("nodeData.*")
    roots = [r["rawCount"] for r in nodes.where("id = 0").collect()]
    n = rows.count()
    # Drawn row by row, the number has a deviation of about the root of n; drawn cell by cell it would be far larger.
    assert len(roots) == 8 and all(abs(r - n) < 6 * n**0.5 for r in roots) and len(set(roots)) > 1
    again = models.score_with(store.load_bundle(spark, path).stages, once)
    assert again.exceptAll(fitted.score(once)).isEmpty()
    # The model that Spark loads scores as the trees themselves do.
    encoding, facts = learn(rows, RISK_SPEC, binned=True)
    fits = {0: tree_fit(FOREST, "class_weight", facts, QUICK)}
    grower = trees.Grower(trees.cells(rows, encoding, 0), {0: encoding})
    own = grower.forest_scores(fits, grower.forests(fits))
    both = trees.codes(fitted.score(once), encoding).withColumnRenamed("score", "one").join(own, grower.names)
    assert both.count() == once.count()
    assert np.max([abs(r["one"] - r["score"]) for r in both.collect()]) < 1e-9


def test_missing_numbers_are_refused(spark):
    rows = spark.createDataFrame([(i, None if i == 5 else float(i), "a", 0, i % 2) for i in range(40)],
                                 "row_id long, x_num double, x_cat string, x_bin int, target int")
    with pytest.raises(Exception, match="must not be missing"):
        fit_candidate(rows, RISK_SPEC, FOREST, "baseline", QUICK)
