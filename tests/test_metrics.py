import pytest
from pyspark.sql import functions as F

from riskmill.functions.hashing import uniform_draw
from riskmill.operators import choose, metrics, prefix

# Published results used as arithmetic checks.
CV = [
    ("Logistic Regression", "baseline", 0.0, 0.0, 0.0, 0.8372871087491909),
    ("Logistic Regression", "class_weight", 0.7787179487179487, 0.13062133727063277, 0.22366174989498228, 0.8374934660570907),
    ("Logistic Regression", "smotenc", 0.5378205128205128, 0.14535104004152613, 0.22857146657317054, 0.8197300462628225),
    ("Random Forest", "baseline", 0.05500000000000001, 0.1069285977180714, 0.07216135422805735, 0.7366997120853161),
    ("Random Forest", "class_weight", 0.11051282051282052, 0.12537133772427891, 0.11708590256617062, 0.7153165435909651),
    ("Random Forest", "smotenc", 0.1705128205128205, 0.0973499131232269, 0.12367464723480774, 0.7379893547534937),
    ("Gradient Boosting", "baseline", 0.005, 0.1, 0.009523809523809523, 0.8293113493306296),
    ("Gradient Boosting", "sample_weight", 0.7584615384615384, 0.13016687374813438, 0.22207942717940926, 0.8155137278016455),
]
SWEEP = [
    (0.1, 0.9698492462311558, 0.15403032721468476), (0.15, 0.9547738693467337, 0.17304189435336975),
    (0.2, 0.8994974874371859, 0.18302658486707565), (0.25, 0.864321608040201, 0.19736087205966724),
    (0.3, 0.8040201005025126, 0.20752269779507135), (0.35, 0.7286432160804021, 0.2098408104196816),
    (0.4, 0.6884422110552764, 0.22663358147229115), (0.45, 0.6080402010050251, 0.22765757290686736),
    (0.5, 0.5376884422110553, 0.22790202342917998), (0.55, 0.47738693467336685, 0.2259215219976219),
    (0.6, 0.4221105527638191, 0.2317241379310345), (0.65, 0.32663316582914576, 0.22071307300509338),
    (0.7, 0.2663316582914573, 0.2203742203742204),
]


@pytest.fixture
def scored(spark):
    """Scores with ties, crowded into the lowest part of the range."""
    return spark.range(3000).select(
        F.col("id").alias("k"),
        (uniform_draw(1, "y", F.col("id")) < 0.2).cast("int").alias("label"),
        F.round(F.pow(uniform_draw(1, "s", F.col("id")), 6), 4).alias("score"),
    )


def test_published_rates(spark):
    counts = spark.createDataFrame([(817, 155, 14, 36)], "tn bigint, fp bigint, fn bigint, tp bigint")
    row = metrics.with_rates(counts).first()
    assert row["accuracy"] == pytest.approx(0.8346379647749511)
    assert row["precision"] == pytest.approx(0.18848167539267016)
    assert row["recall"] == pytest.approx(0.72)
    assert row["f1_score"] == pytest.approx(0.2987551867219917)
    assert row["specificity"] == pytest.approx(0.8405349794238683)


def test_zero_denominators(spark):
    counts = spark.createDataFrame([(0, 0, 0, 0)], "tn bigint, fp bigint, fn bigint, tp bigint")
    assert set(metrics.with_rates(counts).first()[4:]) == {0.0}


def test_published_candidate_choice(spark):
    schema = "model string, strategy string, mean_recall double, mean_precision double, mean_f1 double, mean_roc_auc double, seq int"
    results = spark.createDataFrame([(*r, i) for i, r in enumerate(CV)], schema)
    best = choose.select_candidate(results).first()
    assert (best["model"], best["strategy"]) == ("Logistic Regression", "smotenc")
    fallback = choose.select_candidate(results, floor=0.9).first()
    assert fallback["strategy"] == "class_weight" and "fallback" in fallback["selection_note"]


def test_candidate_ties(spark):
    schema = "model string, strategy string, mean_recall double, mean_precision double, mean_f1 double, mean_roc_auc double, seq int"
    rows = [("a", "x", 0.6, 0.1, 0.2, 0.7, 0), ("b", "x", 0.6, 0.1, 0.2, 0.8, 1), ("c", "x", 0.6, 0.1, 0.2, 0.8, 2)]
    assert choose.select_candidate(spark.createDataFrame(rows, schema)).first()["model"] == "b"


def test_published_threshold_choice(spark):
    sweep = spark.createDataFrame(SWEEP, "threshold double, recall double, f1_score double")
    assert choose.choose_threshold(sweep).first()["threshold"] == 0.45
    assert choose.choose_threshold(sweep, floor=0.99).first()["threshold"] == 0.1


@pytest.fixture
def many_ranges(spark):
    """Ranges are partitions, so many small partitions make many ranges."""
    settings = {"spark.sql.shuffle.partitions": "25", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}

    def switch(on=True):
        for k, v in (settings if on else before).items():
            spark.conf.set(k, v)

    yield switch
    switch(False)


def test_many_ranges_give_the_same_curve(scored, many_ranges, monkeypatch):
    want = metrics.score_totals(scored, ahead=True).collect()
    many_ranges()
    written = []
    real = prefix.materialize
    monkeypatch.setattr(prefix, "materialize", lambda *a: written.append(real(*a)) or written[-1])
    assert sorted(metrics.score_totals(scored, ahead=True).collect(), key=repr) == sorted(want, key=repr)
    assert written[0].select("value_range").distinct().count() > 20


def test_the_rows_are_computed_once(spark, many_ranges):
    seen = spark.sparkContext.accumulator(0)

    def see(score):
        seen.add(1)
        return score

    # Else the optimiser may compute it in a filter and again in a projection of the same pass.
    counted = F.udf(see, "double").asNondeterministic()
    rows = spark.range(2000).select((F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 701).cast("double").alias("s"))
    many_ranges()
    metrics.ranking_metrics(rows.select("label", counted("s").alias("score"))).collect()
    assert seen.value == 2000


def test_thin_curve_with_a_run_over_many_ranges(spark, many_ranges):
    """Positives first, then half of the rows without any: one horizontal run, cut by many borders."""
    rows = [(int(i < 500 and i % 3 > 0 or i in (1700, 1702)), -float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "label int, score double").repartition(6)
    many_ranges()
    points = sorted((r["fpr"], r["tpr"]) for r in metrics.roc_points(df).collect())
    # By hand: points where the direction changes, the first one and the last one.
    kept = [points[0], points[1]] + [
        b for a, b, c in zip(points[1:], points[2:], points[3:], strict=False)
        if not (a[0] == b[0] == c[0] or a[1] == b[1] == c[1])
    ] + [points[-1]]
    assert sorted((r["fpr"], r["tpr"]) for r in metrics.roc_points(df, thin=True).collect()) == kept


def test_auc_of_reversed_scores(scored):
    up = metrics.roc_auc(scored).first()[0]
    down = metrics.roc_auc(scored.withColumn("score", -F.col("score"))).first()[0]
    assert up + down == pytest.approx(1.0)


def test_auc_of_one_class_is_missing(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "label int, score double")
    assert metrics.roc_auc(df).first()[0] is None


def test_auc_equals_ml_evaluator(scored):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    ml = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    assert metrics.roc_auc(scored).first()[0] == pytest.approx(ml.evaluate(scored.withColumn("label", F.col("label").cast("double"))))


def test_recall_falls_with_the_threshold(scored):
    rows = sorted(metrics.threshold_sweep(scored).collect(), key=lambda r: r["threshold"])
    recalls = [r["recall"] for r in rows]
    assert len(rows) == 13 and recalls == sorted(recalls, reverse=True)


def test_thin_curve_keeps_its_area(scored):
    def area(points):
        rows = sorted((r["fpr"], r["tpr"]) for r in points.collect())
        return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(rows, rows[1:], strict=False)), len(rows)

    full, n_full = area(metrics.roc_points(scored))
    thin, n_thin = area(metrics.roc_points(scored, thin=True))
    assert thin == pytest.approx(full) and n_thin < n_full
    assert full == pytest.approx(metrics.roc_auc(scored).first()[0])


def test_default_equal_to_alternative(scored):
    assert metrics.evaluation_report(scored, 0.5).count() == 1
    assert {r["delta"] for r in metrics.metric_compare(scored, 0.5).collect()} == {0.0}


def test_groups_over_many_ranges(scored, many_ranges):
    grouped = scored.withColumn("g", F.when(F.col("k") % 9 == 0, "small").otherwise("large"))
    want = {r["g"]: r.asDict() for r in metrics.all_metrics(grouped, 0.3, ("g",)).collect()}
    many_ranges()
    got = {r["g"]: r.asDict() for r in metrics.all_metrics(grouped, 0.3, ("g",)).collect()}
    assert set(got) == {"small", "large"}
    for g in got:
        assert {k: v for k, v in got[g].items() if k != "g"} == pytest.approx({k: v for k, v in want[g].items() if k != "g"})
    at = {r["g"]: r for r in metrics.metrics_at(grouped, 0.3, ("g",)).collect()}
    assert all(got[g][c] == at[g][c] for g in got for c in (*metrics.COUNTS, "f1_score"))
