import numpy as np

from riskmill.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def odd(spark):
    rows = [(1, None, "x", 5), (2, "", "x", 5), (3, "word", "x", 5), (3, "word", "x", 5), (None, "a b", "x", 5),
            (4, "long " * 50_000, "x", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, toxic int")


def test_quality_on_held_out_labels(spark):
    docs, labels = tables(spark)
    model = quality.fit(docs, labels)
    judged = quality.score(docs, model).join(labels.where(quality.held_out(labels.doc_id)), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in judged) >= 0.98 * len(judged)
    got = quality.score(odd(spark), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_without_labels(spark):
    docs, labels = tables(spark)
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score(odd(spark), None).collect()} == {0.5}


def test_toxicity_on_rows_the_fit_has_not_seen(spark):
    docs, labels = tables(spark)
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    judged = toxicity.score(docs, model).withColumnRenamed("toxic", "found").join(labels.where("doc_id % 2 = 1"), "doc_id")
    rows = judged.collect()
    bad = [r for r in rows if r.toxic == 1]
    good = [r for r in rows if r.toxic == 0]
    assert sum(r.found for r in bad) >= 0.75 * len(bad)
    assert sum(r.found for r in good) <= 0.03 * len(good)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = toxicity.score(odd(spark), model).collect()
    assert len(got) == 6 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_of_every_language_with_few_labels(spark):
    """Few labels, and languages that few of them are in, must not leave a text without any feature."""
    docs, labels = tables(spark)
    rest = labels.where("doc_id % 2 = 1").join(docs.select("doc_id", "lang"), "doc_id")
    for per_class, langs in ((50, ("en",)), (200, ("de", "en", "es", "fr"))):
        model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"), toxicity.Fit(per_class=per_class))
        rows = toxicity.score(docs, model).withColumnRenamed("toxic", "found").join(rest, "doc_id").collect()
        for lang in langs:
            bad = [r.found for r in rows if r.toxic == 1 and r.lang == lang]
            assert sum(bad) >= 0.5 * len(bad) > 0
        good = [r.found for r in rows if r.toxic == 0]
        assert sum(good) <= 0.05 * len(good)


def test_toxicity_without_labels(spark):
    docs, labels = tables(spark)
    model = toxicity.fit(docs, labels.limit(0))
    assert all(r.toxic == 0 and r.expected_severity < 1e-9 for r in toxicity.score(odd(spark), model).collect())


def test_ordinal_fit_orders_grades():
    draw = np.random.default_rng(1)
    grades = draw.integers(0, 3, 600)
    x = np.stack([draw.poisson(grades * 2 + 0.05), draw.poisson(1, 600)], 1).astype(np.float32)
    w, t = toxicity.fit_ordinal(x, grades, 3, 0.05, 400)
    assert w[0] > w[1] >= 0 and t[0] < t[1]
