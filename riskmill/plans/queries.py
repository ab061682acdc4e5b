"""Every operator as a query over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmill.functions.scalars import band, class_label, q
from riskmill.operators import choose, clean, encode, metrics, numbering, profile, rules, smotenc, split, validate, weights
from riskmill.operators.models import (
    BOOSTING, CANDIDATES, EXTREME, FOREST, LOGISTIC, LinearScorer, fit_candidate, lr_gradient,
    score_with,
)
from riskmill.operators.scoring import responses, score_table
from riskmill.plans import crossval, final_fit
from riskmill.plans.fixtures import (
    DOC_SPEC, EVENT_TYPES, ORDER_SPEC, RISK_SPEC, dirty_events, labelled_documents, record_lines, risk_events,
    risk_orders, scored_events, table,
)
from riskmill.session import materialize, new_folder
from riskmill.sources import store, tables
from riskmill.spec import FeatureSpec, ScoringSettings
from riskmill.streaming.score_stream import committed_responses, scored_records, start_responding, start_scoring

FLAG = (0, 1)
DIRTY_RULES = (
    rules.at_most("value"), rules.below("value"), rules.not_in("flag", FLAG), rules.not_in("event_type", EVENT_TYPES),
)
ORDER_RULES = (rules.at_most("o_totalprice"), rules.below("c_acctbal"), rules.not_in("late_year", FLAG))

# A linear model with chosen coefficients, so that scores can be computed elsewhere too.
CHOSEN = LinearScorer(
    intercept=-0.8,
    numeric={"x_num": (50.0, 60.0, 0.45)},
    categorical={"x_cat": {"click": -0.1, "error": 0.55, "purchase": 0.2, "signup": -0.25, "view": 0.05}},
    binary={"x_bin": 0.3},
)
COMBO_SPEC = FeatureSpec(
    key="doc_id", numeric=("n_chars",), categorical=("combo",), binary=("quality",), target="toxic"
)
CV_SCHEMA = (
    "model string, strategy string, mean_recall double, std_recall double, mean_precision double, "
    "mean_f1 double, mean_roc_auc double"
)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places: their last bits depend on the order of summing."""
    return df.select(*[
        F.round(q(f.name), places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else q(f.name)
        for f in df.schema.fields
    ])


def _risk_split(spark, sf):
    return split.stratified_split(risk_events(spark, sf), "target", "row_id")


def _train(spark, sf):
    return _risk_split(spark, sf).filter(F.col("split") == "train").drop("split")


def _fold_metrics(spark, sf):
    scored = scored_events(spark, sf).select(
        F.col("x_cat").alias("model"), F.concat(F.lit("s"), F.col("x_bin")).alias("strategy"), "fold", "label", "score"
    )
    return metrics.fold_metrics(scored, ("model", "strategy", "fold"))


def _cv_summary(spark, sf):
    return choose.cv_summary(_fold_metrics(spark, sf))


def _numbered(summary):
    names = F.array(*[F.lit(t) for t in EVENT_TYPES])
    seq = F.array_position(names, F.col("model")).cast("int") * 2 + F.substring("strategy", 2, 1).cast("int")
    return summary.withColumn("seq", seq)


def describe_orders(spark, sf):
    return rounded(profile.describe_numeric(risk_orders(spark, sf), ["o_totalprice", "c_acctbal"]))


def dup_documents(spark, sf):
    return profile.dup_report(table(spark, sf, "documents").select("text", "lang", "source"), "text")


def _dirty_csv(spark, sf):
    path = new_folder(spark, "csv")
    marked = dirty_events(spark, sf)
    marked = marked.select(*[F.coalesce(q(c).cast("string"), F.lit("N/A")).alias(c) for c in marked.columns])
    tables.write_csv(marked, path)
    return path


def csv_roundtrip(spark, sf):
    return tables.scan_csv(spark, _dirty_csv(spark, sf), "event_id bigint, event_type string, value double, flag int")


def csv_inferred(spark, sf):
    """The same file without a schema: inferred types, then non-missing cells per column."""
    path = _dirty_csv(spark, sf)
    return profile.schema_report(tables.scan_csv(spark, path, tables.infer_csv_schema(spark, path)), "event_id")


def clean_events(spark, sf):
    return clean.clean_table(dirty_events(spark, sf), drop=("flag", "not_there"))


def clean_report(spark, sf):
    return rules.value_equals_counts(
        dirty_events(spark, sf), [("value", None), ("event_type", "error"), ("event_type", "view"), ("flag", 5)]
    )


def rows_with_value(spark, sf):
    kept = clean.drop_missing(dirty_events(spark, sf), "value")
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.count("flag").alias("n_flag"))


def stratified_split_rows(spark, sf):
    return _risk_split(spark, sf).select("row_id", "target", "split")


def split_distribution(spark, sf):
    return split.split_distribution(_risk_split(spark, sf), "target")


def split_documents(spark, sf):
    return split.stratified_split(labelled_documents(spark, sf), "toxic", "doc_id").select("doc_id", "toxic", "split")


def kfold_assignment(spark, sf):
    return split.stratified_kfold(risk_events(spark, sf), "target", "row_id").select("row_id", "target", "fold")


def split_integrity(spark, sf):
    return split.split_integrity(risk_events(spark, sf), _risk_split(spark, sf), "target", "row_id")


def sample_weights(spark, sf):
    weighted = weights.with_balanced_weight(risk_events(spark, sf), "target")
    return rounded(weighted.select("row_id", "target", "weight"))


def sample_weights_positive(spark, sf):
    weighted = weights.with_positive_weight(labelled_documents(spark, sf), "toxic")
    return rounded(weighted.select("doc_id", "toxic", "weight"))


def class_weight_map(spark, sf):
    got = weights.class_weight_map(risk_events(spark, sf), "target")
    return rounded(got.select(F.col("weights")[0].alias("weight_0"), F.col("weights")[1].alias("weight_1")))


def _synthetic(df, spec):
    new = smotenc.synthetic_rows(df, spec)
    return rounded(new.select("base_key", "copy", *spec.numeric, *spec.nominal))


def minority_neighbours(spark, sf):
    near = smotenc.minority_neighbours(risk_orders(spark, sf), ORDER_SPEC)
    return near.select("o_orderkey", F.posexplode("near").alias("position", "entry")).select(
        "o_orderkey", "position", F.col("entry.key").alias("near_key"), F.round("entry.dist", 4).alias("dist")
    )


def scaled_neighbours(spark, sf):
    """Neighbours over two columns of the same spread, where sorting by one of them tells little."""
    orders = risk_orders(spark, sf)
    learned = encode.Encoding.fit(orders, ORDER_SPEC)
    scaled = orders.select("o_orderkey", *[F.round(learned.scaled(c), 6).alias(c) for c in ORDER_SPEC.numeric],
                           *ORDER_SPEC.nominal, "target")
    near = smotenc.minority_neighbours(scaled, ORDER_SPEC)
    return near.select("o_orderkey", F.posexplode("near").alias("position", "entry")).select(
        "o_orderkey", "position", F.col("entry.key").alias("near_key"), F.round("entry.dist", 4).alias("dist")
    )


def smotenc_balance(spark, sf):
    before = risk_events(spark, sf)
    return smotenc.balance_report(before, smotenc.smotenc(before, RISK_SPEC), "target")


def smotenc_integrity(spark, sf):
    """Resampling leaves the originals and the test rows as they are."""
    parts = materialize(_risk_split(spark, sf), "split", ("split",))
    train, test = (parts.filter(F.col("split") == p).drop("split") for p in ("train", "test"))
    after = materialize(smotenc.smotenc(train, RISK_SPEC), "resampled")
    kept = after.filter(~F.col("is_synthetic")).select(train.columns)
    facts = after.agg(
        F.count_if(F.col("is_synthetic")).alias("synthetic"), F.count_if(~F.col("is_synthetic")).alias("originals"),
        F.count_if(F.col("is_synthetic") & (F.col("target") == 0)).alias("synthetic_majority"),
    )
    lost = train.exceptAll(kept).unionByName(kept.exceptAll(train)).agg(F.count("*"))
    leaked = after.join(test, "row_id", "left_semi").agg(F.count("*"))
    return facts.select("*", lost.scalar().alias("changed_rows"), leaked.scalar().alias("test_rows_used"))


def select_features(spark, sf):
    return clean.select_features(risk_orders(spark, sf), ORDER_SPEC)


def scale_numeric(spark, sf):
    learned = encode.Encoding.fit(risk_orders(spark, sf), ORDER_SPEC)
    return rounded(encode.scale_numeric(risk_orders(spark, sf), learned))


def one_hot_long(spark, sf):
    parts = materialize(_risk_split(spark, sf), "split")
    learned = encode.Encoding.fit(parts.filter(F.col("split") == "train"), RISK_SPEC)
    return rounded(encode.encode_long(parts, learned))


def encoded_tables(spark, sf):
    """Train and test matrices written and read back, summed per slot."""
    parts = materialize(_risk_split(spark, sf), "split")
    learned = encode.Encoding.fit(parts.filter(F.col("split") == "train"), RISK_SPEC)
    path = new_folder(spark, "encoded")
    encode.write_encoded(parts, learned, path)
    return rounded(tables.scan_parquet(spark, path).groupBy("split", "target", "slot").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    ), 4)


def vector_slots(spark, sf):
    """The ML vector column read back slot by slot, by position name."""
    from pyspark.ml.functions import vector_to_array

    learned = encode.Encoding.fit(risk_events(spark, sf), RISK_SPEC)
    names = F.array(*[F.lit(n) for n in learned.slots()])
    vectors = encode.encode(risk_events(spark, sf), learned)
    cells = vectors.select("row_id", F.posexplode(vector_to_array("features")).alias("position", "value"))
    return rounded(cells.select("row_id", names[F.col("position")].alias("slot"), "value").filter("value <> 0"))


def slot_names(spark, sf):
    return encode.slot_names(risk_events(spark, sf), encode.Encoding.fit(risk_events(spark, sf), RISK_SPEC))


def encode_unseen(spark, sf):
    docs = labelled_documents(spark, sf).withColumn("combo", F.concat_ws("/", "lang", "source"))
    parts = split.stratified_split(docs, "toxic", "doc_id")
    learned = encode.Encoding.fit(parts.filter(F.col("split") == "train"), COMBO_SPEC)
    test = parts.filter(F.col("split") == "test")
    cats = encode.encode_long(test, learned).filter(F.col("slot").startswith("cat__"))
    return test.join(cats, "doc_id", "left").select("doc_id", "combo", F.col("slot").isNotNull().alias("seen"))


def _scored(spark, sf):
    return scored_events(spark, sf)


def confusion_by_fold(spark, sf):
    return metrics.confusion(_scored(spark, sf), 0.5, ("fold",))


def decisions(spark, sf):
    """Band, both decision modes and the label text of every score."""
    from riskmill.functions.scalars import decide

    score = F.col("score")
    at = decide(score, 0.5)
    return _scored(spark, sf).select(
        "row_id", "score", band(score, ScoringSettings()).alias("risk_band"), at.alias("prediction"),
        decide(score, 0.5, inclusive=False).alias("strict_prediction"), class_label(at).alias("predicted_class"),
    )


def row_numbers(spark, sf):
    """Order lines have no key: the same order and line number occur several times."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    numbered = numbering.row_numbers(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    return numbered.select("row_id", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("double").alias("l_quantity"))


def roc_points_thin(spark, sf):
    """A rare label ordered by a fine score: most points lie inside long horizontal runs."""
    scored = risk_events(spark, sf).select(F.col("target").alias("label"), F.col("x_num").alias("score"))
    return rounded(metrics.roc_points(scored, thin=True))


def metric_compare(spark, sf):
    scored = _scored(spark, sf)
    proposed = choose.choose_threshold(metrics.threshold_sweep(scored)).first()["threshold"]
    return rounded(metrics.metric_compare(scored, proposed))


def evaluation_report(spark, sf):
    scored = _scored(spark, sf)
    proposed = choose.choose_threshold(metrics.threshold_sweep(scored)).first()["threshold"]
    return rounded(metrics.evaluation_report(scored, proposed, model="hash score"))


def cv_stability(spark, sf):
    path = new_folder(spark, "cv")
    tables.write_csv(_cv_summary(spark, sf), path)
    stored = tables.stored_metrics(spark, path, CV_SCHEMA)
    tested = metrics.metrics_at(_scored(spark, sf), 0.5)
    return rounded(choose.cv_stability(stored, "error", "s1", tested))


def metrics_lookup(spark, sf):
    path = new_folder(spark, "cv")
    tables.write_csv(_cv_summary(spark, sf), path)
    missing = tables.stored_metrics(spark, path + "-none", CV_SCHEMA)
    stored = tables.stored_metrics(spark, path, CV_SCHEMA).unionByName(missing)
    return rounded(tables.look_up(stored, model="view", strategy="s0"))


def _optimality(spark, sf, strategy):
    train = materialize(_train(spark, sf), "train")
    fitted = fit_candidate(train, RISK_SPEC, LOGISTIC, strategy)
    gradient = lr_gradient(train, fitted)
    return gradient.select("slot", (F.abs("gradient") < 1e-6).alias("at_optimum"))


def _cv(spark, sf, candidates):
    rows = crossval.split_rows(risk_events(spark, sf), RISK_SPEC)
    train = rows.filter(F.col("split") == "train").drop("split")
    folds = crossval.fold_rows(train, RISK_SPEC)
    scores = crossval.out_of_fold_scores(folds, RISK_SPEC, candidates)
    return rounded(crossval.cv_results(scores), 4)


def cv_grid(spark, sf):
    """All ten candidates, five folds, with the full settings."""
    return _cv(spark, sf, CANDIDATES)


def cv_grid_trees(spark, sf):
    """The seven tree candidates of the same grid."""
    return _cv(spark, sf, [c for c in CANDIDATES if c[0] != LOGISTIC])


def oof_scores(spark, sf):
    scores = final_fit.oof_scores(_train(spark, sf), RISK_SPEC, (LOGISTIC, "class_weight"))
    return scores.select(
        F.col("key").cast("bigint").alias("row_id"), "fold", "label", F.round("score", 6).alias("score")
    )


def cv_logistic(spark, sf):
    """Fold metrics of the two logistic candidates that learn from the rows as they are."""
    rows = crossval.split_rows(risk_events(spark, sf), RISK_SPEC)
    folds = crossval.fold_rows(rows.filter(F.col("split") == "train").drop("split"), RISK_SPEC)
    scores = crossval.out_of_fold_scores(folds, RISK_SPEC, [(LOGISTIC, "baseline"), (LOGISTIC, "class_weight")])
    return rounded(crossval.cv_fold_metrics(scores).drop("seq"))


def candidate_summary(spark, sf):
    return rounded(crossval.candidate_summary(risk_events(spark, sf), RISK_SPEC), 4)


def final_fit_report(spark, sf):
    return rounded(final_fit.final_report(risk_events(spark, sf), RISK_SPEC), 4)


def _tested(spark, sf, model, strategy):
    fitted, _, test = final_fit.final_fit(risk_events(spark, sf), RISK_SPEC, (model, strategy))
    tested = crossval.evaluate_once(fitted, test, RISK_SPEC)
    return rounded(tested.withColumn("model", F.lit(model)).withColumn("strategy", F.lit(strategy)), 4)


def linear_expression(spark, sf):
    """The model's probability and its native expression, compared row by row."""
    train = materialize(_train(spark, sf), "train")
    fitted = fit_candidate(train, RISK_SPEC, LOGISTIC, "class_weight")
    native = LinearScorer.from_fitted(fitted).probability()
    both = fitted.score(risk_events(spark, sf)).withColumn("native", native)
    return both.agg(
        F.count("*").alias("n_rows"), F.count_if(F.abs(F.col("score") - F.col("native")) > 1e-12).alias("n_different")
    )


def saved_model_roundtrip(spark, sf):
    path = new_folder(spark, "bundle")
    train = materialize(_train(spark, sf), "train")
    fitted = fit_candidate(train, RISK_SPEC, LOGISTIC, "class_weight")
    store.save_bundle(spark, fitted, path)
    loaded = store.load_bundle(spark, path)
    before = fitted.score(risk_events(spark, sf)).withColumnRenamed("score", "before")
    return score_with(loaded.stages, before).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("score") != F.col("before")).alias("n_different"),
        F.lit(loaded.spec.features == RISK_SPEC.features and loaded.settings == ScoringSettings()).alias("same_settings"),
    )


def _checked(spark, sf):
    return validate.validate_records(record_lines(spark, sf), RISK_SPEC)


def validate_records(spark, sf):
    return _checked(spark, sf).select("row_id", F.array_join("errors", " | ").alias("errors"))


def form_scores(spark, sf):
    """Events typed into a form, with blanks around numbers and some fields empty: sent, checked and scored."""
    eid = F.col("event_id")
    typed = table(spark, sf, "events").select(
        eid.alias("row_id"),
        F.when(eid % 9 == 0, F.lit(" \t")).when(eid % 9 == 1, F.lit(" ten "))
        .otherwise(F.concat(F.lit("  "), F.col("value").cast("string"), F.lit("\t "))).alias("x_num"),
        F.col("event_type").alias("x_cat"), F.concat(F.lit(" "), (F.col("user_id") % 2).cast("string")).alias("x_bin"),
    )
    checked = validate.validate_records(validate.form_records(typed, RISK_SPEC), RISK_SPEC)
    return score_table(checked, RISK_SPEC, CHOSEN).select(
        "row_id", "risk_score", "prediction", "valid", F.array_join("errors", " | ").alias("errors")
    )


def quarantine_split(spark, sf):
    good, bad = validate.split_valid(_checked(spark, sf))
    return good.select("row_id", *RISK_SPEC.features, F.lit("valid").alias("side")).unionByName(
        bad.select("row_id", *[F.lit(None).cast(good.schema[c].dataType).alias(c) for c in RISK_SPEC.features],
                   F.lit("rejected").alias("side"))
    )


def _score_table(spark, sf):
    return score_table(_checked(spark, sf), RISK_SPEC, CHOSEN)


def score_records(spark, sf):
    return _score_table(spark, sf).select(
        "row_id", "risk_score", "prediction", "risk_category", "threshold_used", "valid",
        F.array_join("errors", " | ").alias("errors"),
    )


def response_json(spark, sf):
    return responses(_score_table(spark, sf)).select("row_id", "response")


def stream_score(spark, sf):
    """The same records as files of JSON lines, scored by a stream."""
    source, out, state = (new_folder(spark, f"stream-{part}") for part in ("in", "out", "state"))
    record_lines(spark, sf).select("body").write.text(source)
    query = start_scoring(tables.json_lines(spark, source, stream=True), out, state, RISK_SPEC, CHOSEN)
    query.awaitTermination()
    return scored_records(spark, out).select(
        "body", "risk_score", "prediction", "risk_category", "valid", F.array_join("errors", " | ").alias("errors")
    )


def stream_response(spark, sf):
    """The same stream, answered with response records."""
    source, out, state = (new_folder(spark, f"stream-{part}") for part in ("in", "out", "state"))
    record_lines(spark, sf).select("body").write.text(source)
    query = start_responding(tables.json_lines(spark, source, stream=True), out, state, RISK_SPEC, CHOSEN)
    query.awaitTermination()
    return committed_responses(spark, out).select("body", "response", "accepted")


def domain_membership(spark, sf):
    """Event records whose category is in no row of the discovered domain table."""
    domain = profile.domain_discovery(risk_events(spark, sf), ["x_cat"])
    records = _checked(spark, sf).select("row_id", "x_cat").filter("x_cat is not null")
    return validate.unknown_categories(records, domain, "x_cat")


def all_queries():
    on_dirty = {
        "null_report": lambda d: profile.null_report(d),
        "dup_report": lambda d: profile.dup_report(d, "event_id"),
        "value_counts": lambda d: profile.value_counts(d, ["event_type", "flag"]),
        "describe_numeric": lambda d: rounded(profile.describe_numeric(d, ["value"])),
        "describe_mixed": lambda d: rounded(profile.describe_mixed(d)),
        "schema_report": lambda d: profile.schema_report(d, "event_id"),
        "table_shape": profile.table_shape,
        "role_inference": lambda d: profile.role_inference(d, ["value", "flag", "event_type"]),
        "quality_summary": lambda d: profile.quality_summary(d, "event_id", "flag", DIRTY_RULES),
        "rule_counts": lambda d: rules.rule_counts(d, DIRTY_RULES),
        "rule_violations": lambda d: rules.violations_report(d, DIRTY_RULES),
        "domain_violations": lambda d: rules.violating_rows(d, DIRTY_RULES[2:]),
        "numeric_extremes": lambda d: rules.numeric_extremes(d, ["value", "flag"]),
        "head_tail": lambda d: profile.head_tail(d, "event_id"),
        "domain_discovery": lambda d: profile.domain_discovery(d, ["event_type", "flag"]),
    }
    on_risk = {
        "class_distribution": lambda d: profile.class_distribution(d, "target"),
        "majority_baseline": lambda d: rounded(split.majority_baseline(d, "target")),
        "class_weights": lambda d: rounded(weights.class_weights(d, "target")),
        "positive_weight": lambda d: rounded(weights.positive_weight(d, "target")),
        "smotenc_rows": lambda d: _synthetic(d, RISK_SPEC),
    }
    on_scored = {
        "confusion": lambda d: metrics.confusion(d, 0.5),
        "metrics_at_threshold": lambda d: rounded(metrics.metrics_at(d, 0.45)),
        "roc_auc": lambda d: rounded(metrics.roc_auc(d)),
        "average_precision": lambda d: rounded(metrics.average_precision(d)),
        "ranking_by_fold": lambda d: rounded(metrics.ranking_metrics(d, ("fold",))),
        "roc_points": lambda d: rounded(metrics.roc_points(d)),
        "pr_points": lambda d: rounded(metrics.pr_points(d)),
        "threshold_sweep": lambda d: rounded(metrics.threshold_sweep(d)),
        "threshold_choice": lambda d: rounded(choose.choose_threshold(metrics.threshold_sweep(d))),
        "no_skill_rate": lambda d: rounded(metrics.no_skill_rate(d)),
        "error_analysis": lambda d: rounded(metrics.error_analysis(d, 0.45)),
    }

    def over(source, make):
        return lambda spark, sf: make(source(spark, sf))

    found = {}
    for source, group in ((dirty_events, on_dirty), (risk_events, on_risk), (scored_events, on_scored)):
        found |= {name: over(source, make) for name, make in group.items()}
    found |= {
        "describe_orders": describe_orders,
        "null_report_documents": lambda s, sf: profile.null_report(table(s, sf, "documents")),
        "dup_documents": dup_documents,
        "value_counts_orders": lambda s, sf: profile.value_counts(
            table(s, sf, "orders"), ["o_orderstatus", "o_orderpriority"]
        ),
        "histogram": lambda s, sf: rounded(profile.histogram(dirty_events(s, sf), "value")),
        "histogram_orders": lambda s, sf: rounded(profile.histogram(table(s, sf, "orders"), "o_totalprice")),
        "rule_violations_orders": lambda s, sf: rules.violations_report(risk_orders(s, sf), ORDER_RULES),
        "csv_roundtrip": csv_roundtrip,
        "csv_inferred": csv_inferred,
        "clean_table": clean_events,
        "clean_report": clean_report,
        "rows_with_value": rows_with_value,
        "stratified_split": stratified_split_rows,
        "split_distribution": split_distribution,
        "split_documents": split_documents,
        "kfold_assignment": kfold_assignment,
        "split_integrity": split_integrity,
        "sample_weights": sample_weights,
        "sample_weights_positive": sample_weights_positive,
        "class_weight_map": class_weight_map,
        "smotenc_documents": lambda s, sf: _synthetic(labelled_documents(s, sf), DOC_SPEC),
        "minority_neighbours": minority_neighbours,
        "scaled_neighbours": scaled_neighbours,
        "smotenc_balance": smotenc_balance,
        "smotenc_integrity": smotenc_integrity,
        "select_features": select_features,
        "scale_numeric": scale_numeric,
        "one_hot_long": one_hot_long,
        "encoded_tables": encoded_tables,
        "vector_slots": vector_slots,
        "slot_names": slot_names,
        "encode_unseen": encode_unseen,
        "confusion_by_fold": confusion_by_fold,
        "decisions": decisions,
        "metric_compare": metric_compare,
        "row_numbers": row_numbers,
        "roc_points_thin": roc_points_thin,
        "evaluation_report": evaluation_report,
        "fold_metrics": lambda s, sf: rounded(_fold_metrics(s, sf)),
        "cv_summary": lambda s, sf: rounded(_cv_summary(s, sf)),
        "select_candidate": lambda s, sf: rounded(choose.select_candidate(_numbered(_cv_summary(s, sf)))),
        "select_candidate_floor": lambda s, sf: rounded(choose.select_candidate(_numbered(_cv_summary(s, sf)), 0.3)),
        "cv_stability": cv_stability,
        "metrics_lookup": metrics_lookup,
        "lr_optimality": lambda s, sf: _optimality(s, sf, "baseline"),
        "lr_weighted_optimality": lambda s, sf: _optimality(s, sf, "class_weight"),
        "cv_grid": cv_grid,
        "cv_grid_trees": cv_grid_trees,
        "cv_logistic": cv_logistic,
        "oof_scores": oof_scores,
        "candidate_summary": candidate_summary,
        "final_fit_report": final_fit_report,
        "rf_fit": lambda s, sf: _tested(s, sf, FOREST, "class_weight"),
        "gbt_fit": lambda s, sf: _tested(s, sf, BOOSTING, "sample_weight"),
        "extreme_fit": lambda s, sf: _tested(s, sf, EXTREME, "scale_pos_weight"),
        "linear_expression": linear_expression,
        "saved_model_roundtrip": saved_model_roundtrip,
        "validate_records": validate_records,
        "quarantine_split": quarantine_split,
        "form_scores": form_scores,
        "domain_membership": domain_membership,
        "score_table": score_records,
        "response_json": response_json,
        "stream_score": stream_score,
        "stream_response": stream_response,
    }
    return found
