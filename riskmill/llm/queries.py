"""The operators of this subpackage as registered queries over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from riskmill.llm import (
    bpe, exact_dedup, fim, itq, licenses, line_dedup, minhash, oracle, packing, quality, toxicity, url_filter, warc,
    whitening,
)
from riskmill.llm.shared import table


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_archives(manifest, with_html=False).drop("url")


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op10_embedding_near_dedup(spark, sf_dir):
    return itq.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark, sf_dir):
    return fim.digests(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark, sf_dir):
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def llm_queries():
    import corpus_pipeline  # noqa: F401  the pipeline belongs to this subpackage: both are there, or neither

    own = (
        op1_url_filter, op2_bpe, op3_quality, op4_license_scan, op5_warc, op6_toxicity, op7_minhash, op8_exact_dedup,
        op9_best_fit_packing, op10_embedding_near_dedup, op11_embedding_whitening, op12_fill_in_middle,
        op13_line_dedup, pipeline,
    )
    return {q.__name__: q for q in own}


def llm_oracle_sql():
    return dict(oracle.SQL)
