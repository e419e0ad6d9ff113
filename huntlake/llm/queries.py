"""One query for each corpus operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from huntlake.llm import align, decontaminate, html_text, packing, ppm, pstable, quality, rlbwt, secrets, simhash, tokenfile, variants, warc

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_secret_scan(spark, sf_dir):
    return secrets.secret_digest(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


@query
def op2_suffix_dedup(spark, sf_dir):
    return rlbwt.remove_repeats(_table(spark, sf_dir, "documents"))


@query
def op3_warc_capture_index(spark, sf_dir):
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


ORACLE["op3_warc_capture_index"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS response FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < response THEN response END AS refers_to FROM m
"""


@query
def op4_html_extraction(spark, sf_dir):
    return html_text.extract_main_text(_table(spark, sf_dir, "pages"))


@query
def op5_benchmark_decontamination(spark, sf_dir):
    return decontaminate.find_contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=5, threshold=0.8)


@query
def op6_quality_classifier(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


@query
def op7_simhash_near_dedup(spark, sf_dir):
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"), width=3, max_bits=3)


@query
def op8_embedding_near_dedup(spark, sf_dir):
    return pstable.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


@query
def op9_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), capacity=2048)


@query
def op10_lm_scoring(spark, sf_dir):
    return ppm.score_documents(_table(spark, sf_dir, "documents"))


@query
def op11_token_alignment(spark, sf_dir):
    return align.align_documents(_table(spark, sf_dir, "documents"))


@query
def op12_spelling_variants(spark, sf_dir):
    return variants.spelling_groups(_table(spark, sf_dir, "documents"), min_length=5, min_count=3, ratio=2, drop_one_in=97)


@query
def op13_token_files(spark, sf_dir):
    return tokenfile.token_file_round_trip(_table(spark, sf_dir, "documents"))
