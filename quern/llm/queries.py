"""The queries of this subpackage: each dealt operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hash_forest, html_text, importance, jaccard_join, packing, pii, quality, sharding, spelling, substring_dedup, toxicity, url_reputation
from .support import read_table


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge_urls(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


def op2_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard_rows(read_table(spark, sf_dir, "documents")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(read_table(spark, sf_dir, "documents")))


def op6_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.digest(quality.judge(docs, quality.fit(docs, read_table(spark, sf_dir, "labels"))))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents")))


def op9_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score_toxicity(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels"))))


def op10_html_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read_table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


def op12_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.digest(importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_reputation, op2_hypergeometric_sharding, op3_benchmark_decontamination, op4_ngram_jaccard_join, op5_pii_spans,
        op6_nnls_packing, op7_quality_rules, op8_substring_dedup, op9_crf_toxicity, op10_html_rendering,
        op11_spelling_variants, op12_hash_prefix_forest, op13_importance_resampling,
    )
}

#: The others hash words, run models or read bytes in ways that SQL can't; tests hold them against plain loops.
ORACLE_SQL: dict[str, str] = {
    "op1_url_reputation": url_reputation.oracle_sql(),
    "op4_ngram_jaccard_join": jaccard_join.oracle_sql(),
    "op8_substring_dedup": substring_dedup.oracle_sql(),
    "op11_spelling_variants": spelling.oracle_sql(),
    "op13_importance_resampling": importance.oracle_sql(),
}
