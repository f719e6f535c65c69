"""One query for each operator, over its whole table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import divergence, exact_dedup, filter_audit, licenses, mixing, packing, quality, secret_scan, simhash, token_count, token_files, toxicity, url_filter
from seqloom.llm.oracle import ORACLE


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(docs_of(spark, sf_dir))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(docs_of(spark, sf_dir), width=3, radius=2, seed=42)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(docs_of(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(docs_of(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    return toxicity.scores(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(docs_of(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.resolve(docs_of(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(docs_of(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.counts(docs_of(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(docs_of(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge(pages, url_filter.rule_table(spark), url_filter.reserved(pages))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(docs_of(spark, sf_dir))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(docs_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The operators' queries; the pipeline is registered beside them by the entry module."""
    found = (op1_secret_scan, op2_simhash_near_dedup, op3_source_mixing, op4_token_files, op5_toxicity, op6_license_scan, op7_exact_dedup, op8_quality_rules, op9_token_counts, op10_packing, op11_url_filter, op12_source_divergence, op13_filter_interactions)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
