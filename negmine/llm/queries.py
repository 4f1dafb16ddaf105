"""The registered queries of this subpackage: every operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from negmine.llm import (bpe, decontaminate, divergence, language_crf, line_dedup, parity_join, period_runs, quality_gam, repeats,
                         risk_rules, sharding, template_removal, token_counts)
from negmine.shipping import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_removal.main_text(_table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_table(token_counts.token_lengths(_table(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_gam.score_quality(docs, quality_gam.learn(docs, _table(spark, sf_dir, "labels")))


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_crf.identify(docs, language_crf.learn(docs))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(_table(spark, sf_dir, "documents"))


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = period_runs.with_periods(_table(spark, sf_dir, "documents"))
    return period_runs.digests(period_runs.collapse_runs(docs))


QUERIES = {f.__name__: f for f in (
    op1_template_removal, op2_decontamination, op3_repeats, op4_token_counts, op5_line_dedup, op6_quality, op7_parity_join, op8_language, op9_rules, op10_bpe,
    op11_divergence, op12_sharding, op13_period_runs)}
