"""One registered query per operator, with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontamination, exact_index, fill_middle, jaccard_join, language_id, language_model, mixing
from tickloom.llm import oracles, quality_model
from tickloom.llm import quality_rules as rules
from tickloom.llm import secrets, sharding, source_audit, toxicity
from tickloom.llm.settings import MIX_RATE, MIX_TARGETS, SHARD_TREE

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"), SHARD_TREE)


def op2_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"), size=3, percent=90)


def op3_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs, MIX_TARGETS, MIX_RATE).select(
        "row.doc_id",
        F.col("source").alias("source_group"),
        F.col("lang").alias("lang_group"),
        "topic",
        "tokens",
        F.round("weight", 6).alias("weight"),
        F.round("probability", 6).alias("probability"),
        "sampled",
    )


def op4_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6))


def op6_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_log_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"))


def op8_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op9_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op10_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.drop("failed_rule")


def op11_wavelet_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_digest(table(spark, sf_dir, "documents"))


def op12_packed_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_sources(table(spark, sf_dir, "documents"), min_docs=10, top=10)


def op13_extendible_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_index.mark_copies(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_hash_tree_shards,
        op2_set_relation_join,
        op3_raked_mix,
        op4_attention_quality,
        op5_benchmark_leaks,
        op6_kneser_ney_toxicity,
        op7_log_bilinear_scores,
        op8_hyperdimensional_language,
        op9_forest_secret_scan,
        op10_rule_cascade,
        op11_wavelet_fill_middle,
        op12_packed_source_audit,
        op13_extendible_exact_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL | {"op3_raked_mix": oracles.mix_sql(MIX_TARGETS, MIX_RATE, mixing.SWEEPS)}
