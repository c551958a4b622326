"""The numbered queries: each applies one operator, with production parameters, to its
whole table, and shapes the columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lociq.llm import bpe, centroids, chat_pairs, decontaminate, discriminant, html_text, importance, licenses, near_duplicates, pii, quality_rules, secrets, token_counts
from lociq.llm.common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary())


def op2_pii_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_documents(table(spark, sf_dir, "documents"))


def op3_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_decontamination_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minhash_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op8_html_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_pairs.segments(chat_pairs.neighbours(table(spark, sf_dir, "conversations")))


def op9_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op12_lloyd_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = (op1_bpe_transducer, op2_pii_boosted_candidates, op3_quality_discriminant, op4_preference_pairs, op5_quality_divergence, op6_decontamination_cgk, op7_minhash_inverted_join, op8_html_block_rules, op9_license_set_join, op10_secret_ownership, op11_token_counts, op12_lloyd_centroids, op13_importance_resampling)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_preference_pairs": chat_pairs.ORACLE, "op12_lloyd_centroids": centroids.oracle()}
