"""A training-corpus pipeline: quality rules, near-duplicates, benchmark leaks, personal
data, token ids. Each stage reads what the stage before it has written, and works on every
document that was kept; all but the last return the columns of documents. Verdicts are on
rows and not on ids: rows whose id is null or repeated are judged by their own text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.llm import bpe, decontaminate, near_duplicates, pii, quality_rules
from lociq.llm.common import keyed, shared_dir, table
from lociq.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    rows = keyed(docs)
    kept = quality_rules.judge(rows, "row_key").where("kept").select("row_key").distinct()
    return rows.join(kept, "row_key", "left_semi").select(*docs.columns)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, on five-word shingles at 0.8: that of
    the smallest id, and one without an id only where none has any. Rows without words are
    copies of nothing; of rows alike in all columns one stays."""
    rows = keyed(docs)
    groups = near_duplicates.near_duplicates(rows, "row_key", width=5, percent=80).select("row_key", "component_id").distinct()
    named = rows.select("row_key", "doc_id").distinct().join(groups, "row_key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first"))
    return rows.join(first.select("first.row_key"), "row_key", "left_semi").dropDuplicates(["row_key"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes a tag of its kind; the length column follows."""
    return pii.redact_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, vocabulary(), with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicate_groups),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("token ids", token_ids),
]

#: SQL cannot state BPE or the boosted spans; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{at}/stage-{k}")
        docs = spark.read.parquet(f"{at}/stage-{k}")
    return docs
