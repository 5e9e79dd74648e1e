"""One registered query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patentkin.llm import (
    decontaminate, fingerprints, language, line_dedup, near_dedup, packing, quality, secrets, spelling, token_counts,
    toxicity, url_filters, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole texts and of edited ones."""
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


@_query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components by four-word shingles."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), size=4)


@_query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked credential parts in whole texts."""
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


@_query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside ten-word windows of benchmark items."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@_query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language mixture of every document."""
    found = language.language_mixture(_table(spark, sf_dir, "documents"))
    return found.withColumn("langs", F.array_join("langs", ","))


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are later copies of repeated runs, and the text that is left."""
    marked = line_dedup.mark_lines(_table(spark, sf_dir, "documents"))
    return marked.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.size("deleted").cast("long").alias("n_deleted"),
        F.array_join(F.col("deleted").cast("array<string>"), ",").alias("deleted_lines"),
        line_dedup.without_lines().alias("text"),
    )


@_query
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the filter rules on every page's URL."""
    return url_filters.judge(_table(spark, sf_dir, "pages"))


@_query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and offending spans of every document."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


@_query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words with the form that they are variants of."""
    return spelling.spelling_groups(_table(spark, sf_dir, "documents"))


@_query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector; deviation is null where it is no long any more."""
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))
