"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.llm import ann, bpe, lm, mixing, neardup, pii, quality, sharding, suffix, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and model score of every document."""
    return lm.score(_docs(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.taken(_docs(spark, sf_dir))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document."""
    return neardup.dedup(_docs(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated passages leave of every document."""
    return suffix.dedup(_docs(spark, sf_dir), ("n_bytes", "n_removed", "n_spans", "kept_sha256"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every query vector."""
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans, of every document."""
    own = pii.find(_docs(spark, sf_dir))
    return own.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    import public_tokenizers as tokenizers

    return bpe.encode(_docs(spark, sf_dir), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base verdict and verdict of every document."""
    return quality.rules(_docs(spark, sf_dir)).drop("q_class_distance", "q_word_distance")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, for 24 shards, and its shard of 25."""
    own = sharding.shard(_docs(spark, sf_dir), 24)
    return own.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_mixing": op2_mixing,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_neighbours": op5_neighbours,
    "op6_toxicity": op6_toxicity,
    "op7_personal_data": op7_personal_data,
    "op8_bpe": op8_bpe,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
}
