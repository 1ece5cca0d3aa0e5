"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, compression, line_dedup, lm_score, mixing, quality, recompress, repeats, simhash, suffix_dedup, topk
from factloom.llm.common import table


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives its text back."""
    return bpe.encode(table(spark, sf_dir, "documents"), keep=["doc_id"], verify=True)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document, and how many lines it lost to earlier ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs, removed="n_removed")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every near-duplicate document and the one it duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps, with their scores."""
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), out="quality_score").drop("text")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus resampled to equal shares of characters for every source."""
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), copy="copy")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability under the model trained on the corpus."""
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best others by inner product, among all embeddings, of those whose id is divisible by 100."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=topk.EVERY).withColumn("score", F.round("score", 6))


def op6_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents within the compression bands, with their ratios."""
    return compression.compression_filter(table(spark, sf_dir, "documents").select("doc_id", "text"), figures=True).drop("text")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of fifty words or more that documents share, by sparse suffix arrays."""
    return suffix_dedup.suffix_repeats(table(spark, sf_dir, "documents"))


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of fifty words or more that documents share, by recompression."""
    return recompress.recompression_repeats(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_mixing": op2_mixing,
    "op3_lm_score": op3_lm_score,
    "op4_topk": op4_topk,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_compression": op6_compression,
    "op7_simhash": op7_simhash,
    "op8_recompression": op8_recompression,
    "op9_bpe": op9_bpe,
    "op10_line_dedup": op10_line_dedup,
}
SQL: dict[str, str] = {"op2_mixing": mixing.mix_sql(), "op4_topk": topk.TOP_K_SQL, "op5_suffix_dedup": repeats.REPEATS_SQL, "op8_recompression": repeats.REPEATS_SQL, "op10_line_dedup": line_dedup.LINE_SQL}
