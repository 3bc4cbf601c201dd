"""The queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlane.llm import decontaminate, packing, quality, repetition, sharding, simhash, store, styletree, substring, wordgrams

ORACLE: dict[str, str] = {"op10_hash_tree_sharding": sharding.oracle("documents")}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents and the one that is kept in place of each."""
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated passages, and the documents where the passages stay."""
    return substring.dedup(_documents(spark, sf_dir))


def op1_suffix_array_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents within the limits of repetition, with their covered fraction and longest repeat."""
    kept = repetition.accepted(_documents(spark, sf_dir))
    return kept.select("doc_id", F.col("__pl_rep.fraction").alias("repeated_fraction"), F.col("__pl_rep.longest").alias("longest_repeat"))


def op2_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object of the content-addressed store of the documents' token ids."""
    return store.build(_documents(spark, sf_dir))


def op3_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability and bits per byte of every document under the model of them all."""
    return wordgrams.scores(_documents(spark, sf_dir))


def op4_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page without the branches that its site repeats."""
    return styletree.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap benchmark items, with the best overlap of each pair."""
    return decontaminate.overlaps(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin and slot of every document or piece of one."""
    return packing.placed(_documents(spark, sf_dir))


def op8_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, with their score."""
    kept = quality.accepted(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kept.select("doc_id", F.col("__pl_score").alias("score"))


def op10_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, rack and shard of every document."""
    return sharding.assign(_documents(spark, sf_dir).select("doc_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_repetition": op1_suffix_array_repetition,
    "op2_content_store": op2_content_store,
    "op3_backoff_automaton": op3_backoff_automaton,
    "op4_site_style_tree": op4_site_style_tree,
    "op5_spaced_seed_decontamination": op5_spaced_seed_decontamination,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_quadratic_quality": op8_quadratic_quality,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_hash_tree_sharding": op10_hash_tree_sharding,
}
