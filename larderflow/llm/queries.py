"""Queries of the training-data operators, with production parameters, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_paths, jaccard_join, kn_quality, mixing, near_vectors, packing, secret_scan, sharding, simple8b, topk
from .common import table


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.groups(table(spark, sf_dir, "embeddings"))


def near_embeddings_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 over all embeddings and a near copy of each, as the given tables may hold none."""
    return near_vectors.groups(near_vectors.with_copies(table(spark, sf_dir, "embeddings")))


def op4_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract(table(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.secrets(docs, secret_scan.train(docs, table(spark, sf_dir, "labels")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"))


def op7_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op8_related_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.simple8b(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith(("op", "near_embeddings")) and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_near_embeddings": near_vectors.SQL, "near_embeddings_of_copies": near_vectors.COPIES_SQL, "op6_ngram_jaccard": jaccard_join.SQL, "op7_threshold_topk": topk.SQL, "op10_sharding": sharding.SQL}
