"""One query per training-data operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, chat, chunking, langid, mixing, near_vectors, packing, quality, sharding, warc
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_pivot_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_chunk_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.dedup_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "removed_words", "spans", "text")


def op5_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op6_ecoc_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_predictions(table(spark, sf_dir, "documents"))


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_snapshot_collapse_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op9_bagminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_bounded_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_pivot_near_vectors,
        op3_warc_salvage,
        op4_chunk_substring_dedup,
        op5_divergence_quality,
        op6_ecoc_language_id,
        op7_pareto_mixing,
        op8_snapshot_collapse_chat,
        op9_bagminhash_near_duplicates,
        op10_bounded_ring_sharding,
    )
}

ORACLE_SQL = {"op8_snapshot_collapse_chat": chat.ORACLE}
