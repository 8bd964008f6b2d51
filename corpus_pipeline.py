"""The corpus pipeline: five stages from `documents` to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents. Texts move only where a stage changes or repeats them:
what is dropped or changed is told apart by a bitmap of fixed size first.

A stage's result is read from its scratch tables, so they are removed when the
next stage begins, whose docs have been written by then: the shared folder never
holds the scratch tables of two stages.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright import ship
from linkwright.llm import bagminhash, chunking, langid, mixing, packing
from linkwright.llm.common import materialize, maybe_in, table
from linkwright.session import made_since, remove

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_left: list[str] = []


def _stage(f):
    """A stage that ships the library, and that removes the scratch tables of the stage before it (the first one none)."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        if f.__name__ != STAGES[0][1].__name__:
            remove(spark, _left)
        n = len(made_since())
        found = f(spark, docs.select(*COLUMNS), sf_dir)
        _left[:] = made_since(n)
        return found

    return run


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language go on; those without letters and ambiguous ones go."""
    found = langid.identify(docs)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).select(*COLUMNS)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id; of rows with the same doc_id, that whose text has the smallest hash."""
    found = bagminhash.near_duplicates(docs)
    groups = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    touched = materialize(groups.where("not kept or n > 1"), "near-touched")
    marked = maybe_in(docs, "doc_id", touched.select("doc_id"))
    some = marked.where("_maybe").select(*COLUMNS)
    untouched = some.join(touched.select("doc_id"), "doc_id", "left_anti")
    repeated = some.join(touched.where("kept").select("doc_id"), "doc_id", "left_semi")
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), *COLUMNS[1:])).alias("first")  # no matter in which order rows come
    repeated = repeated.groupBy("doc_id").agg(first).select("doc_id", *(f"first.{c}" for c in COLUMNS[1:]))
    return marked.where(~F.col("_maybe")).select(*COLUMNS).unionByName(untouched).unionByName(repeated)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a document of which no word is left goes."""
    found = chunking.dedup_passages(docs)
    emptied = (F.col("removed_words") > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = found.where(~emptied).withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*COLUMNS)


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = mixing.mix_sources(docs).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    mixed = materialize(mixed.withColumnRenamed("doc_id", "id"), "mix-chosen")
    chosen = maybe_in(docs, "doc_id", mixed.select("id")).where("_maybe").select(*COLUMNS)
    taken = chosen.join(mixed, F.col("doc_id").eqNullSafe(F.col("id")))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All copies of all documents, in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: The stages' hashes and tokenizer are not in SQL's reach; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
