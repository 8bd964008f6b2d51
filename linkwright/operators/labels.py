"""Labels, splits and samples of labelled candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label(candidates: DataFrame, positives: DataFrame) -> DataFrame:
    """The candidates with label 1 if they are among the positive pairs, else 0 (J-3)."""
    yes = positives.select("source1_entity_id", "other_id").distinct().withColumn("label", F.lit(1))
    return candidates.join(yes, ["source1_entity_id", "other_id"], "left").fillna(0, subset=["label"])


def recall_ceiling(candidates: DataFrame, positives: DataFrame) -> DataFrame:
    """recovered, positives and recall (1 if there are no positives) of blocking (J-5, A-7)."""
    pairs = positives.select("source1_entity_id", "other_id").distinct()
    found = candidates.select("source1_entity_id", "other_id").distinct().withColumn("_found", F.lit(1))
    counts = pairs.join(found, ["source1_entity_id", "other_id"], "left").agg(F.count("_found").alias("recovered"), F.count(F.lit(1)).alias("positives"))
    return counts.withColumn("recall", F.when(F.col("positives") == 0, F.lit(1.0)).otherwise(F.col("recovered") / F.col("positives")))


def hash_share(id_: Column, seed: int = 42) -> Column:
    """A number from 0 to 1 by the id: the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), id_)), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def split(rows: DataFrame, held_out: float = 0.2, seed: int = 42, by: str = "source1_entity_id") -> DataFrame:
    """The rows with a boolean `held_out` that all rows of an id share (M-5, M-6)."""
    return rows.withColumn("held_out", hash_share(F.col(by), seed) < held_out)


def sample_ids(ids: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n ids of the first column, by hash (M-7); fewer if there are fewer."""
    name = ids.columns[0]
    return ids.select(name).distinct().orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), name)), name).limit(n)


def keep_ids(rows: DataFrame, ids: DataFrame, by: str = "source1_entity_id") -> DataFrame:
    """The rows of the ids (J-4)."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias(by)), by, "left_semi")


def class_weights(labelled: DataFrame) -> DataFrame:
    """label, n and the balanced weight n_all / (2 n) (M-3, A-9)."""
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", (F.col("total") / (2 * F.col("n"))).alias("weight"))  # two rows by one
