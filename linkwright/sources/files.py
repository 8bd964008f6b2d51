"""Tab-separated and Parquet readers, id-list writers, score caches and sidecars."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

RECORD_COLUMNS = ("entity_id", "business_name", "business_address", "country")
RECORDS = StructType([StructField(c, StringType()) for c in RECORD_COLUMNS])
TRUTH = StructType([StructField(c, StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
SCORED = StructType([*(StructField(c, StringType()) for c in ("source1_entity_id", "other_id", "source")), StructField("score", DoubleType())])
LABELLED = StructType([*SCORED.fields, StructField("label", IntegerType())])


def _tsv(spark: SparkSession):
    return spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8")


def require(df: DataFrame, columns: tuple[str, ...] = RECORD_COLUMNS, what: str = "the relation") -> DataFrame:
    """df, or a ValueError that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def no_nulls(df: DataFrame) -> DataFrame:
    return df.select(*(F.coalesce(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in df.schema.fields))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A record table (IO-1): all columns are text, missing values empty, extra columns kept, order free."""
    return no_nulls(require(_tsv(spark).csv(path), RECORD_COLUMNS, path))


def read_records_parquet(spark: SparkSession, path: str) -> DataFrame:
    df = require(spark.read.parquet(path), RECORD_COLUMNS, path)
    return no_nulls(df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns)))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth (IO-2): one row per source-1 id with a comma-separated list."""
    return no_nulls(require(_tsv(spark).csv(path), tuple(TRUTH.names), path).select(*TRUTH.names))


def truth_pairs(truth: DataFrame) -> DataFrame:
    """Distinct positive pairs (IO-3): source1_entity_id, other_id."""
    ids = F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x))
    return truth.select("source1_entity_id", F.explode(ids).alias("other_id")).where("other_id <> ''").dropDuplicates()


def id_lists(pairs: DataFrame, ids: DataFrame, column: str, order: list[Column] | None = None) -> DataFrame:
    """One row per id of `ids` (its first column), with the ordered, distinct list of its pairs' other_id (IO-4)."""
    name = ids.columns[0]
    order = order or ([F.desc("score"), F.asc("other_id")] if "score" in pairs.columns else [F.asc("other_id")])
    line = Window.partitionBy("source1_entity_id").orderBy(*order)
    ranked = pairs.withColumn("_at", F.row_number().over(line)).groupBy("source1_entity_id", "other_id").agg(F.min("_at").alias("_at"))
    lists = ranked.groupBy("source1_entity_id").agg(F.array_sort(F.collect_list(F.struct("_at", "other_id"))).alias("_ids"))
    lists = lists.select("source1_entity_id", F.array_join(F.transform("_ids", lambda x: x["other_id"]), ",").alias(column))
    every = ids.select(F.col(name).alias("source1_entity_id"))
    return every.join(lists, "source1_entity_id", "left").select("source1_entity_id", F.coalesce(column, F.lit("")).alias(column))


def write_id_lists(lists: DataFrame, path: str, one_file: bool = False) -> None:
    """Write id lists as tab-separated text; no quotes, an empty list as an empty field.

    Ids must hold neither tabs, commas nor line ends. one_file sorts by id into
    a single part, for results that a person hands in.
    """
    out = lists.coalesce(1).sortWithinPartitions(lists.columns[0]) if one_file else lists
    out.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "").csv(path)


def read_id_lists(spark: SparkSession, path: str, column: str) -> DataFrame:
    """source1_entity_id and ids, an array without empty entries (IO-13)."""
    df = require(_tsv(spark).csv(path), ("source1_entity_id", column), path)
    ids = F.filter(F.split(F.coalesce(column, F.lit("")), ","), lambda x: x != "")
    return df.select("source1_entity_id", ids.alias("ids"))


def write_scores(scored: DataFrame, path: str, tsv: bool = False) -> None:
    """Cache of scored pairs (IO-5, IO-6): Parquet, or tab-separated text to exchange."""
    names = [c for c in LABELLED.names if c in scored.columns]
    out = scored.select(*names).write.mode("overwrite")
    out.option("sep", "\t").option("header", True).csv(path) if tsv else out.parquet(path)


def read_scores(spark: SparkSession, path: str, tsv: bool = False) -> DataFrame:
    """Scored pairs with ids as text and score as double (IO-7)."""
    if not tsv:
        return spark.read.parquet(path)
    df = _tsv(spark).csv(path)
    kinds = {f.name: f.dataType for f in LABELLED.fields}
    return df.select(*(F.col(c).cast(kinds.get(c, StringType())).alias(c) for c in df.columns))


def write_sidecar(spark: SparkSession, values: dict, path: str) -> None:
    """A run's numbers as one JSON line (IO-9, IO-12), in any store Spark writes to."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_sidecar(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
