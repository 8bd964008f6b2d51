"""Shared helpers: table access, scratch tables in the shared folder, zipped text batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path, scratch_root  # noqa: F401

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that separate words.
SPACE = r"[\x20\x09-\x0D]+"
#: Bits of a filter of ids: 4 MB, whatever the corpus.
FILTER_BITS = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def slices(sizes, limit: int):
    """Cut a run of items into (from, to) pieces whose sizes sum to about limit."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, by: str, how: str = "left", salts: int = 16) -> DataFrame:
    """Join rows with a lookup that has one row per key, when few keys may hold most rows.

    The lookup is copied `salts` times, and a row goes to the copy that a hash
    of its column `by` names, so that the rows of one key spread over as many tasks.
    """
    copies = lookup.withColumnRenamed(key, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return salted.join(copies, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_copy")), how).drop("_key", "_copy", "_salt")


#: Equal rows that one row of `numbered` is unfolded into within its task.
UNFOLD = 1 << 16


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """The rows, equal ones numbered from 0 by `_nth`, as a written table is read.

    What a rerun finds again without an order of the input: equal rows are
    counted (pre-aggregated, so a row that a third of the table repeats is one
    row per task) and unfolded again, those with more than UNFOLD copies by
    several tasks.
    """
    counted = materialize(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")), name)
    few = counted.where(F.col("_n") <= UNFOLD).withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    many = counted.where(F.col("_n") > UNFOLD).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(UNFOLD).cast("long"))))
    many = many.repartition(*rows.columns, "_from").withColumn("_nth", F.explode(F.sequence("_from", F.least(F.col("_from") + UNFOLD, F.col("_n")) - 1)))
    return few.unionByName(many.drop("_from")).drop("_n")


def maybe_in(rows: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """Add the column `_maybe`: true for all rows whose id is among ids (one column), and for few others.

    A bitmap of FILTER_BITS is made of hashes of the ids by an aggregation on
    the executors, 4 KB per 32,768 hash values, and broadcast: 4 MB at most,
    whatever there is. Where ids are very many it lets more rows pass; an exact
    join follows.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(FILTER_BITS))
    hashes = ids.select(place(ids.columns[0]).alias("_h"))
    bitmap = hashes.groupBy(F.bitmap_bucket_number("_h").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    keyed = rows.withColumn("_h", place(col)).withColumn("_part", F.bitmap_bucket_number("_h")).withColumn("_at", F.bitmap_bit_position("_h"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = keyed.join(F.broadcast(bitmap), "_part", "left").withColumn("_byte", F.coalesce(byte, F.lit(0)))
    return found.withColumn("_maybe", F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1") == 1).drop("_h", "_part", "_at", "_bits", "_byte")


def parts(batches, rows: int):
    """Arrow batches in parts of so many rows, so that Python holds the objects of few rows at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
