"""Mixing sources to target weights by Pareto order sampling (operator 7, native).

A source gets a target number of words. Every document of it is taken
floor(target / size of the source) times for certain; the words that are then
left are a sample of fixed size, drawn with unequal probabilities: a document's
inclusion odds are the source's theta times the document's weight, by default
the square root of its size, so that long documents, which hold most words, are
seldom left out. Theta is chosen so that the inclusion probabilities p give the
words wanted: sum of p * size = words left. Documents rank by random odds over
inclusion odds, (u / (1 - u)) / (p / (1 - p)) with u from a hash of the row, and
are taken in that order until the words are used up, which is the case where
that quotient reaches about 1, so that p is a document's chance to be taken.

Theta needs no pass per step: weights are rounded to half powers of two, a
source's words are summed by weight, and the equation is solved on those sums.
Nor does a ranked source need to be sorted: ranks fall into BINS classes, sums
per class tell which are taken whole (first of 128 coarse classes, then of the
128 in the one where the words run out), and only the one class in which the
words run out is sorted, by itself. What a sample is made of is kept as the place in
the order where it ends; no table of documents is rewritten. A document that no
longer fits ends the sample; PASSES - 1 further rounds offer the words still
missing, fewer than that document's, to the next documents that fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, numbered

MAX_COPIES = 3
#: Classes of ranks, and bits of a class's number that are settled at a time: a source's sums are 2**DIGIT rows.
BINS, DIGIT = 1 << 14, 7
PASSES = 3
WEIGHTS = (1, 2, 3)
#: Weights are rounded down to 2**(k / 2), k from -CLASSES to CLASSES.
CLASSES = 128
#: Halvings of the interval in which log2(theta) lies.
STEPS = 64


def _ordered(sources: DataFrame) -> DataFrame:
    """source and its number from 0 by code point, null last, without one task for all sources."""
    ranges = sources.select("source").repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranges = materialize(ranges, "mix-order")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    begins = ranges.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("begin"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranges.withColumn("own", own).join(begins, "part").select("source", (F.col("begin") + F.col("own") - 1).alias("number"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target of each source.

    Weights repeat over the sources by code point, null last. All words are
    shared out by weight; a target stops at max_copies times its source's
    words and the excess is reshared by weight. So a target is the smaller of
    its cap and weight * level, and the level is raised until all words are
    given out: every step counts the sources that stop below it, until no more do.
    """
    sources = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    order = _ordered(sources).withColumnRenamed("source", "s")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod("number", F.lit(len(weights))).cast("int")).cast("double")
    sources = sources.join(order, F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", weight.alias("weight"))
    sources = materialize(sources.withColumn("cap", F.lit(float(max_copies)) * F.col("source_size")), "mix-weights")

    def given(level: float) -> tuple[int, float, float]:
        """How many sources stop below the level, their words, and the weight of the others."""
        stops = F.col("cap") < F.col("weight") * F.lit(level)
        zero = F.lit(0.0)
        found = sources.agg(F.count_if(stops), F.sum(F.when(stops, F.col("cap")).otherwise(zero)), F.sum(F.when(stops, zero).otherwise(F.col("weight")))).first()
        return found[0], found[1] or 0.0, found[2] or 0.0

    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        n, words, open_ = given(level)
        if n == stopped or not open_:
            break
        level, stopped = (total - words) / open_, n
    return sources.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _theta(classes: Column, words: Column) -> Column:
    """log2 of theta: sum over classes (k, size) of size * p = words, with odds of theta * 2**(k / 2)."""
    two = F.lit(2.0)

    def expected(t: Column) -> Column:
        return F.aggregate(classes, F.lit(0.0), lambda a, c: a + c["size"] / (1 + F.pow(two, -(t + c["k"] / 2))))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        return F.when(expected(mid) < words, F.struct(mid.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), mid.alias("high")))

    span = float(2 * CLASSES)
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(-span).alias("low"), F.lit(span).alias("high")), halve)["high"]


def _planned(state: DataFrame, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    """source, source_size, target, whole, words (left for the sample) and theta (its log2)."""
    by_class = materialize(state.groupBy("source", "k").agg(F.sum("size").alias("size")), "mix-classes")
    targets = source_targets(by_class, weights, max_copies)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.least(F.floor(rate), F.lit(max_copies)).cast("long")).withColumn("words", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    listed = by_class.groupBy("source").agg(F.collect_list(F.struct("k", F.col("size").cast("double").alias("size"))).alias("classes")).withColumnRenamed("source", "s")
    both = targets.join(listed, F.col("source").eqNullSafe(F.col("s")))
    return materialize(both.select("source", "source_size", "target", "whole", "words", _theta(F.col("classes"), F.col("words")).alias("theta")), "mix-sources")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 7, weight: Column | None = None) -> DataFrame:
    """How many words the mix takes of every document.

    Returns doc_id, size, source_size, target, copies and taken = copies * size.
    weight: a positive number per document that its inclusion odds are in
    proportion to (null or not positive: the least weight); without it the
    square root of the size. A null text has size 0; a null source is a source,
    last by order. Rows of size 0 take nothing. Repeated rows count each for
    itself and are drawn apart. Reruns agree, as ranks come from a hash of the
    row, its number among equal rows and the seed. Other columns are ignored,
    an empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), "source", size.alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("crc"), (F.lit(None) if weight is None else weight).cast("double").alias("weight"))
    heavy = F.sqrt(F.greatest("size", F.lit(1))) if weight is None else F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(2.0 ** (-CLASSES / 2)))
    k = F.greatest(F.least(F.floor(2 * F.log2(heavy)), F.lit(CLASSES)), F.lit(-CLASSES)).cast("int")
    state = numbered(rows, "mix-rows").withColumn("k", k)
    sources = _planned(state, weights, max_copies)

    u = (F.pmod(F.xxhash64("doc_id", "source", "crc", "_nth", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    quotient = F.log(u / (1 - u)) - (F.col("theta") + F.col("k") / 2) * math.log(2)  # of the odds, its logarithm
    drawn = _with_source(state, sources).withColumn("rank", 1 / (1 + F.exp(-quotient)))
    drawn = drawn.withColumn("bin", F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)).cast("int"))
    place = F.struct("rank", F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.coalesce("crc", F.lit(0)).alias("crc"), F.col("_nth").alias("nth"))
    drawn = materialize(drawn.select("doc_id", "source", "size", "source_size", "target", "whole", (F.col("words") >= F.col("size")).alias("fits"), "bin", place.alias("place")), "mix-state")

    ends = _ends(drawn, sources.select("source", F.col("words").alias("room")))
    chosen = F.lit(False)
    out = _with_source(drawn, ends)
    for i in range(PASSES):
        chosen = chosen | _taken(F.get("ends", F.lit(i)))
    copies = F.col("whole") + (chosen & (F.col("size") > 0)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the columns of their source. Spark broadcasts the sources if they are few enough, else it splits hot ones."""
    return rows.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _taken(end: Column) -> Column:
    """Whether a round that stopped at `end` takes a row: it was offered, and comes before the end."""
    before = (F.col("bin") < end["bin"]) | ((F.col("bin") == end["bin"]) & F.coalesce(F.col("place") <= end["place"], F.lit(False)))
    return F.coalesce((F.col("size") <= end["room"]) & before, F.lit(False))


def _last(offered: DataFrame, by: str) -> DataFrame:
    """source, the last class of `by` that begins within the room, and the words before it. offered: also size, room, begin (words before all)."""
    sums = offered.groupBy("source", by).agg(F.sum("size").alias("words"), F.max("room").alias("room"), F.max("begin").alias("begin"))
    before = F.col("begin") + F.sum("words").over(Window.partitionBy("source").orderBy(by)) - F.col("words")
    found = sums.withColumn("before", before).where("before < room").groupBy("source").agg(F.max(F.struct(by, "before")).alias("last"))
    return materialize(found.select("source", "last.*"), "mix-last")


def _ends(drawn: DataFrame, rooms: DataFrame) -> DataFrame:
    """source, ends: for each of PASSES rounds room (the words it could take), bin and place of its end."""
    kind = F.lit(None).cast("struct<room:double,bin:int,place:struct<rank:double,null:boolean,id:bigint,crc:bigint,nth:bigint>>")
    rooms = rooms.withColumn("ends", F.array().cast("array<struct<room:double,bin:int,place:struct<rank:double,null:boolean,id:bigint,crc:bigint,nth:bigint>>>"))
    for i in range(PASSES):
        offered = _with_source(drawn.where("size > 0 and fits"), rooms.where("room > 0")).where(F.col("size") <= F.col("room"))
        for j in range(i):
            offered = offered.where(~_taken(F.get("ends", F.lit(j))))
        offered = offered.select("source", "bin", "place", "size", "room")
        coarse = _last(offered.withColumn("class", F.shiftright("bin", DIGIT)).withColumn("begin", F.lit(0)), "class")
        inside = _with_source(offered, coarse).where(F.shiftright("bin", DIGIT) == F.col("class"))
        fine = _last(inside.withColumnRenamed("before", "begin"), "bin")
        inside = _with_source(offered.withColumnRenamed("bin", "_bin"), fine).where(F.col("_bin") == F.col("bin"))
        running = F.sum("size").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
        inside = inside.withColumn("upto", F.col("before") + running).where("upto <= room")
        sorted_ = inside.groupBy("source").agg(F.max("place").alias("place"), F.max("upto").alias("upto")).withColumnRenamed("source", "_u")
        found = fine.join(sorted_, F.col("source").eqNullSafe(F.col("_u")), "left").select(F.col("source").alias("_t"), "bin", "before", "place", "upto")
        joined = rooms.join(found, F.col("source").eqNullSafe(F.col("_t")), "left")
        used = F.coalesce("upto", "before", F.lit(0)).cast("double")
        end = F.when(F.col("bin").isNotNull(), F.struct("room", "bin", "place")).otherwise(kind)
        rooms = materialize(joined.select("source", (F.col("room") - used).alias("room"), F.concat("ends", F.array(end)).alias("ends")), "mix-ends")
    return rooms.select("source", "ends")
