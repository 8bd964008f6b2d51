"""Sharding on a consistent-hash ring with bounded loads (operator 10).

Every shard owns VNODES points of a ring of 2**32 places. A key belongs to the
next point clockwise. Under the law `rows` a shard takes at most its share of
the rows (counts differ by one at most): what an arc holds beyond the room of
its shard continues clockwise to the next points whose shards have room. Under
the law `key` there are no bounds: doc_id and the shard count alone decide,
and one more shard takes rows only into itself.

Balance needs only one number per arc (n_shards * vnodes of them, a bound
known beforehand): `flow` deals the arcs' rows out to shards as runs of ranks,
and each row finds its run by its rank within its arc. Under `rows` an arc is
a range of the hash of the whole row and its number among equal rows, so no
repeated row, text or doc_id can make one hot. Under `key` a frequent doc_id
does fill one arc, as the law asks; so rows are ranked in SLICES parts of an
arc, whose sizes are summed up, and no task holds an arc. Only a few numbers
per row are shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered

N_SHARDS = 16
#: Ring points of a shard.
VNODES = 128
#: Parts of an arc that are ranked apart.
SLICES = 16
RING = 1 << 32


def ring(n_shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard) clockwise. A shard's points do not depend on how many shards there are."""
    points: dict[int, int] = {}
    for shard in range(n_shards):
        for k in range(vnodes):
            place = int.from_bytes(hashlib.md5(f"{shard}/{k}".encode()).digest()[:4], "big")
            points[place] = min(shard, points.get(place, shard))
    return sorted(points.items())


def shares(total: int, n_shards: int) -> list[int]:
    """Room of each shard: as even as can be."""
    return [total // n_shards + (i < total % n_shards) for i in range(n_shards)]


def flow(counts: list[int], owners: list[int], room: list[int]) -> list[list[tuple[int, int, int, int]]]:
    """Deal the arcs' rows to shards: per arc, runs (from rank, to rank, shard, first slot).

    First every arc fills its own shard, arcs in clockwise order; then what is
    left over walks on clockwise to the shards that still have room.
    """
    used = [0] * len(room)
    runs: list[list[tuple[int, int, int, int]]] = [[] for _ in counts]
    left = list(counts)

    def give(arc: int, shard: int) -> None:
        n = min(left[arc], room[shard] - used[shard])
        if n > 0:
            at = counts[arc] - left[arc]
            runs[arc].append((at, at + n, shard, used[shard]))
            used[shard] += n
            left[arc] -= n

    for arc, shard in enumerate(owners):
        give(arc, shard)
    for arc in range(len(counts)):
        step = 1
        while left[arc] and step < len(owners):
            give(arc, owners[(arc + step) % len(owners)])
            step += 1
    return runs


def _owners(points: list[tuple[int, int]], below: int) -> list[int]:
    """The owner of each arc if only the shards under `below` stand on the ring."""
    n = len(points)
    if not any(shard < below for _, shard in points):
        return [0] * n
    out, shard = [0] * n, 0
    for i in range(2 * n - 1, -1, -1):  # twice round, so that the first arcs see the last points
        if points[i % n][1] < below:
            shard = points[i % n][1]
        out[i % n] = shard
    return out


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, law: str = "rows", vnodes: int = VNODES) -> DataFrame:
    """Assign every document to a shard and a gapless slot in it.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law,
    shard, slot and grown_shard. Under `rows` loads are bounded and the place
    of a row comes from doc_id, the text's checksum and the row's number among
    equal ones; under `key` from doc_id alone, and grown_shard is the shard with one more. A null text counts as
    empty, a null doc_id is a key like any other. Repeated rows are rows of
    their own, interchangeable among themselves. Other columns are ignored;
    an empty table gives no rows.
    """
    if law not in ("rows", "key"):
        raise ValueError(f"no law {law!r}: rows or key")
    spark = docs.sparkSession
    points = ring(n_shards + 1, vnodes)
    if law == "rows":
        points = [p for p in points if p[1] < n_shards]
    places = np.array([p for p, _ in points], np.int64)
    owners, grown = _owners(points, n_shards), _owners(points, n_shards + 1)

    @F.pandas_udf("int")
    def arc(place: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(places, place.to_numpy()) % len(places)).astype(np.int32))

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = numbered(rows, "shard-rows")
    key = F.xxhash64("doc_id") if law == "key" else F.xxhash64("doc_id", "text_crc32", "_nth")
    part = F.pmod(F.xxhash64(F.lit("slice"), "doc_id", "text_crc32", "_nth"), F.lit(SLICES)).cast("int")
    rows = materialize(rows.withColumn("place", F.pmod(key, F.lit(RING))).withColumn("arc", arc("place")).withColumn("slice", part), "shard-keys")

    parts = materialize(rows.groupBy("arc", "slice").count(), "shard-parts")  # len(points) * SLICES rows at most
    counts = [0] * len(points)
    for r in parts.groupBy("arc").agg(F.sum("count").alias("n")).collect():
        counts[r["arc"]] = r["n"]
    total = sum(counts)
    runs = flow(counts, owners, shares(total, n_shards) if law == "rows" else [total] * n_shards)
    plan = [(arc_, lo, hi, shard, slot, grown[arc_] if law == "key" else None) for arc_, own in enumerate(runs) for lo, hi, shard, slot in own]
    plan = spark.createDataFrame(plan, "arc int, lo long, hi long, shard int, first long, grown_shard int")
    before = F.sum("count").over(Window.partitionBy("arc").orderBy("slice")) - F.col("count")
    parts = parts.select("arc", "slice", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("arc", "slice").orderBy("place", "doc_id", "text_crc32", "size", "_nth"))
    ranked = rows.withColumn("own", own).join(F.broadcast(parts), ["arc", "slice"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    joined = ranked.join(F.broadcast(plan), ["arc"]).where("rank >= lo and rank < hi")
    return joined.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"), "grown_shard")
