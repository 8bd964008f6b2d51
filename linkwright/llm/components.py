"""Connected components by alternating large and small stars.

Each round turns the edges towards the smallest neighbour, first from every
node to its larger neighbours, then from every node to its smaller ones, until
every component is a star around its smallest id. Edges never leave the
executors; minima are pre-aggregated before they are shuffled, and the
minimum per node is a written table, so that the join that follows it has two
plain exchanges, of which adaptive execution splits a hot one (a hub).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _toward(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    return edges.join(lowest, edges["u"] == lowest["n"])


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """id, component (its smallest id) for every id of an edge.

    Edges may repeat, point either way or be loops; null ends are dropped. No
    edges give no rows.
    """
    e = edges.select(F.greatest(left, right).cast("long").alias("u"), F.least(left, right).cast("long").alias("v"))
    e = materialize(e.where(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct(), "cc-edges")
    loops = e.where("u = v").select("u", "v")
    e, first = e.where("u > v"), True
    while True:
        if first and e.isEmpty():
            break
        # large star: a node's larger neighbours go to the smallest of it and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("n")).agg(F.least("n", F.min("v")).alias("m"))
        low = materialize(low, "cc-low")
        large = _toward(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc-large")
        # small star: a node and its smaller neighbours go to the smallest of them
        low2 = materialize(large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")), "cc-low")
        kept = _toward(large, low2).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(kept.union(low2.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(), "cc-edges")
        for old in (low, large, low2):
            release(old)
        e, first = new, False
        # done once every node has one parent and no parent is a node that has one
        count = F.count(F.lit(1))
        tops = e.select(F.col("v").alias("n")).distinct().join(e.select(F.col("u").alias("n")), "n", "left_semi")
        if e.groupBy("u").agg(count.alias("k")).where("k > 1").isEmpty() and tops.isEmpty():
            break
    ids = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return ids.union(roots).union(loops.toDF("id", "component")).groupBy("id").agg(F.min("component").alias("component"))
