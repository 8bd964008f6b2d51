"""All pairs of a group's members, in blocks: every pair of blocks is a task's unit of work."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(cells: DataFrame, sizes: DataFrame, blocks) -> DataFrame:
    """key, lo, hi, block, id: each member once per pair of blocks that its block is in.

    cells: key, id. sizes: one row per key, with the columns that the
    expression `blocks` (the number of blocks of a key) needs. A member's block
    is a hash of its id, so that blocks are even and a rerun finds the same.
    """
    meets = cells.join(sizes, "key").withColumn("blocks", blocks.cast("int"))
    meets = meets.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meets = meets.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return meets.select("key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "id")


def dealt(full: DataFrame) -> DataFrame:
    """Rows of a pair of blocks together, in order."""
    return full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")


def spread_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of n nodes over the links i-j."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for at in (i, j, root[i], root[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root
