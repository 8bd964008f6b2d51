"""Near-duplicate vectors by a pivot-permutation index (operator 2).

A vector is described by the reference points (pivots) nearest to it, in
order; near vectors see nearly the same ones. The index holds an inverted list
for every set of SHARED pivots that a vector has among its NEAREST: two vectors
meet in a list exactly if they share that many pivots or more, and the count of
shared pivots tells in which one of their common lists a pair is handled (that
of their smallest shared pivots), so every pair is verified once.

Lists are verified in blocks: a list of up to BLOCK vectors is one matrix
product, a longer one is split into blocks, and every pair of blocks is a task
of its own. No pairs leave a task: it returns how many vectors each of its
vectors is linked with, and a star per connected part. Equal vectors are one
class from the start and stand in the lists once.

The number of pivots grows with the square root of the number of vectors, so
that lists stay short; they are taken from a bounded sample.
"""

from __future__ import annotations

from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_pairs, dealt, spread_labels
from .common import materialize, release, salted_join
from .components import connected_components

THRESHOLD = 0.95
#: Pivots that describe a vector, and pivots that two vectors must share.
NEAREST, SHARED = 8, 2
#: Most pivots, and most vectors that are looked at to find them.
MAX_PIVOTS, SAMPLE = 4096, 16_384
#: Pivots are less alike than the first of these, so that no dense cluster holds many of them; where that leaves
#: too few, because all vectors point much the same way, the next bar fills them up.
PIVOT_COSINES = (0.7, 0.8, 0.9, 0.95, 0.98, 2.0)
BLOCK = 1024


def n_pivots(n_vectors: int) -> int:
    return int(min(MAX_PIVOTS, max(64, 10 * n_vectors**0.5)))


def choose_pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Up to `wanted` rows of unit vectors, each less alike to those before it than the lowest bar that gives so many."""
    chosen: list[int] = []
    nearest = np.full(len(sample), -2.0)  # cosine of each vector with the pivot most alike to it
    for bar in PIVOT_COSINES:
        for i in range(len(sample)):
            if len(chosen) == wanted:
                break
            if nearest[i] < bar:
                chosen.append(i)
                nearest = np.maximum(nearest, sample @ sample[i])
                nearest[i] = 2.0
    return sample[sorted(chosen)]


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Double vectors (zeros where unusable) and which rows are usable: `dim` finite components, not all zero."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), dim))
    good = np.zeros(len(rows), bool)
    for i, r in enumerate(rows):
        if r is not None and len(r) == dim and None not in r:
            out[i], good[i] = r, True
    with np.errstate(over="ignore", invalid="ignore"):
        good &= np.isfinite(out).all(axis=1) & (out != 0).any(axis=1)
    out[~good] = 0
    return out + 0.0, good


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first so that squares stay in range; zero rows stay zero."""
    top = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(top > 0, top, 1)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def _classed(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, a 128-bit name of the vector (null for one that links with nothing) and the vector."""

    def run(batches):
        import xxhash

        for batch in batches:
            x, good = _matrix(batch.column(1), dim)
            names = [xxhash.xxh3_128_digest(r.tobytes()) if g else None for r, g in zip(x, good, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), batch.column(1)], ["vec_id", "name", "embedding"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, name binary, embedding array<double>")


def _described(reps: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """id, near: the numbers of the nearest pivots, nearest first."""
    k = min(nearest, len(pivots))

    def run(batches):
        for batch in batches:
            out = np.empty((batch.num_rows, k), np.int32)
            for a in range(0, batch.num_rows, 2048):
                x, _ = _matrix(batch.column(1).slice(a, 2048), pivots.shape[1])
                like = unit(x) @ pivots.T
                top = np.argpartition(-like, k - 1, axis=1)[:, :k] if k < len(pivots) else np.tile(np.arange(k), (len(x), 1))
                order = np.argsort(-np.take_along_axis(like, top, axis=1), axis=1, kind="stable")
                out[a : a + 2048] = np.take_along_axis(top, order, axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, k, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "near"])

    return reps.select("id", "embedding").mapInArrow(run, "id long, near array<int>")


def _listed(near: DataFrame, shared: int) -> DataFrame:
    """One row per vector and set of `shared` of its pivots: key, id."""

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            x = batch.column(1).flatten().to_numpy().reshape(len(sizes), -1) if len(sizes) else np.empty((0, shared), np.int32)
            x = np.sort(x, axis=1).astype(np.int64)
            t = min(shared, x.shape[1])
            keys = []
            for c in combinations(range(x.shape[1]), t):
                key = np.zeros(len(x), np.int64)
                for i in c:
                    key = key * (MAX_PIVOTS + 1) + x[:, i]
                keys.append(key)
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(ids, len(keys)))], ["key", "id"])

    return near.mapInArrow(run, "key long, id long")


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    return np.argwhere(x @ y.T >= threshold)


def _handled_here(key: int, a: np.ndarray, b: np.ndarray, shared: int) -> np.ndarray:
    """Whether `key` is the list of the smallest pivots shared, for rows of sorted pivots a and b."""
    last = key % (MAX_PIVOTS + 1)
    common = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return (common & (a <= last)).sum(axis=1) == min(shared, a.shape[1])


def _block(key: int, ids: np.ndarray, near: np.ndarray, x: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float, shared: int):
    """Links inside `left` (right None) or between left and right (row numbers): ids, links by weight, and stars."""
    links = np.zeros(len(ids), np.int64)
    other = left if right is None else right
    found = _linked(x[left], x[other], threshold)
    i, j = left[found[:, 0]], other[found[:, 1]]
    if right is None:
        i, j = i[i < j], j[i < j]
    for a in range(0, len(i), 200_000):
        p, q = i[a : a + 200_000], j[a : a + 200_000]
        own = _handled_here(key, near[p], near[q], shared)
        np.add.at(links, p[own], weight[q[own]])
        np.add.at(links, q[own], weight[p[own]])
    return links, spread_labels(len(ids), i, j)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    vectors needs vec_id and embedding (an array of numbers). Vectors that are
    null, zero, of another length than the first usable one by vec_id, or that
    hold null or non-finite components link with nothing. Equal vectors link
    with each other. Rows that repeat a vec_id are one vector; if they differ,
    it is that with the smallest 128-bit hash, and all its rows with vectors
    that can link get that one's result. A null vec_id stays null, and its row links with nothing. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    sized = vectors.where("embedding is not null and size(embedding) > 0").agg(F.min(F.struct("vec_id", F.size("embedding").alias("dim")))).first()[0]
    dim = sized["dim"] if sized else 1
    every = _classed(vectors, dim)  # read twice: names are written, vectors are not
    rows = materialize(every.select("vec_id", "name"), "vec-rows")
    named = rows.where("vec_id is not null and name is not null").groupBy("vec_id").agg(F.min("name").alias("name"), F.max("name").alias("last"))
    named = materialize(named, "vec-named")
    classes = materialize(named.groupBy("name").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "vec-classes")

    vec = every.join(classes.select(F.col("name").alias("own"), "rep", "weight"), (F.col("vec_id") == F.col("rep")) & (F.col("name") == F.col("own")))
    reps = vec.groupBy(F.col("rep").alias("id"), "weight").agg(F.any_value("embedding").alias("embedding")).select("id", "embedding", "weight")
    reps = materialize(reps, "vec-reps")
    n = reps.count()
    edges = spark.createDataFrame([], "a long, b long")
    links = spark.createDataFrame([], "id long, links long")
    if n > 1:
        wanted = n_pivots(n)
        sample = reps.orderBy(F.xxhash64("id"), "id").select("embedding").limit(min(SAMPLE, 4 * wanted)).collect()
        pivots = choose_pivots(unit(np.array([r[0] for r in sample], np.float64)), wanted)
        near = materialize(_described(reps, pivots, NEAREST), "vec-near")
        cells = materialize(_listed(near, SHARED), "vec-cells")
        sizes = materialize(cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "vec-sizes")
        meets = block_pairs(cells, sizes, F.ceil(F.col("n") / BLOCK))
        full = meets.join(reps.join(near, "id"), "id").select("key", "lo", "hi", "block", "id", "near", "embedding", "weight")
        out = materialize(dealt(full).mapInArrow(_verifier(threshold, SHARED), "id long, links long, root long"), "vec-out")
        release(cells)
        links = out.groupBy("id").agg(F.sum("links").alias("links"))
        edges = out.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()
    groups = connected_components(edges)

    found = classes.join(groups.withColumnRenamed("id", "rep"), "rep", "left").join(links.withColumnRenamed("id", "rep"), "rep", "left")
    found = found.select("name", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    several = named.where("name <> last").select(F.col("vec_id").alias("id"), F.col("name").alias("first"))
    if not several.isEmpty():
        rows = rows.join(several, F.col("vec_id") == F.col("id"), "left").select("vec_id", F.coalesce("first", "name").alias("name"))
    result = salted_join(rows, found, "name", "vec_id")
    linked = F.col("vec_id").isNotNull()
    component = F.when(linked, F.coalesce("component_id", "vec_id"))
    return result.select(
        "vec_id",
        F.when(linked, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def _verifier(threshold: float, shared: int):
    def rows(batches):
        for b in batches:
            key, lo, hi, block, ids = (b.column(i).to_pylist() for i in range(5))
            near = b.column(5).flatten().to_numpy().reshape(b.num_rows, -1)
            x = b.column(6).flatten().to_numpy().reshape(b.num_rows, -1)
            weight = b.column(7).to_numpy()
            for i in range(b.num_rows):
                yield (key[i], lo[i], hi[i]), block[i], ids[i], near[i], x[i], weight[i]

    def run(batches):
        out: list[tuple[np.ndarray, ...]] = []
        total = 0
        for (key, lo, hi), group in groupby(rows(batches), key=lambda r: r[0]):
            _, block, ids, near, x, weight = zip(*group, strict=True)
            if len(ids) < 2:
                continue
            ids, block = np.array(ids, np.int64), np.array(block)
            near, x, weight = np.sort(np.array(near), axis=1), unit(np.array(x)), np.array(weight, np.int64)
            left, right = (np.arange(len(ids)), None) if lo == hi else (np.flatnonzero(block == lo), np.flatnonzero(block == hi))
            links, root = _block(key, ids, near, x, weight, left, right, threshold, shared)
            told = (links > 0) | (root != np.arange(len(ids)))
            if told.any():
                out.append((ids[told], links[told], ids[root[told]]))
                total += int(told.sum())
            if total > 50_000:
                yield _batch(out)
                out, total = [], 0
        if out:
            yield _batch(out)

    return run


def _batch(out):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["id", "links", "root"])
