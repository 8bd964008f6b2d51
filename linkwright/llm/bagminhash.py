"""Near-duplicate documents by BagMinHash (operator 9).

A document is the multiset of its five-word shingles. Each shingle has a
Poisson process over its weight axis: [0, 1) and the dyadic ranges [1, 2),
[2, 4), ... carry points at a rate equal to the range's length, and a point's
place within its range, drawn level by level as a uniform integer, tells for
which weights it counts. A document sees, of every shingle, the points below
the shingle's weight; each falls into one of M registers, and a register keeps
the earliest. Two documents share a register's point with a probability equal
to their weighted Jaccard similarity, whatever the weights. Points come in
time order, so a shingle's process stops as soon as it is later than all
registers: a document of n shingles costs about n + M log M points.

Registers are banded. Members of a bucket are compared with its smallest
member; that settles most buckets. In buckets that still hold several
components all members are compared, in blocks: a pair of blocks is one sparse
matrix product, from which only stars of connected documents come out, never
pairs. Links are exact: the multisets' overlap, from the whole texts, of
SIMILARITY at least. Equal word sequences are one class and are compared once.

The texts are read twice, and only those of bucket-mates are shuffled: a bitmap
of fixed size, filled by hash of their ids, goes to all readers before.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_pairs, dealt, spread_labels
from .common import materialize, maybe_in, parts, release, salted_join, slices
from .components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 21, 6
M = BANDS * ROWS
#: Words that are sketched at a time.
CHUNK_WORDS = 500_000
#: Documents whose words are held at a time.
CHUNK_DOCS = 512
#: Documents, and about so many bytes of text, of a block in which all are compared.
BLOCK, BLOCK_BYTES = 512, 16_000_000

_MASK = (1 << 64) - 1
_COEF = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ** 3 | 1) & _MASK for i in range(max(SHINGLE, ROWS))], np.uint64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word; forgets all when it has grown large."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of all n-word windows; of all words together if there are fewer."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * _COEF[k]
    return mix(out)


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from the top 52 bits."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def registers(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """The earliest point of every register: (n_docs, m), infinite where a document has no items.

    doc, item, weight: one row per distinct item of a document, weight an integer of at least 1.
    """
    found = np.full(n_docs * m, np.inf)
    # one process per item and range [low, 2 low) or [0, 1) that begins below its weight
    parts, low = [(doc, item, weight, np.zeros(len(doc), np.int64))], 1
    d, x, w = doc, item, weight
    while (more := w > low).any():
        d, x, w = d[more], x[more], w[more]
        parts.append((d, x, w, np.full(len(d), low, np.int64)))
        low *= 2
    d, x, w, low = (np.concatenate([p[i] for p in parts]) for i in range(4))
    seed = mix(x + mix(low.astype(np.uint64) + _GOLD))
    length = np.maximum(low, 1)
    t = np.zeros(len(d))
    step = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(d):
            step += np.uint64(1)
            one = mix(seed + step * _GOLD)
            t = t - np.log(_unit(one)) / length
            two = mix(one ^ np.uint64(0xD6E8FEB86659FD93))
            place = low + ((two & np.uint64(0xFFFFFFFF)) % length.astype(np.uint64)).astype(np.int64)
            register = ((two >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            seen = place < w
            np.minimum.at(found, (d * m + register)[seen], t[seen])
            grid = found.reshape(n_docs, m)
            on = t < (grid.max(axis=1)[d] if 2 * len(d) > n_docs else grid[d].max(axis=1))
            d, w, low, length, seed, t = d[on], w[on], low[on], length[on], seed[on], t[on]
    return found.reshape(n_docs, m)


def band_keys(found: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band: (documents, bands)."""
    bits = found.view(np.uint64).reshape(len(found), bands, rows)
    with np.errstate(over="ignore"):
        keys = (bits * _COEF[:rows]).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _GOLD
        return mix(keys).view(np.int64)


def sketch(texts: list[bytes | None], cache: WordHashes) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """Per text: 128 bits that stand for its words (None without words), number of shingles, band keys."""
    import xxhash

    split = [(t or b"").split() for t in texts]  # bytes.split() parts at ASCII white space
    names: list[bytes | None] = []
    counts = np.zeros(len(texts), np.int64)
    keys = np.zeros((len(texts), BANDS), np.int64)
    with np.errstate(over="ignore"):
        for a, b in slices([len(w) + 64 for w in split], CHUNK_WORDS):
            doc, item, weight = [], [], []
            for i in range(a, b):
                names.append(xxhash.xxh3_128_digest(b" ".join(split[i])) if split[i] else None)
                shingles = np.sort(shingle_hashes(word_hashes(split[i], cache)))
                counts[i] = len(shingles)
                if len(shingles):
                    starts = np.flatnonzero(np.concatenate(([True], shingles[1:] != shingles[:-1])))
                    item.append(shingles[starts])
                    weight.append(np.diff(starts, append=len(shingles)))
                    doc.append(np.full(len(starts), i - a, np.int64))
            if doc:
                keys[a:b] = band_keys(registers(np.concatenate(doc), np.concatenate(item), np.concatenate(weight).astype(np.int64), b - a))
    return names, counts, keys


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, words_key, n_shingles and bands of every document."""

    def run(batches):
        cache = WordHashes()
        for batch in parts(batches, CHUNK_DOCS):
            names, counts, keys = sketch(batch.column(1).to_pylist(), cache)
            offsets = np.arange(0, keys.size + 1, BANDS, dtype=np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(counts), bands], ["doc_id", "words_key", "n_shingles", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, words_key binary, n_shingles long, bands array<long>")


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of hashes."""
    if not len(a) or not len(b):
        return 0.0
    x, n = np.unique(a, return_counts=True)
    y, k = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(n[i], k[j]).sum()
    return float(both) / (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs a < b with a similarity of at least `similarity`: a, b, similarity."""

    def run(batches):
        cache, known, last = WordHashes(), None, None
        with np.errstate(over="ignore"):
            for batch in batches:
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out = []
                for i in range(len(a)):
                    if a[i] != known:
                        known, last = a[i], shingle_hashes(word_hashes(batch.column(2)[i].as_py().split(), cache))
                    out.append(overlap(last, shingle_hashes(word_hashes(batch.column(3)[i].as_py().split(), cache))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    one = texts.select(F.col("id").alias("a"), F.col("words").alias("of_a"))
    two = texts.select(F.col("id").alias("b"), F.col("words").alias("of_b"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "of_a", "of_b")
    return both.mapInArrow(run, "a long, b long, similarity double").where(F.col("similarity") >= similarity)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its near-duplicate group), kept, n_shingles.

    docs needs doc_id and text. A document without words (null, empty, white
    space) links with nothing. Fewer than five words are one shingle. Rows with
    the same doc_id are one document, near to whatever one of its texts is near
    to, if they differ; rows with a null doc_id link with nothing and are kept,
    class_id null. Repeated rows all come back. Other columns are ignored; an
    empty table gives no rows.
    """
    sig = materialize(sketches(docs), "bag-sketches")
    named = sig.where("words_key is not null and doc_id is not null")
    classes = materialize(named.groupBy("words_key").agg(F.min("doc_id").alias("rep")), "bag-classes")

    reps = named.join(classes.withColumnRenamed("words_key", "k"), (F.col("doc_id") == F.col("rep")) & (F.col("words_key") == F.col("k")), "left_semi")
    cells = materialize(reps.select("doc_id", F.explode("bands").alias("key")).distinct(), "bag-cells")
    shared = materialize(cells.groupBy("key").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1"), "bag-shared")
    members = materialize(cells.join(shared, "key").select("key", F.col("doc_id").alias("id"), "low"), "bag-members")
    release(cells)
    release(shared)

    ids = members.select("id").distinct()
    near = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("words"))
    near = maybe_in(near, "id", ids).where("_maybe").select("id", "words")
    # an id's texts, each once: rows that repeat an id have as a rule the same one
    texts = materialize(near.join(ids, "id", "left_semi").groupBy("id", F.xxhash64("words").alias("hash"), F.length("words").alias("bytes")).agg(F.any_value("words").alias("words")).drop("hash", "bytes"), "bag-texts")
    pairs = members.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    links = verified(pairs, texts, similarity).select("a", "b")
    # the classes of an id that has texts of several
    several = named.groupBy("doc_id").agg(F.min("words_key").alias("x"), F.max("words_key").alias("y")).where("x <> y").select("doc_id")
    held = named.join(materialize(several, "bag-several"), "doc_id", "left_semi").select("doc_id", "words_key").distinct()
    links = materialize(links.union(held.join(classes, "words_key").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))).distinct(), "bag-links")

    groups = materialize(connected_components(links), "bag-groups")
    rest = _unsettled(members, groups)
    sizes = rest.join(texts.select("id", F.length("words").alias("bytes")), "id").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    sizes = materialize(sizes, "bag-sizes")
    if not sizes.isEmpty():
        meets = block_pairs(rest.select("key", "id"), sizes, F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)))
        full = dealt(meets.join(_shingled(texts.join(rest.select("id").distinct(), "id")), "id").select("key", "lo", "hi", "block", "id", "shingles"))
        stars = full.mapInArrow(_verifier(similarity), "a long, b long").distinct()
        links = materialize(links.union(stars), "bag-links")
        groups = materialize(connected_components(links), "bag-groups")
    for old in (members, texts, rest, links):
        release(old)

    group = classes.join(groups, classes["rep"] == groups["id"], "left").select("words_key", F.coalesce("component", "rep").alias("class_id"))
    out = salted_join(sig, group, "words_key", "doc_id")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"), "n_shingles")


def _unsettled(members: DataFrame, groups: DataFrame) -> DataFrame:
    """key, id, component of the buckets whose members are in several components."""
    now = members.join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    now = materialize(now, "bag-now")
    mixed = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    return materialize(now.join(materialize(mixed, "bag-mixed"), "key", "left_semi"), "bag-rest")


def _shingled(texts: DataFrame) -> DataFrame:
    """id, shingles: the hashes of a text's shingles, sorted."""

    def run(batches):
        cache = WordHashes()
        with np.errstate(over="ignore"):
            for batch in parts(batches, CHUNK_DOCS):
                found = [np.sort(shingle_hashes(word_hashes(t.split(), cache))) for t in batch.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "shingles"])

    return texts.select("id", "words").mapInArrow(run, "id long, shingles array<long>")


def overlaps(items: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the multiset intersections of sorted items, for each of left (rows) and right (columns).

    Occurrences of an item are numbered, so that multisets become sets; items
    that one document alone has are dropped, and the rest is a matrix product
    over some columns at a time.
    """
    used = np.union1d(left, right)
    doc = np.repeat(used, [len(items[i]) for i in used])
    flat = np.concatenate([items[i] for i in used])
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    nth = np.arange(len(flat)) - np.maximum.accumulate(np.where(new, np.arange(len(flat)), 0))
    with np.errstate(over="ignore"):
        flat = np.where(nth > 0, mix(flat.view(np.uint64) + nth.astype(np.uint64) * _GOLD).view(np.int64), flat)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    renumber = np.cumsum(count > 1) - 1
    doc, column = doc[keep], renumber[column[keep]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    at_left, at_right = np.full(len(items), -1), np.full(len(items), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        d, c = doc[a:b], column[a:b] - low
        x[at_left[d[at_left[d] >= 0]], c[at_left[d] >= 0]] = 1
        y[at_right[d[at_right[d] >= 0]], c[at_right[d] >= 0]] = 1
        out += x @ y.T
    return out


def _verifier(similarity: float):
    """Stars that connect what is similar within a pair of blocks: a (smallest reachable), b."""

    def rows(batches):
        for b in batches:
            heads = list(zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
            for i, (key, lo, hi, block, doc) in enumerate(heads):
                yield (key, lo, hi), block, doc, b.column(5)[i].values.to_numpy()

    def run(batches):
        for (_, lo, hi), group in groupby(rows(batches), key=lambda r: r[0]):
            _, block, ids, items = zip(*group, strict=True)
            ids, block, sizes = np.array(ids, np.int64), np.array(block), np.array([len(i) for i in items])
            left = np.flatnonzero(block == lo)
            right = left if lo == hi else np.flatnonzero(block == hi)
            if not len(left) or not len(right):
                continue
            both = overlaps(list(items), left, right)
            of = both / (sizes[left][:, None] + sizes[right][None, :] - both)
            found = np.argwhere(of >= similarity)
            root = spread_labels(len(ids), left[found[:, 0]], right[found[:, 1]])
            b = np.flatnonzero(root != np.arange(len(ids)))
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(ids[root[b]]), pa.array(ids[b])], ["a", "b"])

    return run
