"""Near-duplicate operators and components against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.llm import bagminhash, chunking, components, near_vectors
from linkwright.llm.common import table


def roots(n, edges):
    parent = {i: i for i in n}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in n}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 600 + i) for i in range(50)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    found = {r["id"]: r["component"] for r in components.connected_components(df).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert found == want
    assert components.connected_components(df.limit(0)).collect() == []


# ---- vectors


def brute_vectors(ids, x, threshold=0.95):
    with np.errstate(all="ignore"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ok = np.isfinite(u).all(axis=1)
    like = np.where(ok[:, None] & ok[None, :], np.nan_to_num(u @ u.T), -1) >= threshold
    np.fill_diagonal(like, False)
    return like.sum(axis=1), roots(ids, [(ids[i], ids[j]) for i, j in np.argwhere(like) if i < j])


def clustered(rng, n, clusters, dim=32):
    base = rng.normal(size=(clusters, dim))
    x = base[rng.integers(0, clusters, n)] + 0.2 * rng.normal(size=(n, dim))
    x[::5] = rng.normal(size=(len(x[::5]), dim))
    x[7::50] = x[3]  # exact copies
    return x.astype(np.float32).astype(float)


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)  # 16: long lists are cut into pairs of blocks
    rng = np.random.default_rng(2)
    x = clustered(rng, 600, 30)
    ids = [int(i) for i in rng.permutation(600) * 3]
    links, root = brute_vectors(ids, x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    found = {r["vec_id"]: r for r in near_vectors.near_vectors(df).collect()}
    got = np.array([found[i]["n_links"] for i in ids])
    assert (got <= links).all() and got.sum() >= 0.98 * links.sum() > 0
    assert np.mean([found[i]["component_id"] == root[i] for i in ids]) > 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_vectors_with_nothing_to_compare(spark):
    nan, inf = float("nan"), float("inf")
    given = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, []), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (11, [1e-30, 0.0])]
    df = spark.createDataFrame(given, "vec_id long, embedding array<float>").withColumn("name", F.lit("x")).withColumn("id", F.lit(1)).withColumn("key", F.lit(1))
    rows = near_vectors.near_vectors(df).collect()
    assert len(rows) == len(given)
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows}
    alone = {i: (0, i, True) for i in (2, 3, 4, 5, 6, 9, 10)}
    assert found == alone | {1: (3, 1, True), 7: (3, 1, False), 8: (3, 1, False), 11: (3, 1, False), None: (0, None, True)}
    assert near_vectors.near_vectors(df.limit(0)).collect() == []
    assert len(near_vectors.near_vectors(df.where("vec_id = 2")).collect()) == 1


# ---- BagMinHash


def test_registers_are_unbiased_for_weights():
    rng = np.random.default_rng(0)
    errors = []
    with np.errstate(over="ignore"):
        for _ in range(150):
            item = rng.integers(0, 2**63, 50).astype(np.uint64)
            a = rng.integers(0, 20, 50)
            b = np.where(rng.random(50) < 0.5, a, rng.integers(0, 20, 50))
            x, y = a > 0, b > 0
            found = bagminhash.registers(np.repeat([0, 1], [x.sum(), y.sum()]), np.concatenate([item[x], item[y]]), np.concatenate([a[x], b[y]]), 2)
            errors.append((found[0] == found[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 4 * np.std(errors) / len(errors) ** 0.5 + 1e-3
    assert np.std(errors) < 0.06


def shingles(text, n=5):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else Counter()


def brute_classes(docs):
    sh = {i: shingles(t) for i, t in docs.items()}
    where = {}
    for i, c in sh.items():
        for s in c:
            where.setdefault(s, []).append(i)
    pairs = {p for ids in where.values() for p in itertools.combinations(sorted(ids), 2)}
    links = []
    for a, b in pairs:
        both = sum((sh[a] & sh[b]).values())
        if both >= 0.8 * (sum(sh[a].values()) + sum(sh[b].values()) - both):
            links.append((a, b))
    return roots(docs, links)


def test_overlap_of_multisets():
    a, b = np.array([1, 1, 2, 3], np.uint64), np.array([1, 2, 2, 4], np.uint64)
    assert bagminhash.overlap(a, b) == 2 / 6
    items = [np.sort(x).view(np.int64) for x in (a, b, np.array([], np.uint64))]
    assert bagminhash.overlaps(items, np.array([0, 2]), np.array([1])).tolist() == [[2], [0]]


def test_near_duplicates_of_the_table(spark, sf):
    docs = table(spark, sf, "documents")
    found = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(docs).collect()}
    assert found == brute_classes({r["doc_id"]: r["text"] for r in docs.collect()})


def test_star_of_near_copies(spark):
    """Copies that are near the base but not each other: every bucket stays unsettled until all are compared."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(200)]
    docs = {}
    for i in range(60):
        copy = list(base)
        if i != 37:
            for k in rng.sample(range(200), 4):
                copy[k] = word()
        docs[i] = " ".join(copy)
    docs |= {100 + i: " ".join(word() for _ in range(30)) for i in range(20)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(df).collect()}
    want = brute_classes(docs)
    assert found == want and sum(v == 0 for v in want.values()) > 50


def test_near_duplicate_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    given = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "a  b\n"), (6, "a b c"), (None, "a b"), (7, long), (8, long + " tail"), (4, "a b"), (9, "x y"), (10, "x y")]
    df = spark.createDataFrame(given, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("words", F.lit("")).withColumn("maybe", F.lit(True))
    rows = bagminhash.near_duplicates(df).collect()
    assert len(rows) == len(given)
    found = {r["doc_id"]: (r["class_id"], r["kept"]) for r in rows}
    alone = {i: (i, True) for i in (1, 2, 3, 4, 6, 7, 9, 10)}
    assert found == alone | {5: (4, False), 8: (7, False), None: (None, True)}
    assert bagminhash.near_duplicates(df.limit(0)).collect() == []


# ---- chunks


def test_gear_hashes_roll():
    rng = np.random.default_rng(1)
    data = rng.integers(1, 256, 300).astype(np.uint8)
    found, h = chunking.gear_hashes(data, 16), []
    for i in range(len(data)):
        h.append(sum(int(chunking.GEAR[data[i - k]]) << k for k in range(min(16, i + 1))) % 2**32)
    assert found.tolist() == h


def test_cuts_resist_insertions():
    rng = random.Random(2)
    words = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400))]
    text = words[0].encode()
    moved = text[:500] + b" something else " + text[500:]
    pieces = lambda t: {t[s : s + n] for _, _, s, n, _ in zip(*chunking.chunk_texts([t]), strict=True)}
    a, b = pieces(text), pieces(moved)
    assert len(a - b) <= 4 and len(a) > 20
    doc, _, start, length, count = chunking.chunk_texts([b"", text, b"x", moved])
    assert set(doc.tolist()) == {1, 2, 3}
    for i, t in ((1, text), (2, b"x"), (3, moved)):
        own = doc == i
        assert b"".join(t[s : s + n] for s, n in zip(start[own], length[own], strict=True)) == t
        assert count[own].sum() == len(t.split())


def brute_cover(docs, n=50):
    """Words per document in windows of n that a document with a smaller id has."""
    seen, out = set(), {}
    for i in sorted(docs):
        w = (docs[i] or "").encode().split()
        windows = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        cover = np.zeros(len(w), bool)
        for k, x in enumerate(windows):
            if x in seen:
                cover[k : k + n] = True
        seen.update(windows)
        out[i] = int(cover.sum())
    return out


def test_passages_of_the_table(spark, sf):
    docs = table(spark, sf, "documents")
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute_cover(given)
    for r in chunking.dedup_passages(docs).collect():
        assert (r["removed_words"] > 0) == (want[r["doc_id"]] > 0)
        assert abs(r["removed_words"] - want[r["doc_id"]]) <= 0.02 * want[r["doc_id"]] + 1
        assert len((r["text"] or "").split()) == len((given[r["doc_id"]] or "").split()) - r["removed_words"]
        assert all(s["first_doc"] < r["doc_id"] for s in r["spans"])


def test_planted_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(1, 8)))
    passage = [word() for _ in range(55)]
    docs = {i: [word() for _ in range(rng.randint(0, 300))] + (passage if i % 3 == 0 else passage[:35] if i % 3 == 1 else []) + [word() for _ in range(rng.randint(0, 300))] for i in range(60)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    for r in chunking.dedup_passages(df).collect():
        planted = r["doc_id"] % 3 == 0 and r["doc_id"] > 0
        assert 55 <= r["removed_words"] <= 57 if planted else r["removed_words"] == 0  # a neighbour may be equal by chance


def test_passage_edges(spark):
    base = " ".join(f"é{i}ü" for i in range(400))
    given = [(1, base, 1), (2, base, 2), (3, "new start " + base, 3), (4, None, 4), (5, "", 5), (None, base, 6), (6, "the " * 200, 7), (7, "the " * 200, 8), (1, base, 9)]
    df = spark.createDataFrame(given, "doc_id long, text string, doc int").withColumn("spans", F.lit(1)).withColumn("digest", F.lit(1)).withColumn("maybe", F.lit(1))
    rows = chunking.dedup_passages(df).collect()
    assert len(rows) == len(given)
    found = {r["doc"]: (r["removed_words"], r["text"]) for r in rows}
    assert found[1] == (0, base) and found[6] == (0, base) and found[9] == (0, base)
    assert found[2] == (400, "") and found[3] == (400, "new start ")
    assert found[4] == (0, None) and found[5] == (0, "")
    assert chunking.dedup_passages(df.limit(0)).collect() == []
