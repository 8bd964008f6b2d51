"""Packing, sharding and mixing: exact invariants, plain versions and edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.llm import mixing, packing, sharding
from linkwright.llm.common import table

DOC = "doc_id long, text string, lang string, source string"
EDGES = [(1, None, "en", "a"), (2, "", None, None), (3, "x " * 30_000, "en", "a"), (4, "same", "en", "b"), (4, "same", "en", "b"), (None, "no id", "en", "b"), (5, "\t\n", "en", None)]


def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns that are named like results or helpers."""
    return spark.createDataFrame(EDGES, DOC).withColumn("size", F.lit("z")).withColumn("piece", F.lit(7)).withColumn("grp", F.lit(1)).withColumn("shard", F.lit(1)).withColumn("bin", F.lit(1)).withColumn("target", F.lit(1))


def empty_docs(spark):
    return spark.createDataFrame([], DOC)


# ---- packing


def test_fast_tokens_are_the_vocabulary_files():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    rng = random.Random(1)
    texts = ["", " ", "a<|endoftext|>b", "Hello  world\n\n\tx", "é" * 50, " \x85\xa0 ½"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x800), rng.randrange(0x4E00, 0x9000), 32, 10])) for _ in range(60)) for _ in range(200)]
    for start in range(0, 0x30000, 0x40):  # every code point stands between letters, digits and spaces once
        texts.append("".join(f"a{chr(c)}1 {chr(c)}" for c in range(start, start + 0x40) if not 0xD800 <= c < 0xE000))
    for t in texts:
        assert fast(t).tolist() == exact.encode(t, add_special_tokens=False).ids


def test_cut():
    assert packing.cut(1, 8) == [(0, 1)]
    assert packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(9, 8) == [(0, 1), (1, 8)]
    assert packing.cut(24, 8) == [(0, 8), (8, 8), (16, 8)]


def plain_packer(lengths, capacity, open_bins):
    """Best fit over a list of open bins."""
    bins, number, out = [], 0, []
    for n in lengths:
        fit = min((b for b in bins if b[0] >= n), key=lambda b: b[0], default=None)
        if fit is None:
            if len(bins) >= open_bins:
                bins.remove(min(bins, key=lambda b: b[0]))
            fit = [capacity, number]
            number += 1
            bins.append(fit)
        out.append(capacity - fit[0])
        fit[0] -= n
        if not fit[0]:
            bins.remove(fit)
    return out, number


@pytest.mark.parametrize("open_bins", [1, 3, 50])
def test_packer_follows_a_plain_version(open_bins):
    rng = random.Random(open_bins)
    lengths = [rng.randint(1, 40) for _ in range(500)]
    packer = packing.Packer(40, open_bins)
    found = [packer.place(n) for n in lengths]
    offsets, bins = plain_packer(lengths, 40, open_bins)
    assert [o for _, o in found] == offsets and packer.n_bins == bins
    with pytest.raises(ValueError):
        packer.place(41)


def check_packing(spark, docs, rows, limit=2048):
    encode = packing.encoder()
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for cells in bins.values():
        at = 0
        for offset, length in sorted(cells):
            assert offset == at
            at += length
        assert at <= limit
    for r in docs.select("doc_id", "text").distinct().collect():
        ids = np.append(encode(r["text"] or ""), np.uint32(0)).astype("<u4")
        pieces = {(p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in by_doc[r["doc_id"]]}
        cuts = packing.cut(len(ids), limit)
        assert pieces == {(k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(cuts)}
        assert all(n == limit for _, n in cuts[1:])
    return len(bins)


def test_packing(spark, sf):
    docs = table(spark, sf, "documents")
    rows = packing.pack_documents(docs).collect()
    bins = check_packing(spark, docs, rows)
    assert bins <= sum(r["length"] for r in rows) / 2048 * 1.02 + 1
    assert sorted(rows) == sorted(packing.pack_documents(docs.repartition(7)).collect())  # no matter how rows are dealt


def test_packing_in_groups_and_edges(spark):
    docs = edge_docs(spark)
    rows = packing.pack_documents(docs, group_docs=2).collect()
    check_packing(spark, docs, rows)
    assert sum(r["doc_id"] == 4 for r in rows) == 2 and any(r["doc_id"] is None for r in rows)
    assert packing.pack_documents(empty_docs(spark)).collect() == []


# ---- sharding


def test_flow_deals_everything_out():
    rng = random.Random(0)
    counts = [rng.randint(0, 30) for _ in range(40)]
    owners = [rng.randrange(5) for _ in range(40)]
    room = sharding.shares(sum(counts), 5)
    runs = sharding.flow(counts, owners, room)
    slots = {i: [] for i in range(5)}
    for n, own in zip(counts, runs, strict=True):
        at = 0
        for lo, hi, shard, first in own:
            assert lo == at
            at = hi
            slots[shard] += range(first, first + hi - lo)
        assert at == n
    assert [sorted(s) for s in slots.values()] == [list(range(r)) for r in room]


@pytest.mark.parametrize("law", ["rows", "key"])
def test_sharding(spark, sf, law):
    docs = table(spark, sf, "documents")
    rows = sharding.shard_documents(docs, law=law).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), law)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if law == "rows":
        loads = [len(slots.get(i, [])) for i in range(16)]
        assert max(loads) - min(loads) <= 1 and all(r["grown_shard"] is None for r in rows)
    else:
        grown = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 17, law="key").collect()}
        assert all(r["grown_shard"] == grown[r["doc_id"]] for r in rows)
        assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    again = sharding.shard_documents(docs.repartition(5), law=law).collect()
    assert sorted(rows, key=str) == sorted(again, key=str)


def test_sharding_moves_few_rows(spark, sf):
    """One row more moves few others, unlike counting rows off."""
    docs = table(spark, sf, "documents")
    one = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 4).collect()}
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(10**9, "new")], "doc_id long, text string"))
    two = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(more, 4).collect()}
    assert sum(two[k] != v for k, v in one.items()) <= len(one) * 0.1


def test_sharding_edges(spark):
    for law in ("rows", "key"):
        rows = sharding.shard_documents(edge_docs(spark), 3, law).collect()
        assert len(rows) == len(EDGES) and sum(r["doc_id"] is None for r in rows) == 1
        assert sharding.shard_documents(empty_docs(spark), 3, law).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_documents(edge_docs(spark), law="bytes")


# ---- mixing


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    """Sources in order -> targets, by capping and resharing until none is above."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    total, stopped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: w[s] * left / sum(w[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > cap * sizes[s]]
        if not above:
            return stopped | share
        stopped |= {s: cap * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, None: 5}, {"a": 1000, "b": 1, "c": 1, "d": 2, None: 3}, {"a": 7}, {"a": 0, "b": 9, "c": 5}])
def test_targets_follow_a_plain_version(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert found == pytest.approx(plain_targets(sizes))


def test_mixing(spark, sf):
    docs = table(spark, sf, "documents")
    rows = mixing.mix_sources(docs).collect()
    given = {r["doc_id"]: r for r in docs.collect()}
    sizes, taken, target = {}, {}, {}
    assert sorted(r["doc_id"] for r in rows) == sorted(given)
    for r in rows:
        d = given[r["doc_id"]]
        assert r["size"] == len((d["text"] or "").encode().split())
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        sizes[d["source"]] = sizes.get(d["source"], 0) + r["size"]
        taken[d["source"]] = taken.get(d["source"], 0) + r["taken"]
        target[d["source"]] = r["target"]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    assert target == pytest.approx(plain_targets({s: sizes[s] for s in order}))
    for s in sizes:
        own = [r["size"] for r in rows if given[r["doc_id"]]["source"] == s]
        assert target[s] - max(own) <= taken[s] <= target[s] + 1e-6  # never beyond, and short by less than a document
    assert sorted(rows) == sorted(mixing.mix_sources(docs.repartition(9)).collect())


def test_inclusion_is_fair(spark):
    """Each of equal documents is taken with the same probability over seeds."""
    df = spark.createDataFrame([(i, "w " * 10, "a" if i < 40 else "b") for i in range(80)], "doc_id long, text string, source string")
    total = np.zeros(80)
    for seed in range(12):
        for r in mixing.mix_sources(df, weights=(1, 3), seed=seed).collect():
            total[r["doc_id"]] += r["copies"]
    assert total[:40].sum() == 12 * 20 and total[40:].sum() == 12 * 60
    assert total[:40].min() >= 1 and total[:40].max() <= 11


def test_mixing_edges(spark):
    rows = mixing.mix_sources(edge_docs(spark)).collect()
    assert len(rows) == len(EDGES)
    assert sorted(r["size"] for r in rows) == [0, 0, 0, 1, 1, 2, 30_000]
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix_sources(empty_docs(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix_sources(blank).collect()] == [0, 0]
