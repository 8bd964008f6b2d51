"""Operators do the whole job: nothing is left out because it is frequent, long or late."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from linkwright.operators import extra


def plain_tfidf(ones, others, k, floor):
    """ones: (id, area, name); others: (source, id, area, name). Cosine of every pair of an area over all grams."""
    count = lambda name: Counter(name[i : i + n] for n in (2, 3, 4) for i in range(len(name) - n + 1))
    df, total = Counter(), Counter()
    for _, _, area, name in others:
        total[area] += 1
        df.update((area, g) for g in count(name))
    unit = lambda area, name: (lambda w: {g: x / math.sqrt(sum(y * y for y in w.values())) for g, x in w.items()})({g: n * (math.log((1 + total[area]) / (1 + df[area, g])) + 1) for g, n in count(name).items()})
    held, best = [(s, i, a, unit(a, n)) for s, i, a, n in others], defaultdict(list)
    for i, area, name in ones:
        w = unit(area, name)
        for s, j, a, v in held:
            if a == area and (x := round(sum(y * v.get(g, 0.0) for g, y in w.items()), 6)) >= floor:
                best[i, s].append((-x, j))
    return {(i, j, s): -x for (i, s), found in best.items() for x, j in sorted(found)[:k]}


def test_frequent_grams_count(spark, monkeypatch):
    """Grams that more than 300 reference records have are part of the cosine, and pairs that share no others are found."""
    monkeypatch.setattr(extra, "LEFT_BLOCK", 8)
    monkeypatch.setattr(extra, "RIGHT_BLOCK", 150)
    monkeypatch.setattr(extra, "GRAM_SLICE", 64)
    rng = random.Random(3)
    words = ["steel", "brass", "copper", "nickel"]
    name = lambda: " ".join(rng.choice(words) for _ in range(3))
    ones = [(f"q{i}", "xy"[i % 2], name()) for i in range(20)] + [("alone", "z", "steel")]
    others = [("S2" if i % 3 else "S3", f"r{i:04}", "xy"[i % 2], name()) for i in range(1400)]
    s1 = spark.createDataFrame(ones, "entity_id string, area string, name string")
    reference = spark.createDataFrame(others, "source string, entity_id string, area string, name string")
    found = {(r["source1_entity_id"], r["other_id"], r["source"]): r["similarity"] for r in extra.tfidf_neighbours(s1, reference, k=15).collect()}
    want = plain_tfidf(ones, others, 15, 0.2)
    assert len(want) == 20 * 2 * 15 and found.keys() == want.keys()
    assert all(found[p] == pytest.approx(x, abs=2e-6) for p, x in want.items())


def test_nearest_vectors_by_parts(spark, monkeypatch):
    """Vectors in many parts of a block, ties, and vectors without a direction."""
    monkeypatch.setattr(extra, "VECTOR_BLOCK", 16)
    rng = np.random.default_rng(1)
    kept = {i: (i % 2, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(150)}
    odd = [(200, 0, None), (201, 0, []), (202, 1, [0.0] * 4), (203, 1, [1.0, None, 1.0, 1.0]), (204, 0, [float("nan"), 1.0, 1.0, 1.0]), (205, 1, [float("inf"), 1.0, 1.0, 1.0]), (206, None, [1.0] * 4)]
    rows = spark.createDataFrame([(i, b, v) for i, (b, v) in kept.items()] + odd, "id long, block int, vector array<double>")
    found = {(r["left_id"], r["rank"]): (r["right_id"], r["similarity"]) for r in extra.vector_neighbours(rows.where("id % 3 = 0"), rows, 5).collect()}
    want = {}
    usable = {i: (b, np.array(v) / np.linalg.norm(v)) for i, (b, v) in kept.items() if any(v)}
    for i, (b, v) in usable.items():
        if i % 3 == 0:
            near = sorted((-round(float(v @ w), 6), j) for j, (c, w) in usable.items() if c == b and j != i)[:5]
            want |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(near)}
    assert found == want
