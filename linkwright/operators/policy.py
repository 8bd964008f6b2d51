"""Training of the stopping policy: the exact gradient of the expected F0.5.

A policy's state depends on the sorted scores only, not on what it did before.
So the probability to stop at each place is a product of the network's outputs
and the expected F0.5 of an entity is a closed form, which is differentiated
exactly; rollouts with sampling noise are not needed. `sampled_update` has the
sampled estimate for comparison.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decide

HIDDEN = 32
#: Entities that training looks at, at most.
MAX_ENTITIES = 20_000


def initial(hidden: int = HIDDEN, seed: int = 42) -> dict:
    rng = np.random.default_rng(seed)
    limit = lambda a, b: np.sqrt(6 / (a + b))
    n = len(decide.STATE)
    return {"w1": rng.uniform(-limit(n, hidden), limit(n, hidden), (n, hidden)), "b1": np.zeros(hidden), "w2": rng.uniform(-limit(hidden, 1), limit(hidden, 1), hidden), "b2": 0.0}


def episodes(scored: DataFrame, truth: DataFrame, max_entities: int = MAX_ENTITIES, seed: int = 42) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per entity: its states (steps, 7) and the F0.5 of stopping at each place (steps + 1). A bounded sample by hash."""
    key = ["source1_entity_id", "other_id"]
    true = truth.select(*key).distinct().withColumn("_true", F.lit(1))
    total = true.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("n_true"))
    ids = scored.select("source1_entity_id").distinct().orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "source1_entity_id"))).limit(max_entities)
    rows = decide.policy_states(scored.join(ids, "source1_entity_id", "left_semi")).where(F.col("rank") <= decide.MAX_STEPS)
    rows = rows.join(true, key, "left").join(total, "source1_entity_id", "left")
    state = F.struct("rank", F.array(*decide.STATE).alias("state"), F.coalesce("_true", F.lit(0)).alias("hit"))
    out = []
    for r in rows.groupBy("source1_entity_id").agg(F.sort_array(F.collect_list(state)).alias("steps"), F.max(F.coalesce("n_true", F.lit(0))).alias("n_true")).toLocalIterator():
        hits = np.concatenate(([0], np.cumsum([s["hit"] for s in r["steps"]])))
        k, n = np.arange(len(hits)), r["n_true"]
        value = np.where(k + n == 0, 1.0, 1.25 * hits / np.maximum(k + 0.25 * n, 1e-12)) if n else (k == 0).astype(float)
        out.append((np.array([s["state"] for s in r["steps"]]), value))
    return out


def _continue(weights: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.maximum(x @ weights["w1"] + weights["b1"], 0)
    return 1 / (1 + np.exp(-np.clip(h @ weights["w2"] + weights["b2"], -30, 30))), h


def expected(weights: dict, sample: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """Mean expected F0.5 of the entities."""
    total = 0.0
    for x, value in sample:
        c, _ = _continue(weights, x)
        go = np.concatenate(([1.0], np.cumprod(c)))
        total += float((go * np.append(1 - c, 1.0) * value).sum())
    return total / max(len(sample), 1)


def gradient(weights: dict, sample: list[tuple[np.ndarray, np.ndarray]], entropy: float = 0.01) -> dict:
    """Gradient of the mean expected F0.5 plus an entropy bonus, which pulls towards an even chance."""
    out = {k: np.zeros_like(np.asarray(v, float)) for k, v in weights.items()}
    for x, value in sample:
        c, h = _continue(weights, x)
        n = len(c)
        later = np.empty(n + 1)  # expected value from each place on
        later[n] = value[n]
        for t in range(n - 1, -1, -1):
            later[t] = (1 - c[t]) * value[t] + c[t] * later[t + 1]
        reach = np.concatenate(([1.0], np.cumprod(c)))[:n]
        d_c = reach * (later[1:] - value[:n]) + entropy * np.log((1 - c + 1e-9) / (c + 1e-9))
        d_z = d_c * c * (1 - c)
        d_h = np.outer(d_z, weights["w2"]) * (h > 0)
        out["w2"] += h.T @ d_z
        out["b2"] += d_z.sum()
        out["w1"] += x.T @ d_h
        out["b1"] += d_h.sum(axis=0)
    return {k: v / max(len(sample), 1) for k, v in out.items()}


def train(sample: list[tuple[np.ndarray, np.ndarray]], epochs: int = 25, batch: int = 64, rate: float = 1e-2, seed: int = 42, hidden: int = HIDDEN, rollouts: int = 0, log: list[float] | None = None) -> dict:
    """Weights by Adam on the exact gradient, or on the sampled one of so many rollouts per entity. log gets the expected F0.5 after each epoch."""
    weights, rng = initial(hidden, seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(np.asarray(v, float)) for k, v in weights.items()}
    v = {k: x.copy() for k, x in m.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(sample))
        for a in range(0, len(order), batch):
            step += 1
            some = [sample[i] for i in order[a : a + batch]]
            slope = sampled_update(weights, some, rollouts, seed + step, entropy=0.01) if rollouts else gradient(weights, some)
            for k, g in slope.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                weights[k] = weights[k] + rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if log is not None:
            log.append(expected(weights, sample))
    return weights


def sampled_update(weights: dict, sample: list[tuple[np.ndarray, np.ndarray]], rollouts: int = 6, seed: int = 0, entropy: float = 0.0) -> dict:
    """The sampled policy gradient with the mean reward as baseline: an unbiased, noisy version of `gradient`.

    The entropy bonus, if any, is added at the places a rollout decides at.
    """
    rng = np.random.default_rng(seed)
    out = {k: np.zeros_like(np.asarray(v, float)) for k, v in weights.items()}
    runs = []
    for x, value in sample:
        c, h = _continue(weights, x)
        for _ in range(rollouts):
            stop = np.flatnonzero(rng.random(len(c)) >= c)
            k = int(stop[0]) if len(stop) else len(c)
            runs.append((x, h, c, k, value[k]))
    base = np.mean([r[4] for r in runs])
    for x, h, c, k, reward in runs:
        d_z = np.zeros(len(c))
        d_z[:k] = (1 - c[:k]) * (reward - base)
        if k < len(c):
            d_z[k] = -c[k] * (reward - base)
        at = slice(0, k + 1)
        d_z[at] += entropy * np.log((1 - c[at] + 1e-9) / (c[at] + 1e-9)) * c[at] * (1 - c[at])
        d_h = np.outer(d_z, weights["w2"]) * (h > 0)
        out["w2"] += h.T @ d_z
        out["b2"] += d_z.sum()
        out["w1"] += x.T @ d_h
        out["b1"] += d_h.sum(axis=0)
    return {k: v / max(len(runs), 1) for k, v in out.items()}


def dumps(weights: dict) -> str:
    return json.dumps({k: np.asarray(v).tolist() for k, v in weights.items()})


def loads(text: str) -> dict:
    return {k: np.array(v) if isinstance(v, list) else float(v) for k, v in json.loads(text).items()}
