"""A small neural matcher: pooled character trigrams, interactions and a gate, in numpy.

Training looks at a bounded sample of labelled pairs on the driver, in batches
that keep a source-1 record's pairs together; scoring runs over Arrow batches
with the weights broadcast. Trigram buckets come from a stable hash, so that a
saved model means the same in any process.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

BUCKETS = 1 << 15
WIDTH = 24
HIDDEN = 64
MARGIN, RANK_WEIGHT = 0.2, 0.5
AUX = ("name_cosine_sim", "country_match")
#: Pairs that training looks at, at most.
MAX_PAIRS = 500_000
FIELDS = ("name_a", "name_b", "addr_a", "addr_b")


def trigrams(text: str) -> list[str]:
    """Trigrams of the text between ^ and $."""
    text = f"^{text}$"
    return [text] if len(text) < 3 else [text[i : i + 3] for i in range(len(text) - 2)]


def trigram_buckets(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of all texts in a row, and where each text's begin: the same as `bucket_column` (M-8)."""
    known: dict[str, int] = {}
    flat, begins = [], [0]
    for t in texts:
        for g in trigrams(t):
            if g not in known:
                known[g] = int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % buckets
            flat.append(known[g])
        begins.append(len(flat))
    return np.array(flat, np.int64), np.array(begins[:-1], np.int64)


def bucket_column(text, buckets: int = BUCKETS):
    """The trigrams' buckets as a Column of arrays, by md5, which any SQL engine has (M-8)."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - 2, F.lit(1))), lambda i: F.substring(marked, i, F.lit(3)))
    return F.transform(grams, lambda g: F.pmod(F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int"))


class Matcher:
    """p = sigmoid(out . (relu(fc x) * sigmoid(gate x))) over x = [a, b, |a-b|, a*b] of names and addresses, and aux."""

    def __init__(self, n_aux: int = len(AUX), seed: int = 42, buckets: int = BUCKETS, width: int = WIDTH, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.uniform(-np.sqrt(6 / (a + b)), np.sqrt(6 / (a + b)), (a, b)).astype(np.float32)
        n = 8 * width + n_aux
        self.buckets, self.width = buckets, width
        self.params = {
            "table": draw(buckets, width) * np.float32(0.1),
            "fc": draw(n, hidden), "fc_b": np.zeros(hidden, np.float32),
            "gate": draw(n, hidden), "gate_b": np.zeros(hidden, np.float32),
            "out": draw(hidden, 1), "out_b": np.zeros(1, np.float32),
        }

    def _pool(self, texts: list[str]) -> tuple[np.ndarray, tuple]:
        flat, begins = trigram_buckets(texts, self.buckets)
        sizes = np.diff(begins, append=len(flat))
        return np.add.reduceat(self.params["table"][flat], begins, axis=0) / sizes[:, None], (flat, sizes)

    def _forward(self, fields: list[list[str]], aux: np.ndarray):
        p = self.params
        pooled, index = zip(*(self._pool(t) for t in fields), strict=True)
        an, bn, aa, ba = pooled
        x = np.concatenate([an, bn, np.abs(an - bn), an * bn, aa, ba, np.abs(aa - ba), aa * ba, aux], axis=1).astype(np.float32)
        pre = x @ p["fc"] + p["fc_b"]
        gate = 1 / (1 + np.exp(-np.clip(x @ p["gate"] + p["gate_b"], -30, 30)))
        h = np.maximum(pre, 0)
        score = 1 / (1 + np.exp(-np.clip((h * gate) @ p["out"] + p["out_b"], -30, 30)))[:, 0]
        return score, (pooled, index, x, pre, h, gate)

    def predict(self, fields: list[list[str]], aux: np.ndarray, batch: int = 1024) -> np.ndarray:
        if not len(aux):
            return np.zeros(0)
        return np.concatenate([self._forward([f[i : i + batch] for f in fields], aux[i : i + batch])[0] for i in range(0, len(aux), batch)]).astype(float)

    def gradients(self, fields: list[list[str]], aux: np.ndarray, y: np.ndarray, groups: np.ndarray) -> tuple[float, dict]:
        """Loss (cross entropy and, for a true and a false pair of one group, a squared hinge) and its gradients."""
        p, w, n = self.params, self.width, len(y)
        score, (pooled, index, x, pre, h, gate) = self._forward(fields, aux)
        s = np.clip(score, 1e-6, 1 - 1e-6)
        loss = float(-(y * np.log(s) + (1 - y) * np.log(1 - s)).mean())
        d_z = (s - y) / n
        order = np.argsort(groups, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
            pos, neg = part[y[part] == 1], part[y[part] == 0]
            if len(pos) and len(neg):
                short = np.maximum(MARGIN - (s[pos][:, None] - s[neg][None, :]), 0)
                loss += float(RANK_WEIGHT * (short**2).sum() / 2 / n)
                d = np.zeros(n)
                d[pos] = -RANK_WEIGHT * short.sum(axis=1) / n
                d[neg] = RANK_WEIGHT * short.sum(axis=0) / n
                d_z += d * s * (1 - s)
        d_z = d_z[:, None]
        mixed = h * gate
        d_mixed = d_z @ p["out"].T
        d_pre = d_mixed * gate * (pre > 0)
        d_gate = d_mixed * h * gate * (1 - gate)
        d_x = d_pre @ p["fc"].T + d_gate @ p["gate"].T
        grads = {"out": mixed.T @ d_z, "out_b": d_z.sum(axis=0), "fc": x.T @ d_pre, "fc_b": d_pre.sum(axis=0), "gate": x.T @ d_gate, "gate_b": d_gate.sum(axis=0), "table": np.zeros_like(p["table"])}
        for side in (0, 1):
            a, b = pooled[2 * side], pooled[2 * side + 1]
            ga, gb, gd, gp = (d_x[:, (4 * side + i) * w : (4 * side + i + 1) * w] for i in range(4))
            sign = np.sign(a - b)
            for k, g in ((0, ga + gd * sign + gp * b), (1, gb - gd * sign + gp * a)):
                flat, sizes = index[2 * side + k]
                np.add.at(grads["table"], flat, np.repeat(g / sizes[:, None], sizes, axis=0).astype(np.float32))
        return loss, grads

    def fit(self, pairs: pd.DataFrame, aux: tuple[str, ...] = AUX, epochs: int = 8, batch: int = 256, rate: float = 5e-3, seed: int = 42) -> list[float]:
        """Adam over batches of whole source-1 groups; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        groups = pairs["source1_entity_id"].astype("category").cat.codes.to_numpy()
        starts = [g for _, g in pd.Series(np.arange(len(pairs))).groupby(groups)]
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        v = {k: np.zeros_like(x) for k, x in self.params.items()}
        step, history = 0, []
        for _ in range(epochs):
            todo: list[np.ndarray] = []
            losses, count = 0.0, 0
            for at, g in enumerate(rng.permutation(len(starts))):
                todo.append(starts[g].to_numpy())
                if sum(map(len, todo)) < batch and at + 1 < len(starts):
                    continue
                rows = pairs.iloc[np.concatenate(todo)]
                todo = []
                loss, grads = self.gradients([rows[f].tolist() for f in FIELDS], rows[list(aux)].to_numpy(np.float32), rows["label"].to_numpy(float), groups[rows.index.to_numpy()])
                step += 1
                losses, count = losses + loss * len(rows), count + len(rows)
                for k, g_ in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g_
                    v[k] = 0.999 * v[k] + 0.001 * g_ * g_
                    self.params[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            history.append(losses / max(count, 1))
        return history

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **self.params)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Matcher:
        found = cls.__new__(cls)
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            found.params = {k: z[k] for k in z.files}
        found.buckets, found.width = found.params["table"].shape
        return found


def fit(labelled: DataFrame, max_pairs: int = MAX_PAIRS, epochs: int = 8, seed: int = 42) -> tuple[Matcher, list[float]]:
    """Train on labelled pairs with the fields of `features.with_fields`, AUX and label; a bounded sample of source-1 ids by hash."""
    rows = labelled.select("source1_entity_id", *FIELDS, *AUX, "label").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "source1_entity_id")), *FIELDS).limit(max_pairs).toPandas()
    matcher = Matcher(seed=seed)
    return matcher, matcher.fit(rows, epochs=epochs, seed=seed)


def score(matcher: Matcher, rows: DataFrame, column: str = "score") -> DataFrame:
    """The rows with the matcher's probability."""
    shared = rows.sparkSession.sparkContext.broadcast(matcher.dumps())

    def run(batches):
        own = Matcher.loads(shared.value)
        for pdf in batches:
            pdf[column] = own.predict([pdf[f].tolist() for f in FIELDS], pdf[list(AUX)].to_numpy(np.float32))
            yield pdf

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(column, DoubleType())]))
