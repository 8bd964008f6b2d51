"""Language identification by error-correcting output codes (operator 6).

Every language has a codeword of bits. For each bit a binary classifier over
hashed byte n-grams (of two and three bytes of the lower-cased UTF-8 text) is
trained to tell the languages whose bit is set from the others: its weights
are the smoothed log odds of the n-grams. A text's margins, one per bit, are
decoded by loss-weighted decoding: the language whose codeword has the least
logistic loss, each bit weighted by how well its classifier does on that
language's training texts. Texts whose best two codewords are near each other
are flagged as ambiguous.

Training reads a bounded sample, about SAMPLE texts per language chosen by a
hash of the doc_id; all languages are learned. The driver takes the n-gram rates
of one language after the other and keeps sums per bit only, so that its memory
grows with the number of bits, about ten times the logarithm of the number of
languages. Prediction is one pass over the whole texts in numpy.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import materialize, parts, slices

#: Training texts per language, about.
SAMPLE = 1500
#: Of so many languages or fewer, the best of TRIES random codes is taken; of more, the first with distinct words.
TRIES, COMPARED = 200, 1000
#: Hash buckets of n-grams.
BUCKETS = 1 << 16
#: n-grams after which a text's evidence no longer grows, and what one of them counts.
EVIDENCE, PER_GRAM = 200, 0.25
#: A text is ambiguous if its score is below this.
AMBIGUOUS = 0.6
#: Folds by crc32 of the doc_id; this one is never learned from.
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: Bytes and documents that are looked at at a time.
CHUNK_BYTES, CHUNK_DOCS = 1_000_000, 512


def codewords(n: int, seed: int = 6) -> np.ndarray:
    """(n, bits) of -1 and 1: all ways to part up to five languages, else 10 log2(n) random ones far apart."""
    if n <= 5:
        cols = [(1, *c) for c in product((1, -1), repeat=max(n - 1, 0)) if -1 in c] or [(1,) * n]
        return np.array(cols, np.int8).T.reshape(n, -1)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, apart = None, -1
    for _ in range(TRIES):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        if (np.abs(code.sum(axis=0, dtype=np.int64)) == n).any() or len(np.unique(code, axis=0)) < n:
            continue
        if n > COMPARED:
            return code
        far = ((bits - code.astype(int) @ code.T.astype(int)) // 2 + np.eye(n, dtype=int) * bits).min()
        if far > apart:
            best, apart = code, far
    return best


def _grams(data: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams that start at each byte but the last two: (positions, 2)."""
    x = data.astype(np.uint32)
    two = x[:-2] << 8 | x[1:-1]
    three = two << 8 | x[2:]
    out = np.empty((len(two), 2), np.int64)
    out[:, 0] = (two * np.uint32(2654435761) ^ np.uint32(0x5BD1E995)) >> 16
    out[:, 1] = (three * np.uint32(2246822519)) >> 16
    return out


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one buffer, each between spaces, and where each begins."""
    parts = [b" " + t + b"  " for t in texts]
    begins = np.cumsum([0, *map(len, parts)])[:-1]
    return np.frombuffer(b"".join(parts), np.uint8), begins


def margins(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """(texts, bits): mean log odds per n-gram, times the evidence."""
    out = np.zeros((len(texts), weights.shape[1]))
    sizes = np.array([len(t) for t in texts])
    for a, b in slices([s + 3 for s in sizes], CHUNK_BYTES):
        data, begins = _joined(texts[a:b])
        grams = _grams(data)
        step = max(1 << 12, (1 << 21) // max(weights.shape[1], 1))
        total = np.zeros((b - a, weights.shape[1]))
        for low in range(0, len(grams), step):  # keeps what is gathered in the processor's cache
            part = grams[low : low + step]
            got = weights[part[:, 0]] + weights[part[:, 1]]
            first = max(np.searchsorted(begins, low, "right") - 1, 0)
            cuts = np.maximum(begins[first : np.searchsorted(begins, low + len(part))] - low, 0)
            total[first : first + len(cuts)] += np.add.reduceat(got, cuts, axis=0)
        n = sizes[a:b] + 1
        out[a:b] = total / (2 * n)[:, None] * (np.minimum(2 * n, EVIDENCE) * PER_GRAM)[:, None]
    return out


def decode(found: np.ndarray, code: np.ndarray, trust: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of the codeword with the least weighted loss, and its share among all: a score of 0 to 1."""
    total = np.logaddexp(0, -found) @ (trust * (code > 0)).T + np.logaddexp(0, found) @ (trust * (code < 0)).T
    least = total.min(axis=1, keepdims=True)
    share = np.exp(least - total)
    return total.argmin(axis=1), 1 / share.sum(axis=1)


class Model:
    """languages, codewords (languages, bits), weights (buckets, bits), trust (languages, bits; rows sum to the bits)."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.trust = languages, code, weights, trust

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return decode(margins(texts, self.weights), self.code, self.trust)


def _fold():
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(FOLDS))


def _lowered(texts: pa.Array) -> list[bytes]:
    return [t.lower().encode() for t in texts.to_pylist()]


def training_sample(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang and text of about `sample` labelled documents of each language, none of the held-out fold."""
    known = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (_fold() != HELD_OUT) & F.col("text").rlike(r"\p{L}"))
    counts = materialize(known.groupBy("lang").count(), "lang-counts")  # broadcast by Spark as long as it is small
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) < F.lit(float(sample)) / F.col("count") * (1 << 30)
    return materialize(known.join(counts, "lang").where(share).select("lang", "text"), "lang-sample")


def _rates(chosen: DataFrame) -> DataFrame:
    """lang and its smoothed n-gram rates as BUCKETS doubles in bytes: one row per language, each made by one task.

    A language has about SAMPLE texts here, so no task is unbounded.
    """

    def count(batches):
        last, total = None, np.zeros(BUCKETS, np.int64)

        def row() -> pa.RecordBatch:
            rates = (total + 0.5) / (total + 0.5).sum()  # each language counts alike
            return pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.array([rates.tobytes()], pa.binary())], ["lang", "rates"])

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            ends = [i + 1 for i in range(len(langs)) if i + 1 == len(langs) or langs[i + 1] != langs[i]]
            for a, b in zip([0, *ends], ends):  # noqa: B905
                if langs[a] != last:
                    if last is not None:
                        yield row()
                    last, total = langs[a], np.zeros(BUCKETS, np.int64)
                for low in range(a, b, CHUNK_DOCS):
                    own = _lowered(texts.slice(low, min(CHUNK_DOCS, b - low)))
                    for x, y in slices(list(map(len, own)), CHUNK_BYTES):
                        total += np.bincount(_grams(_joined(own[x:y])[0]).ravel(), minlength=BUCKETS)
        if last is not None:
            yield row()

    return chosen.repartition("lang").sortWithinPartitions("lang").mapInArrow(count, "lang string, rates binary")


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the documents' text and lang."""
    chosen = training_sample(docs, sample)
    languages = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((BUCKETS, 0)), np.zeros((0, 0)))
    code = codewords(len(languages))
    row = {x: i for i, x in enumerate(languages)}
    rates = materialize(_rates(chosen), "lang-rates")
    total, positive = np.zeros(BUCKETS), np.zeros((code.shape[1], BUCKETS))
    for r in rates.toLocalIterator():  # one partition of languages at a time
        own = np.frombuffer(r["rates"])
        total += own
        positive[code[row[r["lang"]]] > 0] += own
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        n = int((code[:, bit] > 0).sum())
        if n:
            weights[:, bit] += np.log(positive[bit] / n)
        if n < len(languages):
            weights[:, bit] -= np.log((total - positive[bit]) / (len(languages) - n))

    def check(batches):
        for batch in parts(batches, CHUNK_DOCS):
            langs = batch.column(0).to_pylist()
            right = margins(_lowered(batch.column(1)), weights) * code[[row[x] for x in langs]] > 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, right.size + 1, code.shape[1], dtype=np.int32)), pa.array(right.ravel().astype(np.float64)))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), lists], ["lang", "right"])

    told = chosen.mapInArrow(check, "lang string, right array<double>").groupBy("lang").agg(*(F.avg(F.get("right", F.lit(i))).alias(f"b{i}") for i in range(code.shape[1]))).collect()
    trust = np.zeros(code.shape)
    for r in told:
        trust[row[r["lang"]]] = [r[f"b{i}"] for i in range(code.shape[1])]
    trust = np.maximum(trust, 1e-3)
    return Model(languages, code.astype(np.float64), weights, trust / trust.sum(axis=1, keepdims=True) * code.shape[1])


def identify(docs: DataFrame, model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """All columns of docs and lang_pred, score, ambiguous.

    docs needs doc_id, text and, to learn from, lang; a given model only needs
    text. A null text, or one without a letter, is `und` with score 0; so is
    everything if there is nothing to learn from. Whole texts count, at any
    length. A null doc_id is not learned from. Repeated rows are predicted each
    for itself; columns that are named like the results are replaced.
    """
    model = model or train(docs, sample)
    docs = docs.drop("lang_pred", "score", "ambiguous")
    names = [f.name for f in docs.schema.fields]
    kept = docs.withColumn("_told", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])

    def run(batches):
        for batch in parts(batches, CHUNK_DOCS):
            lang, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            at = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
            if len(at) and model.languages:
                texts = batch.column(names.index("text"))
                best, sure = model.predict(_lowered(texts.take(pa.array(at))))
                lang[at], score[at] = np.array(model.languages, object)[best], sure
            ambiguous = (lang != UNKNOWN) & (score < AMBIGUOUS)
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score), pa.array(ambiguous)], [*names, "lang_pred", "score", "ambiguous"])

    return kept.mapInArrow(run, schema)


def language_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document."""
    model = train(docs)
    found = identify(docs.select("doc_id", "text"), model)
    held = F.coalesce(_fold() == HELD_OUT, F.lit(False))
    return found.select(F.col("doc_id").cast("long"), held.alias("held_out"), "lang_pred", "score", "ambiguous")
