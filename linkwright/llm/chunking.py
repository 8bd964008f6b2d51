"""Substring deduplication by content-defined chunks (operator 4).

A gear hash rolls over the bytes of a text (every step shifts the hash left and
adds a number that a table gives for the byte; here the last WINDOW bytes
count). A chunk ends where the hash is the smallest within REACH bytes either
way, so that cuts depend on nothing but the bytes near them: an insertion moves
the chunks behind it but does not change them, and a repeated passage is cut
alike wherever it stands. Where nothing is smallest for long (a monotonous
stretch), a chunk ends after MAX_CHUNK bytes. Chunks are deduplicated by digest.

A chunk, or a sequence of chunks of some length, that an earlier document (one
with a smaller doc_id) has as well is a seed. Seeds that continue each other in both documents form a run; a run with
enough words to belong to a passage of MIN_WORDS is extended byte by byte in
both directions, and the words that the two texts then share are removed from
the later document if there are MIN_WORDS of them. The first document that has
a passage keeps it.

Runs find most passages with few numbers, but not all: a passage of short words
may hold no whole chunk, and the first document that has a chunk need not have
the passage. So a second pass settles the windows of MIN_WORDS words that no run
covers. Its sieve is the smallest hash of the short word sequences in a window:
equal windows have equal ones, and few differ within a text. Only windows whose
smallest hash several documents have are compared, each by its own hash with
the first document that has it.

Numbers only are shuffled (a digest, a doc_id and a packed place per chunk, a
hash per stretch of words, and those of the windows left); of texts, only those
of documents with runs or repeated hashes move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_in, parts, release, slices

WINDOW, REACH = 16, 24
#: Words that a passage must have to be removed.
MIN_WORDS = 50
#: Words in whole chunks that a run must have to be looked at; passages with fewer are left to the pass over windows.
RUN_WORDS = 10
#: Words of the sequences of chunks whose first document is looked for, besides that of single chunks.
GRAM_WORDS = (32, 50)
#: Bytes that a run is extended by at most, either way: far more than to the next cut. What a run then still
#: leaves of a passage (in a chunk longer than this) is left to the pass over windows.
CONTEXT = 512
#: Bytes of a chunk at most.
MAX_CHUNK = (1 << 16) - 1
#: Bytes and documents that are cut at a time.
CHUNK_BYTES, CHUNK_DOCS = 1_000_000, 1024
_WORDS, _LENGTH = 1 << 16, 1 << 16  # a packed place: start (31 bits, as strings have 2 GB at most), length, words


def gear_table() -> np.ndarray:
    """A number for each byte, from splitmix64 of the byte; 0 for byte 0, which pads."""
    from .bagminhash import mix

    with np.errstate(over="ignore"):
        out = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    out[0] = 0
    return out


GEAR = gear_table()


def gear_hashes(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The gear hash of the last `window` (a power of two) bytes at each place: sum of GEAR[byte i back] << i."""
    h = GEAR[data]
    step = 1
    while step < window:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))  # hashes of `step` bytes pair up
        step *= 2
    return h


def _windowed_min(h: np.ndarray, width: int) -> np.ndarray:
    """min of h[i : i + width] for each i; past the end counts the largest value."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        new = out.copy()
        np.minimum(out[:-step], out[step:], out=new[:-step])
        out, have = new, have + step
    return out


def cuts(data: np.ndarray, inside: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Places whose hash is the smallest within reach (of equal ones the first). inside: not padding."""
    h = gear_hashes(data)
    h[~inside] = 0xFFFFFFFF
    low = _windowed_min(h, reach)  # of h[i : i + reach]
    before = np.full_like(h, 0xFFFFFFFF)
    before[reach:] = low[:-reach]
    after = np.full_like(h, 0xFFFFFFFF)
    after[:-1] = low[1:]
    return np.flatnonzero(inside & (h < before) & (h <= after))


def _is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _starts(ends: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the start of the chunks that end at `ends`; begins: where the texts begin."""
    doc = np.searchsorted(begins, ends - 1, "right") - 1
    first = np.concatenate(([True], doc[1:] != doc[:-1])) if len(ends) else np.zeros(0, bool)
    return doc, np.where(first, begins[doc], np.concatenate(([0], ends[:-1])) if len(ends) else ends)


def chunk_texts(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Per chunk: the text's number, its digest, start, length, and the words that begin in it."""
    import xxhash

    out: list[tuple] = []
    pad = b"\0" * (REACH + WINDOW)
    for a, b in slices([len(t) + len(pad) for t in texts], CHUNK_BYTES):
        buffer = b"".join(x for t in texts[a:b] for x in (pad, t))
        data = np.frombuffer(buffer, np.uint8)
        sizes = np.array([len(t) for t in texts[a:b]])
        begins = np.cumsum(sizes + len(pad)) - sizes
        inside = np.zeros(len(data) + 1, np.int32)
        np.add.at(inside, begins, 1)
        np.add.at(inside, begins + sizes, -1)
        inside = np.cumsum(inside[:-1]) > 0
        space = _is_space(data) | ~inside
        words = np.concatenate(([0], np.cumsum(~space & np.concatenate(([True], space[:-1])))))
        ends = np.union1d(cuts(data, inside) + 1, (begins + sizes)[sizes > 0])
        doc, starts = _starts(ends, begins)
        if (far := np.flatnonzero(ends - starts > MAX_CHUNK)).size:
            more = [np.arange(starts[i] + MAX_CHUNK, ends[i], MAX_CHUNK) for i in far]
            ends = np.union1d(ends, np.concatenate(more))
            doc, starts = _starts(ends, begins)
        view = memoryview(buffer)
        digests = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(ends))
        out.append((doc + a, digests.view(np.int64), starts - begins[doc], ends - starts, words[ends] - words[starts]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True))


def chunks(docs: DataFrame) -> DataFrame:
    """digest, doc, place of every chunk. place packs start, length and words; see `_unpacked`."""

    def run(batches):
        for batch in parts(batches, CHUNK_DOCS):
            ids = batch.column(0).to_numpy()
            doc, digest, start, length, words = chunk_texts(batch.column(1).to_pylist())
            place = (start * _LENGTH + length) * _WORDS + words
            yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(ids[doc] if len(doc) else doc), pa.array(place)], ["digest", "doc", "place"])

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return texts.mapInArrow(run, "digest long, doc long, place long")


def _unpacked(place) -> tuple:
    words = F.pmod(place, F.lit(_WORDS))
    rest = F.shiftright(place, 16)
    return F.shiftright(rest, 16), F.pmod(rest, F.lit(_LENGTH)), words


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """The rows (key, doc, place) of keys that more than one document has, with the first_doc that has the key."""
    ends = rows.groupBy("key").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
    common = materialize(ends.where("first_doc < last_doc").select("key", "first_doc"), f"{name}-common")
    found = materialize(rows.join(common, "key"), f"{name}-repeats")
    release(common)
    return found


def _seeds(shared: DataFrame) -> DataFrame:
    """doc, first_doc, start, length, words, first_start: where a later document has what first_doc has."""
    origin = shared.where("doc = first_doc").groupBy("key").agg(F.min("place").alias("origin"))
    start, length, words = _unpacked(F.col("place"))
    found = shared.where("doc > first_doc").join(origin, "key")
    return found.select("doc", "first_doc", start.alias("start"), length.alias("length"), words.alias("words"), _unpacked(F.col("origin"))[0].alias("first_start"))


def grams(repeats: DataFrame) -> DataFrame:
    """key, doc, place of sequences of repeated chunks that follow each other.

    From each chunk on, the shortest sequence with so many words as each of
    GRAM_WORDS; what follows a chunk decides where it ends, so it is the same
    wherever the passage stands. Of a sequence longer than a place can tell,
    its beginning is told.
    """

    def run(batches):
        import xxhash

        held = [np.zeros(0, np.int64)] * 3  # rows of the document that the last batch ended in
        for batch in batches:
            doc, place, digest = (np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held))
            cut = int(np.searchsorted(doc, doc[-1])) if len(doc) else 0
            held = [doc[cut:], place[cut:], digest[cut:]]
            yield _grams(doc[:cut], place[:cut], digest[:cut], xxhash)
        yield _grams(*held, xxhash)

    rows = repeats.select("doc", "place", F.col("key").alias("digest")).repartition("doc").sortWithinPartitions("doc", "place")
    return rows.mapInArrow(run, "key long, doc long, place long")


def _grams(doc: np.ndarray, place: np.ndarray, digest: np.ndarray, xxhash) -> pa.RecordBatch:
    start, length, words = place >> 32, (place >> 16) % _LENGTH, place % _WORDS
    n = len(doc)
    follows = np.zeros(n, bool)
    follows[1:] = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + length[:-1])
    run = np.cumsum(~follows)
    upto = np.concatenate(([0], np.cumsum(words)))
    keys, at, ends = [], [], []
    for limit in GRAM_WORDS:
        end = np.searchsorted(upto, upto[:-1] + limit)  # chunks i to end[i] - 1 have `limit` words or more
        fits = np.flatnonzero((end <= n) & (end > np.arange(n) + 1))
        fits = fits[run[fits] == run[end[fits] - 1]]
        view = memoryview(np.ascontiguousarray(digest)).cast("B")
        keys.append(np.fromiter((xxhash.xxh3_64_intdigest(view[8 * i : 8 * j], seed=limit) for i, j in zip(fits.tolist(), end[fits].tolist(), strict=True)), np.uint64, len(fits)).view(np.int64))
        at.append(fits)
        ends.append(end[fits])
    at, ends = np.concatenate(at), np.concatenate(ends)
    size = start[ends - 1] + length[ends - 1] - start[at] if len(at) else at
    packed = (start[at] * _LENGTH + np.minimum(size, _LENGTH - 1)) * _WORDS + np.minimum(upto[ends] - upto[at], _WORDS - 1)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(doc[at]), pa.array(packed)], ["key", "doc", "place"])


def runs(chunked: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """Runs of chunks that an earlier document has in the same order: doc, start, size, first_doc, first_start.

    The first document that has a chunk need not have its neighbours; so the
    first document of sequences of chunks is looked for as well.
    """
    one = _shared(chunked.withColumnRenamed("digest", "key"), "chunk")
    more = _shared(grams(one.select("doc", "place", "key")), "gram")
    seeds = _seeds(one).withColumn("single", F.col("words")).unionByName(_seeds(more).withColumn("single", F.lit(0).cast("long")))
    seeds = seeds.withColumn("shift", F.col("start") - F.col("first_start")).withColumn("end", F.col("start") + F.col("length"))
    line = Window.partitionBy("doc", "first_doc", "shift").orderBy("start", "end")
    before = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    seeds = seeds.withColumn("breaks", (F.coalesce(before, F.lit(-1)) < F.col("start")).cast("int"))
    seeds = seeds.withColumn("run", F.sum("breaks").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = seeds.groupBy("doc", "first_doc", "shift", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.greatest(F.sum("single"), F.max("words")).alias("words"))
    found = grouped.where(F.col("words") >= run_words)
    found = found.select("doc", "start", (F.col("end") - F.col("start")).alias("size"), "first_doc", (F.col("start") - F.col("shift")).alias("first_start"))
    found = materialize(found, "chunk-runs")
    release(one)
    release(more)
    return found


def extend(text: bytes, at: int, size: int, left: bytes, right: bytes, begins: bool = True, ends: bool = True) -> tuple[int, int, int]:
    """The whole words in the widest match around text[at : at + size]: from, to, words.

    left and right: what stands before and after the same bytes in the other
    text. begins, ends: whether text is cut out of a longer one on neither side;
    where it is, a word at that edge is not whole.
    """
    low, high = at, at + size
    for i in range(1, min(at, len(left)) + 1):
        if text[at - i] != left[-i]:
            break
        low = at - i
    for i in range(min(len(text) - high, len(right))):
        if text[at + size + i] != right[i]:
            break
        high = at + size + i + 1
    space = b" \t\n\r\x0b\x0c"
    cut_left = text[low - 1] not in space if low else not begins
    cut_right = text[high] not in space if high < len(text) else not ends
    before, after = at - low, high - at - size  # a word that goes on in the other text is not whole either
    cut_left |= len(left) > before and left[len(left) - before - 1] not in space
    cut_right |= len(right) > after and right[after] not in space
    if cut_left:
        while low < high and text[low] not in space:
            low += 1
    if cut_right:
        while high > low and text[high - 1] not in space:
            high -= 1
    while low < high and text[low] in space:
        low += 1
    while high > low and text[high - 1] in space:
        high -= 1
    return low, high, len(text[low:high].split())


#: Multipliers of the prefix hashes of bytes and of words: odd, so that they have inverses.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _summed(values: np.ndarray, low: np.ndarray, high: np.ndarray, base: int) -> np.ndarray:
    """sum of values[low + i] * base**i up to high, modulo 2**64: equal for equal stretches wherever they stand."""
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(base, len(values)), dtype=np.uint64)))
    return (upto[high] - upto[low]) * _powers(pow(base, -1, 1 << 64), len(values) + 1)[low]


def word_windows(texts: list[bytes], n: int) -> tuple[np.ndarray, ...]:
    """Per window of n words: the text's number, the number of its first word, from, to (bytes), its sieve and its hash.

    Which white space separates the words does not matter. The sieve is the
    smallest hash of the sequences of n // 3 words in the window.
    """
    from .bagminhash import mix

    symbols = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_BASE))
    out = []
    for a, b in slices([len(t) + 1 for t in texts], CHUNK_BYTES):
        data = np.frombuffer(b"".join(x for t in texts[a:b] for x in (t, b" ")), np.uint8)
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[a:b]])))[:-1]
        word = ~_is_space(data)
        low = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])))
        high = np.flatnonzero(word[:-1] & ~word[1:]) + 1  # a space ends every text
        last = len(low) - n + 1
        if last <= 0:
            continue
        doc = np.searchsorted(begins, low, "right") - 1
        words = mix(_summed(symbols[data], low, high, BYTE_BASE) + (high - low).astype(np.uint64))
        at = np.arange(len(low))
        short = max(1, n // 3)
        some = mix(_summed(words, at[: len(at) - short + 1], at[: len(at) - short + 1] + short, WORD_BASE))
        sieve = _windowed_min(some, n - short + 1)[:last]
        whole = mix(_summed(words, at[:last], at[:last] + n, WORD_BASE))
        ok = np.flatnonzero(doc[:last] == doc[n - 1 :])
        first = np.searchsorted(low, begins)  # the first word of each text
        out.append((doc[ok] + a, ok - first[doc[ok]], low[ok] - begins[doc[ok]], high[ok + n - 1] - begins[doc[ok]], sieve[ok].view(np.int64), whole[ok].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True))


def _uncovered(low: np.ndarray, high: np.ndarray, spans: list[dict]) -> np.ndarray:
    """Which of the windows lie in none of the spans (from, to) as a whole."""
    spans = sorted((x["from"], x["to"]) for x in spans)
    start, end = (np.array(c) for c in zip(*spans, strict=True))
    at = np.searchsorted(start, low, "right") - 1
    return (at < 0) | (np.maximum.accumulate(end)[np.maximum(at, 0)] < high)


def window_spans(docs: DataFrame, spans: DataFrame, min_words: int) -> DataFrame:
    """doc, from, to, words, first_doc of all windows of min_words words that an earlier document has, besides those in spans.

    A window in a span has an earlier document, so that it is first in none and
    can be left out on both sides.
    """

    def sieves(batches):
        for batch in parts(batches, CHUNK_DOCS):
            ids = batch.column(0).to_numpy()
            doc, _, _, _, sieve, _ = word_windows(batch.column(1).to_pylist(), min_words)
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (sieve[1:] != sieve[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(sieve[new]), pa.array(ids[doc[new]] if len(doc) else doc)], ["key", "doc"])

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("bytes"))
    keys = materialize(texts.mapInArrow(sieves, "key long, doc long"), "sieve-rows")
    shared = _shared(keys, "sieve")
    release(keys)
    listed = shared.groupBy("doc").agg(F.collect_set("key").alias("keys"))
    told = spans.groupBy("doc").agg(F.collect_list(F.struct("from", "to")).alias("spans")).withColumnRenamed("doc", "d")
    listed = materialize(listed.join(told, F.col("doc") == F.col("d"), "left").drop("d"), "sieve-lists")
    release(shared)
    some = maybe_in(texts, "id", listed.select("doc")).where("_maybe").select("id", "bytes").join(listed, F.col("id") == F.col("doc"))
    some = some.dropDuplicates(["id"]).select("id", "bytes", "keys", "spans")

    def windows(batches):
        for batch in parts(batches, CHUNK_DOCS):
            ids = batch.column(0).to_numpy()
            doc, word, low, high, sieve, whole = word_windows(batch.column(1).to_pylist(), min_words)
            use = np.isin(sieve, batch.column(2).flatten().to_numpy())
            ends = np.searchsorted(doc, np.arange(len(ids) + 1))
            for i, found in enumerate(batch.column(3).to_pylist()):
                if found:
                    part = slice(ends[i], ends[i + 1])
                    use[part] &= _uncovered(low[part], high[part], found)
            cols = whole[use], ids[doc[use]] if len(doc) else doc, word[use], low[use], high[use]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "doc", "word", "from", "to"])

    rows = materialize(some.mapInArrow(windows, "key long, doc long, word long, from long, to long"), "window-rows")
    again = _shared(rows, "window").where("doc > first_doc")
    line = Window.partitionBy("doc", "first_doc").orderBy("word")
    again = again.withColumn("breaks", F.coalesce(F.col("word") - F.lag("word").over(line) > min_words, F.lit(True)).cast("int"))
    again = again.withColumn("run", F.sum("breaks").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    found = again.groupBy("doc", "first_doc", "run").agg(F.min("from").alias("from"), F.max("to").alias("to"), (F.max("word") - F.min("word") + min_words).alias("words"))
    found = materialize(found.select("doc", "from", "to", "words", "first_doc"), "window-spans")
    release(rows)
    release(listed)
    return found


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc, from, to (bytes), words, first_doc of passages that an earlier document has, word for word."""
    chunked = materialize(chunks(docs), "chunk-rows")
    found = runs(chunked, run_words)
    release(chunked)
    ids = found.select(F.explode(F.array("doc", "first_doc")).alias("id")).distinct()
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("bytes"))
    texts = maybe_in(texts, "id", ids).where("_maybe").select("id", "bytes")
    texts = materialize(texts.join(ids, "id", "left_semi").dropDuplicates(["id"]), "chunk-texts")
    part = lambda low, size: F.substring(F.col("bytes"), (low + 1).cast("int"), size.cast("int"))
    before = lambda c: F.least(F.col(c), F.lit(CONTEXT))
    own = found.join(texts, found["doc"] == texts["id"])
    own = own.select("doc", "first_doc", "start", "first_start", "size", before("start").alias("lead"), part(F.col("start") - before("start"), F.col("size") + before("start") + CONTEXT).alias("own"))
    both = own.join(texts, own["first_doc"] == texts["id"])
    both = both.select("doc", "first_doc", "start", "size", "lead", "own", part(F.col("first_start") - before("first_start"), before("first_start")).alias("left"), part(F.col("first_start") + F.col("size"), F.lit(CONTEXT)).alias("right"))

    def run(batches):
        for batch in batches:
            out = []
            for doc, first, start, size, lead, text, left, right in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                low, high, words = extend(text, lead, size, left, right, lead == start, len(text) < lead + size + CONTEXT)
                if words >= min_words:
                    out.append((doc, start - lead + low, start - lead + high, words, first))
            cols = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["doc", "from", "to", "words", "first_doc"])

    spans = both.mapInArrow(run, "doc long, from long, to long, words long, first_doc long").distinct()
    spans = materialize(spans, "chunk-run-spans")
    release(texts)
    release(found)
    return spans.unionByName(window_spans(docs, spans, min_words))


def remove(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the spans (which may overlap) and the white space behind each, and the merged spans."""
    merged: list[list[int]] = []
    for low, high in sorted(spans):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    kept, at = [], 0
    for low, high in merged:
        kept.append(text[at:low])
        while high < len(text) and text[high : high + 1].isspace():
            high += 1
        at = high
    kept.append(text[at:])
    return b"".join(kept), [tuple(m) for m in merged]


def _one_text(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows that have their doc_id's text, and those that have another one, if any (see `dedup_passages`)."""
    name = F.struct(F.xxhash64("text").alias("hash"), F.length("text").alias("length"))
    named = docs.where("doc_id is not null and text is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min(name).alias("_first"), F.max(name).alias("_last"))
    several = materialize(named.where("_first <> _last").select("_id", "_first"), "chunk-several")
    if several.isEmpty():
        return docs, None
    marked = maybe_in(docs, "doc_id", several.select("_id"))
    some = marked.where("_maybe").drop("_maybe").join(several, F.col("doc_id") == F.col("_id"), "left")
    other = F.coalesce(name != F.col("_first"), F.lit(False)) & F.col("text").isNotNull()
    own = some.where(~other).drop("_id", "_first")
    return marked.where(~F.col("_maybe")).drop("_maybe").unionByName(own), some.where(other).drop("_id", "_first")


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs, the text without repeated passages, and removed_words and spans.

    docs needs doc_id and text. Removed are passages of min_words or more that
    stand word for word in a document with a smaller doc_id; what repeats
    within one document only is left alone. spans: from, to (bytes of the old
    text) and first_doc. Null and empty texts stay as they are; rows with a
    null doc_id take no part. Rows that repeat a doc_id are one document; if
    their texts differ, its text is that with the smallest hash, and rows with
    another one take no part and stay as they are. Columns named like the
    results are replaced; an empty table gives no rows.
    """
    docs = docs.drop("removed_words", "spans")
    names = docs.columns
    docs, others = _one_text(docs)
    spans = materialize(repeated_spans(docs, min_words), "chunk-spans")
    listed = spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("from", "to", "first_doc"))).alias("_found"))
    listed = materialize(listed, "chunk-lists")
    marked = maybe_in(docs, "doc_id", listed.select("doc"))
    kind = "array<struct<from:long,to:long,first_doc:long>>"
    clean = marked.where(~F.col("_maybe")).drop("_maybe")
    clean = clean.unionByName(others) if others else clean
    clean = clean.withColumn("removed_words", F.lit(0).cast("long")).withColumn("spans", F.array().cast(kind))
    near = marked.where("_maybe").drop("_maybe").join(listed.withColumnRenamed("doc", "_doc"), F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    schema = clean.schema
    text_at = names.index("text")

    def run(batches):
        for batch in parts(batches, CHUNK_DOCS):
            texts, lost, spans_ = [], [], []
            for text, found in zip(batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if not found or text is None:
                    texts.append(text), lost.append(0), spans_.append([])
                    continue
                raw = text.encode()
                left, merged = remove(raw, [(x["from"], x["to"]) for x in found])
                first = {}
                for x in found:
                    first.setdefault(next(m for m in merged if m[0] <= x["from"] < m[1]), x["first_doc"])
                texts.append(left.decode())
                lost.append(sum(len(raw[a:b].split()) for a, b in merged))
                spans_.append([{"from": a, "to": b, "first_doc": first[a, b]} for a, b in merged])
            cols = [pa.array(texts, pa.string()) if i == text_at else batch.column(i) for i in range(len(names))]
            told = pa.array(spans_, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("first_doc", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lost, pa.int64()), told], [*names, "removed_words", "spans"])

    return clean.unionByName(near.mapInArrow(run, schema))
