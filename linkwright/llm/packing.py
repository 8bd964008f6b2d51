"""Best-fit packing of token sequences (operator 1).

Bounded-space online best-fit: a packer holds at most OPEN_BINS open
sequences. They stand in stacks by free space, and one integer serves as a
bitset of the stacks that are not empty, so that the tightest open sequence a
piece fits is one shift and one lowest-bit test away. If none fits and all
bins are open, the fullest closes first.

Spark's part: one pass over the texts makes ids and pieces (the texts and ids
never move), and only five numbers per piece are shuffled to packing groups of
about GROUP_DOCS documents each, by a hash of the whole row and its number
among equal rows, so that no document, source or copy can make a group hot. A group's task streams its
pieces: its memory is the open bins and a buffer of LOOKAHEAD arrivals.
"""

from __future__ import annotations

import zlib
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered

MAX_TOKENS = 2048
#: Open sequences a packer holds.
OPEN_BINS = 4096
#: Arrivals that a packer sorts by length before it places them.
LOOKAHEAD = 4096
#: Documents per packing group: the loss by unfilled last sequences is some
#: hundred sequences in about a hundred thousand.
GROUP_DOCS = 200_000
SPECIAL = "<|endoftext|>"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_files(vocabulary: str | None = None, ranks: str | None = None) -> tuple[str, str]:
    """Paths of the vocabulary and of the same vocabulary as ranks."""
    if vocabulary is None or ranks is None:
        import public_tokenizers

        vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return vocabulary, ranks


@cache
def encoder(vocabulary: str | None = None, ranks: str | None = None):
    """A function text -> unsigned 32-bit ids.

    Ids are those of the `tokenizers` vocabulary file. The ranks file holds
    the same merges for a faster library, which a test holds against the first
    for every code point; texts with a special token's string go to the first,
    and so do those whose runs of white space exceed the faster one's stack.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    vocabulary, ranks = tokenizer_files(vocabulary, ranks)
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    exact: list[Tokenizer] = []  # loaded when a text asks for it

    def encode(text: str) -> np.ndarray:
        if SPECIAL not in text:
            try:
                return fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # a run of some 100,000 white spaces or more
                pass
        if not exact:
            exact.append(Tokenizer.from_file(vocabulary))
        return np.array(exact[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut(n_ids: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all have `limit` ids but the first."""
    first = n_ids % limit or min(n_ids, limit)
    return [(0, first)] + [(at, limit) for at in range(first, n_ids, limit)]


def to_pieces(docs: DataFrame, limit: int = MAX_TOKENS, end_id: int = 0, vocabulary=None, ranks=None) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32."""

    def pieces(batches):
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out: list[tuple] = []
            for doc_id, text in zip(ids, texts, strict=True):
                found = encode(text.as_py() or "")
                tokens = np.append(found, np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(tokens), limit)):
                    out.append((doc_id, k, start, length, zlib.crc32(tokens[start : start + length].tobytes())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES)


class Packer:
    """Bounded-space best-fit over arrivals, one call of `place` for each."""

    def __init__(self, capacity: int = MAX_TOKENS, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0  # bit f: some open bin has f places free
        self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        found = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin's number and the offset in it."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} does not fit {self.capacity}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, found = self.capacity, self.n_bins
            self.n_bins += 1
        left = free - length
        if left:
            self.stacks[left].append(found)
            self.bits |= 1 << left
            self.n_open += 1
        return found, self.capacity - free


def _streamed(batches):
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _grouped(rows):
    """(group, iterator of its rows) for rows that come sorted by their first field."""
    from itertools import groupby

    return groupby(rows, key=lambda r: r[0])


def pack_pieces(pieces: DataFrame, n_docs: int, limit: int = MAX_TOKENS, open_bins: int = OPEN_BINS, lookahead: int = LOOKAHEAD, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Add sequence_id and offset. A group's sequences are numbered from group * 2**40."""
    groups = max(1, -(-n_docs // group_docs))
    mix = F.xxhash64("doc_id", "piece", "ids_crc32", "length", "_nth")
    keyed = numbered(pieces, "pack-pieces").select(F.pmod(mix, F.lit(groups)).alias("grp"), "doc_id", "piece", "start", "length", "ids_crc32", "_nth")
    order = [F.xxhash64("ids_crc32", "doc_id", "piece", "length", "_nth"), "doc_id", "piece", "length", "ids_crc32", "_nth"]

    def packed(batches):
        for group, rows in _grouped(_streamed(batches)):
            packer, rows = Packer(limit, open_bins), iter(rows)
            while waiting := list(islice(rows, lookahead)):
                waiting.sort(key=lambda r: -r[4])  # stable: ties stay in order of arrival
                out = [(*r[1:6], *packer.place(r[4])) for r in waiting]
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=False)), pa.array(np.array(cols[5], np.int64) + (group << 40)), pa.array(list(cols[6]), pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
                )

    return keyed.repartition("grp").sortWithinPartitions("grp", *order).mapInArrow(packed, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, limit: int = MAX_TOKENS, end_id: int = 0, open_bins: int = OPEN_BINS, vocabulary=None, ranks=None, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pack all documents into sequences of at most `limit` ids.

    docs needs doc_id and text; other columns are ignored, whatever their names.
    A null or empty text is the end id alone. A document longer than `limit` is
    cut into pieces of `limit`, the first of which may be shorter. Repeated rows
    are packed as often as they occur; a null doc_id stays null. An empty table
    gives no rows. Texts are taken whole at any length, whatever they are made of.
    """
    return pack_pieces(to_pieces(docs, limit, end_id, vocabulary, ranks), docs.count(), limit, open_bins, LOOKAHEAD, group_docs)
