"""String similarity: Indel ratios in Arrow batches, set and length measures as expressions.

The longest common subsequence of a batch of pairs is computed for all pairs
at a time: the shorter string of a pair becomes bit masks, one bit per place
and as many 64-bit words as that takes, and each character of the longer one
updates the pair's state. Pairs are taken together by their number of words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import let, tokens

WORD = 64
#: Window states of `partial_ratio` that are held at a time.
MAX_STATES = 400_000
#: Pairs and mask words of `common_lengths` that are held at a time.
PAIRS, MAX_MASKS = 1 << 15, 1 << 22
#: Words per text for characters and occurrences, in `Shared`.
MAX_BITS_WORDS = 16


def _codes(texts: list[str]) -> np.ndarray:
    """Code points, padded with 0: (texts, longest)."""
    if not texts:
        return np.zeros((0, 1), np.uint32)
    a = np.array(texts, dtype=np.str_)
    width = max(a.dtype.itemsize // 4, 1)
    return np.ascontiguousarray(a.astype(f"<U{width}")).view(np.uint32).reshape(len(texts), width)


def _masks(short: list[str], long: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Match masks by (pair, character number, word) and the character numbers of the long strings (0: padding)."""
    a, b = _codes(short), _codes(long)
    known, numbers = np.unique(np.concatenate(([0], a.ravel(), b.ravel())), return_inverse=True)
    a, b = numbers[1 : 1 + a.size].reshape(a.shape), numbers[1 + a.size :].reshape(b.shape)
    masks = np.zeros((len(short), len(known), -(-a.shape[1] // WORD)), np.uint64)
    rows = np.arange(len(short))
    for i in range(a.shape[1]):
        masks[rows, a[:, i], i // WORD] |= np.uint64(1 << i % WORD)
    masks[:, 0] = 0
    return masks, b


def _step(state: np.ndarray, match: np.ndarray) -> np.ndarray:
    """The next state, of (pairs, words): state + hit, carried from word to word, or state - hit."""
    hit = state & match
    total = state + hit
    if state.shape[1] > 1:
        over = total < state
        carry = over[:, 0]
        for w in range(1, state.shape[1]):
            more = total[:, w] + carry
            carry = over[:, w] | (more < total[:, w])
            total[:, w] = more
    return total | (state - hit)


def _full(sizes: np.ndarray, words: int) -> np.ndarray:
    """The lowest `size` bits of each row's words."""
    bits = np.clip(sizes[:, None] - WORD * np.arange(words)[None, :], 0, WORD).astype(np.uint64)
    return np.where(bits == WORD, ~np.uint64(0), (np.uint64(1) << (bits % np.uint64(WORD))) - np.uint64(1))


def _common(state: np.ndarray, full: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The longest common subsequence that a state tells: the bits that are 0."""
    return sizes - np.bitwise_count(state & full).sum(axis=1, dtype=np.int64)


def _alike(pairs: list[tuple[str, str]]) -> list[np.ndarray]:
    """Numbers of the pairs (shorter first) in parts of one number of words and much the same length."""
    order = sorted((i for i, (x, _) in enumerate(pairs) if x), key=lambda i: (-(-len(pairs[i][0]) // WORD), len(pairs[i][1])))
    out: list[list[int]] = []
    for i in order:
        words = -(-len(pairs[i][0]) // WORD)
        if not out or words != -(-len(pairs[out[-1][0]][0]) // WORD) or len(out[-1]) * words >= 4096:
            out.append([])
        out[-1].append(i)
    return [np.array(x) for x in out]


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    out = np.zeros(len(pairs), np.int64)
    with np.errstate(over="ignore"):
        for part in _alike(pairs):
            masks, y = _masks([pairs[i][0] for i in part], [pairs[i][1] for i in part])
            state, rows = np.full((len(part), masks.shape[2]), ~np.uint64(0)), np.arange(len(part))
            for j in range(y.shape[1]):
                state = _step(state, masks[rows, y[:, j]])
            sizes = np.array([len(pairs[i][0]) for i in part])
            out[part] = _common(state, _full(sizes, masks.shape[2]), sizes)
    return out


def common_lengths(texts: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of texts[i] and texts[j], for many pairs of few texts: masks are made once per text."""
    out = np.zeros(len(i), np.int64)
    if not len(i):
        return out
    sizes = np.array([len(t) for t in texts])
    words = -(-sizes // WORD)
    order = np.lexsort((sizes[j], words[i]))  # texts of much the same length together
    ends = np.searchsorted(words[i][order], np.arange(1, words.max() + 2))
    with np.errstate(over="ignore"):
        for w in range(1, int(words.max()) + 1):  # pairs whose first text is empty have nothing in common
            part = order[ends[w - 1] : ends[w]]
            step = max(PAIRS // w, 1)
            for at in range(0, len(part), step):
                _common_of(texts, sizes, i, j, part[at : at + step], w, out)
    return out


def _next(state: np.ndarray, match: np.ndarray) -> np.ndarray:
    """The same as `_step`, in place where states have one word and one axis."""
    if state.ndim > 1:
        return _step(state, match)
    match &= state
    total = state + match
    state -= match
    state |= total
    return state


def _numbered(texts: list[str], i: np.ndarray, j: np.ndarray, words: int, back: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """For pairs of texts[i] and texts[j], each read from its end if `back`: match masks of the distinct first texts, by text and character number,
    where in them each pair's begin, the distinct second texts as character numbers, and each pair's row there. None if the masks were too large."""
    left, a = np.unique(i, return_inverse=True)
    right, b = np.unique(j, return_inverse=True)
    x, y = (_codes([texts[t][::-1] if back else texts[t] for t in side]) for side in (left, right))
    present = np.zeros(int(max(x.max(), y.max())) + 1, bool)
    present[0] = present[x.ravel()] = present[y.ravel()] = True
    known = int(np.count_nonzero(present))
    if len(left) > 1 and len(left) * known * words > MAX_MASKS:
        return None
    number = np.cumsum(present) - 1
    x, y = number[x], number[y]
    masks = np.zeros((len(left), known, words), np.uint64)
    rows = np.arange(len(left))
    for k in range(x.shape[1]):
        masks[rows, x[:, k], k // WORD] |= np.uint64(1 << k % WORD)
    masks[:, 0] = 0
    return masks.ravel() if words == 1 else masks.reshape(-1, words), a * known, y, b


def _blank(n: int, words: int) -> np.ndarray:
    """First states, with one axis if they have one word."""
    return np.full(n if words == 1 else (n, words), ~np.uint64(0))


def _common_of(texts: list[str], sizes: np.ndarray, i: np.ndarray, j: np.ndarray, part: np.ndarray, words: int, out: np.ndarray) -> None:
    """Sets out[part]; parts whose masks would be large are halved."""
    found = _numbered(texts, i[part], j[part], words)
    if found is None:
        for half in (part[: len(part) // 2], part[len(part) // 2 :]):
            _common_of(texts, sizes, i, j, half, words, out)
        return
    masks, base, y, b = found
    state = _blank(len(part), words)
    for column in np.ascontiguousarray(y.T):
        state = _next(state, masks.take(base + column.take(b), axis=0))
    n = sizes[i[part]]
    out[part] = _common(state.reshape(len(part), words), _full(n, words), n)


class Shared:
    """How many characters two texts have in common at most, each as often as both have it: one bit per character and occurrence."""

    def __init__(self, texts: list[str]) -> None:
        letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.bits = None
        rows, used = np.repeat(np.arange(len(texts)), self.sizes), letters != 0  # the kernel takes 0 for padding
        known, letters = np.unique(letters[used], return_inverse=True)
        key = np.sort(rows[used] * max(len(known), 1) + letters)
        at = np.arange(len(key))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        nth = at - np.maximum.accumulate(np.where(new, at, 0))
        rows, letters = np.divmod(key, max(len(known), 1))
        most = np.zeros(max(len(known), 1), np.int64)
        np.maximum.at(most, letters, nth + 1)
        if most.sum() <= WORD * MAX_BITS_WORDS:  # of many different characters, lengths alone tell
            number = (np.cumsum(most) - most)[letters] + nth
            self.bits = np.zeros((max(-(-int(most.sum()) // WORD), 1), len(texts)), np.uint64)
            np.bitwise_or.at(self.bits, (number // WORD, rows), np.uint64(1) << (number % WORD).astype(np.uint64))

    def bound(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """What the longest common subsequences of texts[i] and texts[j] cannot exceed."""
        if self.bits is None:
            return np.minimum(self.sizes[i], self.sizes[j])
        out = np.zeros(len(i), np.int64)
        for word in self.bits:
            out += np.bitwise_count(word[i] & word[j])
        return out


def _distinct(a: list[str], b: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct texts, the distinct pairs as numbers of texts, and each pair's place among those."""
    number: dict[str, int] = {}
    i, j = (np.array([number.setdefault(t, len(number)) for t in side], np.int64) for side in (a, b))
    texts = list(number)
    pairs, at = np.unique(i * max(len(texts), 1) + j, return_inverse=True)
    return texts, *np.divmod(pairs, max(len(texts), 1)), at


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """2 LCS / (both lengths) * 100; 100 if both are empty. Equal pairs are compared once."""
    texts, i, j, at = _distinct(a, b)
    size = np.array([len(t) for t in texts], np.int64)
    total = size[i] + size[j]
    swap = size[i] > size[j]
    common = common_lengths(texts, np.where(swap, j, i), np.where(swap, i, j))
    return np.where(total == 0, 100.0, 100.0 * 2 * common / np.maximum(total, 1))[at]


def _best_part(texts: list[str], size: np.ndarray, i: np.ndarray, j: np.ndarray, words: int) -> np.ndarray:
    """The best ratio of texts[i] with the windows of texts[j] that are as long, or shorter at either end; sizes of texts[i] descend."""
    found = [_numbered(texts, i, j, words, back) for back in (False, True)]
    if None in found:
        half = len(i) // 2
        return np.concatenate([_best_part(texts, size, i[:half], j[:half], words), _best_part(texts, size, i[half:], j[half:], words)])
    sizes, full = size[i], _full(size[i], words)
    masks, base, y, b = found[0]
    count = size[j] - sizes + 1
    pair = np.repeat(np.arange(len(i)), count)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + (b * y.shape[1])[pair]
    state, begin, letters = _blank(len(pair), words), base[pair], y.ravel()
    active = lambda sizes, j: int(np.searchsorted(-sizes, -j, "left"))  # noqa: E731 - those that are longer than j
    for k in range(int(sizes[0])):
        n = active(sizes[pair], k)
        state[:n] = _next(state[:n], masks.take(begin[:n] + letters.take(at[:n] + k), axis=0))
    common = _common(state.reshape(-1, words), full[pair], sizes[pair])
    best = 200.0 * np.maximum.reduceat(common, np.cumsum(count) - count) / (2 * sizes)
    for masks, base, y, b in found:  # one pass tells all beginnings, and one of the reversed texts all ends
        state = _blank(len(i), words)
        least = int((best * sizes / (200.0 - best)).min())  # shorter ones cannot be better: at most all of them is common
        for k, column in enumerate(np.ascontiguousarray(y.T)[: int(sizes[0]) - 1], 1):
            n = active(sizes, k)
            state[:n] = _next(state[:n], masks.take(base[:n] + column.take(b[:n]), axis=0))
            if k >= least:
                common = _common(state[:n].reshape(-1, words), full[:n], sizes[:n])
                best[:n] = np.maximum(best[:n], 200.0 * common / (sizes[:n] + k))
    return best


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The best Indel ratio of the shorter string with a window of the longer; both ways if equally long.

    Windows are as long as the shorter string, or shorter at the longer one's
    ends: these are beginnings, and beginnings of the reversed strings. Equal
    pairs are compared once.
    """
    texts, i, j, place = _distinct(a, b)
    size = np.array([len(t) for t in texts], np.int64)
    out = np.where(i == j, 100.0, 0.0)
    todo = np.flatnonzero((i != j) & (np.minimum(size[i], size[j]) > 0))
    swap = size[i] > size[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    within = np.array([texts[s] in texts[l] for s, l in zip(i[todo].tolist(), j[todo].tolist(), strict=True)], bool)
    out[todo[within]] = 100.0
    todo = todo[~within]
    both = todo[size[i[todo]] == size[j[todo]]]
    pair, short, long = np.concatenate((todo, both)), np.concatenate((i[todo], j[both])), np.concatenate((j[todo], i[both]))
    words = -(-size[short] // WORD)
    order = np.lexsort((-size[long], -size[short], words))
    pair, short, long, words = pair[order], short[order], long[order], words[order]
    states = np.cumsum(words * (size[short] + size[long]))
    at = 0
    with np.errstate(over="ignore"):
        while at < len(pair):
            end = int(np.searchsorted(states, (states[at - 1] if at else 0) + MAX_STATES, "right"))
            end = min(max(end, at + 1), int(np.searchsorted(words, words[at], "right")))
            np.maximum.at(out, pair[at:end], _best_part(texts, size, short[at:end], long[at:end], int(words[at])))
            at = end
    return out[place]


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(indel_ratios(a.tolist(), b.tolist()))


def token_jaccards(a: list[str], b: list[str]) -> np.ndarray:
    """Jaccard similarity of the texts' sets of tokens; 1 if both are empty. A text is taken apart once, equal pairs are compared once."""
    texts, i, j, at = _distinct(a, b)
    sets = [frozenset(t.split(" ")) - {""} for t in texts]
    number: dict[str, int] = {}
    held = np.array([number.setdefault(w, len(number)) for s in sets for w in s], np.int64)
    size = np.array([len(s) for s in sets], np.int64)
    known = np.sort(np.repeat(np.arange(len(texts)), size) * len(number) + held)  # which text has which token
    n = size[i]
    pair = np.repeat(np.arange(len(i)), n)
    asked = j[pair] * len(number) + held[np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat((np.cumsum(size) - size)[i], n)]
    found = np.append(known, -1)[np.searchsorted(known, asked)] == asked
    both = np.bincount(pair[found], minlength=len(i))
    any_ = n + size[j] - both
    return np.where(any_ == 0, 1.0, both / np.maximum(any_, 1))[at]


@F.pandas_udf(DoubleType())
def pair_jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same as `token_jaccard`, in Arrow batches: for many pairs of few texts."""
    return pd.Series(token_jaccards(a.tolist(), b.tolist()))


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(partial_ratios(a.tolist(), b.tolist()))


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.sort_array(tokens(c)), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Indel ratio of the texts with their tokens sorted, 0 to 100 (F-1, F-2, F-6)."""
    return indel_ratio(sorted_tokens(a), sorted_tokens(b))


def indel_bound(a: Column, b: Column) -> Column:
    """What the ratio cannot exceed, from lengths alone: a filter before the kernel."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * F.least(F.length(a), F.length(b)) / total)


def native_indel_ratio(a: Column, b: Column) -> Column:
    """The same as expressions only, for pairs whose shorter text has 62 characters at most; else null."""

    def of(short: Column, long: Column) -> Column:
        n = F.length(short)
        places = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring(short, i, F.lit(1)).alias("c"), F.pow(F.lit(2.0), i - 1).cast("long").alias("bit")))
        letters = F.array_distinct(F.transform(places, lambda p: p["c"]))
        mask = lambda c: F.aggregate(places, F.lit(0).cast("long"), lambda m, p: F.when(p["c"] == c, m + p["bit"]).otherwise(m))
        masks = F.map_from_arrays(letters, F.transform(letters, mask))
        full = F.pow(F.lit(2.0), n).cast("long") - 1

        def lcs(m: Column) -> Column:
            chars = F.transform(F.sequence(F.lit(1), F.length(long)), lambda i: F.substring(long, i, F.lit(1)))

            def step(s: Column, c: Column) -> Column:
                hit = s.bitwiseAND(F.coalesce(F.try_element_at(m, c), F.lit(0).cast("long")))
                return (s + hit).bitwiseOR(s - hit).bitwiseAND(full)

            return n - F.bit_count(F.aggregate(chars, full, step))

        return F.lit(200.0) * let(masks, lcs) / (n + F.length(long))

    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    empty = F.length(short) == 0
    both = F.length(long) == 0
    return F.when(both, F.lit(100.0)).when(empty, F.lit(0.0)).when(F.length(short) <= 62, let(F.struct(short.alias("s"), long.alias("l")), lambda x: of(x["s"], x["l"])))


def set_jaccard(x: Column, y: Column, distinct: bool = False) -> Column:
    """Jaccard similarity of two arrays as sets; 1 if both are empty, 0 if one is. Of `distinct` ones the union is not made."""
    both = F.size(F.array_intersect(x, y))
    any_ = F.size(x) + F.size(y) - both if distinct else F.size(F.array_union(x, y))
    return F.when(any_ == 0, F.lit(1.0)).otherwise(both / any_)


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of token sets (F-4, F-8)."""
    return set_jaccard(tokens(a), tokens(b))


def length_difference(a: Column, b: Column) -> Column:
    """Absolute difference in characters (F-5, F-9)."""
    return F.abs(F.length(a) - F.length(b)).cast("double")


def country_match(a: Column, b: Column) -> Column:
    """1 if equal and not empty (F-10)."""
    return ((a == b) & (a != "")).cast("double")
