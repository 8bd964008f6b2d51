"""Quality rules by distribution divergence (operator 5, native).

Two histograms of a document are compared with those of its language over the
whole corpus, by the Jensen-Shannon distance (base 2, so 0 to 1): classes of
characters, and the language's most common short words with all others as one
class. A document far from its language in either is rejected; below a minimum
length a histogram says too little and is not judged. Simple base rules
(too short, too repetitive) come first.

All of it is Catalyst expressions on one row: texts are never shuffled. The
texts are read twice: once to count short words by language, pre-aggregated in
each task, once to measure the documents. The measures are a small table, from
which come the languages' character classes and then the verdicts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize

#: Character classes by pattern; what is left of a text's characters are other letters and marks.
CLASSES = {
    "upper": r"\p{Lu}",
    "digit": r"\p{Nd}",
    "stop": r"[.,;:?'\"()\-]",
    "symbol": r"[^\p{L}\p{M}\p{Nd}\x20\x09-\x0D.,;:?'\"()\-]",
}
SYMBOLS = r"[#*$%&|<>]"
#: Common words of a language that make up its histogram, and how long they are at most.
N_COMMON, COMMON_LENGTH = 24, 6
#: Bits for a window's number in a sort key; texts of more words take a slower way.
POSITION = 24
MIN_WORDS = 50
#: A repeated 3-word window covers at most this share of the words.
MAX_REPEATED = 0.5
#: Characters and words under which a histogram is not judged.
MIN_JUDGED_CHARS, MIN_JUDGED_WORDS = 200, 120
#: Largest distances of a document that is kept, beyond the distance that chance alone gives (see `tolerated`).
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.2


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is not inlined as a column's expression is."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(starts: Column) -> Column:
    """How many words the 3-word windows that begin at the sorted `starts` cover."""
    covered = let(starts, lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))))
    return F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)


def _neighbours(ordered: Column, same) -> Column:
    """The elements of a sorted array that are the same as one beside them."""
    return F.filter(ordered, lambda x, k: F.coalesce(same(x, F.get(ordered, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(ordered, k + 1)), F.lit(False)))


def repeated_words(windows: Column, ordered: Column) -> Column:
    """How many words stand in 3-word windows that occur twice or more.

    windows: a hash per window. ordered: the upper bits of the hashes with the
    window's number in the lower POSITION bits, sorted, so that equal windows
    are neighbours. Where that cannot tell (numbers with more bits, or different
    hashes with equal upper bits), whole hashes are sorted with their numbers.
    """
    low = F.lit((1 << POSITION) - 1).cast("long")
    number = lambda x: x.bitwiseAND(low).cast("int")
    upper = lambda x, y: F.shiftright(x, POSITION) == F.shiftright(y, POSITION)
    whole = lambda x, y: F.get(windows, number(x)) == F.get(windows, number(y))
    again = _neighbours(ordered, upper)
    mixed = F.exists(F.sequence(F.lit(1), F.size(ordered) - 1), lambda k: upper(F.get(ordered, k), F.get(ordered, k - 1)) & ~whole(F.get(ordered, k), F.get(ordered, k - 1)))
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    exact = let(pairs, lambda p: F.sort_array(F.transform(_neighbours(p, lambda x, y: x["h"] == y["h"]), lambda x: x["i"])))
    return F.when((F.size(windows) > (1 << POSITION)) | mixed, _covered(exact)).otherwise(_covered(F.sort_array(F.transform(again, number))))


def with_measures(docs: DataFrame) -> DataFrame:
    """docs with _words and the measures of the base rules and classes of characters.

    Every column that a later one uses more than once is a step of its own:
    Catalyst keeps such steps apart, so nothing is computed twice, and what a
    lambda looks up is a column that exists.
    """
    text = F.col("_text")
    docs = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("_parts", F.split(text, r"[\x20\x09-\x0D]", -1))
    docs = docs.withColumn("_words", F.filter("_parts", lambda w: w != ""))
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    docs = docs.withColumn("_hashes", hashes).withColumn("_n", F.size("_words"))
    window = lambda i: F.xxhash64(F.get("_hashes", i), F.get("_hashes", i + 1), F.get("_hashes", i + 2))
    places = F.when(F.col("_n") >= 3, F.sequence(F.lit(0), F.col("_n") - 3)).otherwise(F.array().cast("array<int>"))
    docs = docs.withColumn("_windows", F.transform(places, window))
    keyed = F.transform("_windows", lambda h, i: F.shiftleft(F.shiftright(h, POSITION), POSITION) + i)
    docs = docs.withColumn("_ordered", F.sort_array(keyed))
    repeated = F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0).cast("long")).otherwise(repeated_words(F.col("_windows"), F.col("_ordered")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        "*",
        F.col("_n").cast("long").alias("n_words"),
        (F.length(text) - F.size("_parts") + 1).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        *(F.regexp_count(text, F.lit(p)).cast("long").alias(f"_{name}") for name, p in CLASSES.items()),
    )


def _class_counts() -> Column:
    """Counts by class: those with patterns, then letters."""
    some = [F.col(f"_{name}") for name in CLASSES]
    letters = F.col("word_chars") - sum(some[1:], some[0])
    return F.array(*some, letters)


def js_distance(counts: str, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of the column `counts`, which sums to total, from a reference distribution; null if total is 0."""

    def part(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0))

    of = F.aggregate(F.zip_with(F.transform(counts, lambda c: c / total), reference, part), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(of / 2, F.lit(0.0))))


def tolerated(limit: float, classes: Column, n: Column) -> Column:
    """The largest distance to accept of a histogram of n items.

    n items drawn from the reference itself have a Jensen-Shannon divergence of
    about (classes - 1) / (8 n ln 2) bits from it; that much is added to the
    square of the limit.
    """
    return F.sqrt(F.lit(limit * limit) + (classes - 1) / (n * F.lit(8 * math.log(2))))


def common_counts(words: Column, common: Column, longest: Column) -> Column:
    """How often each common word occurs, and last how many words are none of them. longest: bytes of the longest common word."""
    n = F.size(words).cast("long")
    return let(
        F.filter(F.transform(F.filter(words, lambda w: F.octet_length(w) <= longest), lambda w: F.array_position(common, w)), lambda i: i > 0),
        lambda at: F.concat(F.transform(F.sequence(F.lit(1).cast("long"), F.size(common).cast("long")), lambda k: (F.size(at) - F.size(F.array_remove(at, k))).cast("long")), F.array(n - F.size(at))),
    )


def _with_total(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """df (own, by, names) as it is for named languages, and summed over all rows under the null language."""
    every = df.groupBy(*by).agg(*(F.sum(n).alias(n) for n in names)) if by else df.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    return df.where("own is not null").select("own", *by, *names).unionByName(every.withColumn("own", F.lit(None).cast("string")))


def word_references(docs: DataFrame) -> DataFrame:
    """own (null: the whole corpus), common (words), words (their shares, and last that of all others), longest (bytes)."""
    words = docs.select("own", F.explode(F.split(F.coalesce("text", F.lit("")), SPACE)).alias("word")).where("word <> ''")
    tally = words.select("own", F.when(F.length("word") <= COMMON_LENGTH, F.col("word")).alias("word")).groupBy("own", "word").agg(F.count(F.lit(1)).alias("n"))
    tally = materialize(tally.withColumn("word", F.when(F.col("word").rlike(r"^\p{L}+$"), F.col("word"))), "quality-words")
    by_word = _with_total(tally.groupBy("own", "word").agg(F.sum("n").alias("n")), ["word"], ["n"])
    total = by_word.groupBy("own").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("n"), "word"))
    top = by_word.where("word is not null").withColumn("rank", rank).where(F.col("rank") <= N_COMMON)
    top = top.groupBy("own").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top")).withColumnRenamed("own", "o")
    both = total.join(top, F.col("own").eqNullSafe(F.col("o")), "left").withColumn("top", F.coalesce("top", F.array().cast("array<struct<rank:int,word:string,n:bigint>>")))
    shares = F.transform("top", lambda x: x["n"] / F.col("total"))
    rest = F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    longest = F.coalesce(F.array_max(F.transform("top", lambda x: F.octet_length(x["word"]))), F.lit(0))
    found = both.select("own", F.transform("top", lambda x: x["word"]).alias("common"), F.concat(shares, F.array(rest)).alias("words"), longest.alias("longest"))
    return materialize(found, "quality-references")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with the measures, char_distance, word_distance, base_failed and kept.

    docs needs text and lang. A null text is one without words, a null lang is
    held against the whole corpus. Repeated rows are judged each for itself.
    Other columns are ignored; an empty table gives no rows.

    References are a row of some hundred bytes per language. Spark broadcasts
    them as long as their table is small (its own limit, which it checks), and
    joins by shuffle beyond.
    """
    carried = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    known = docs.select(*carried, "text", F.col("lang").alias("own"))
    refs = word_references(known.select("own", "text")).withColumnRenamed("own", "r")
    held = with_measures(known).join(refs, F.col("own").eqNullSafe(F.col("r")), "left")
    held = held.withColumn("_counts", common_counts(F.col("_words"), F.col("common"), F.col("longest")))
    word = F.when(F.col("n_words") >= MIN_JUDGED_WORDS, js_distance("_counts", F.col("n_words"), F.col("words")))
    names = [f"keep_{i}" for i in range(len(keep))]
    classes = [f"_{c}" for c in CLASSES]
    told = materialize(held.select(*names, "own", *MEASURES, *classes, F.size("words").alias("n_classes"), word.alias("word_distance")), "quality-measures")

    sums = _with_total(told.groupBy("own").agg(*(F.sum(c).alias(c) for c in ("word_chars", *classes))), [], ["word_chars", *classes])
    share = lambda x: F.when(F.col("word_chars") > 0, x / F.col("word_chars")).otherwise(F.lit(0.0))
    chars = materialize(sums.select(F.col("own").alias("r"), F.transform(_class_counts(), share).alias("chars")), "quality-chars")
    told = told.join(chars, F.col("own").eqNullSafe(F.col("r")), "left").withColumn("_classes", _class_counts())
    char = F.when(F.col("word_chars") >= MIN_JUDGED_CHARS, js_distance("_classes", F.col("word_chars"), F.col("chars")))
    told = told.withColumn("char_distance", char)
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(int(100 * MAX_REPEATED)) * F.col("n_words"))
    near_chars = F.col("char_distance") <= tolerated(MAX_CHAR_DISTANCE, F.size("chars"), F.col("word_chars"))
    near_words = F.col("word_distance") <= tolerated(MAX_WORD_DISTANCE, F.col("n_classes"), F.col("n_words"))
    kept = ~failed & F.coalesce(near_chars, F.lit(True)) & F.coalesce(near_words, F.lit(True))
    return told.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), *MEASURES, "char_distance", "word_distance", failed.alias("base_failed"), kept.alias("kept"))
