"""Pairs of classes of records: what records with one key and one name have in common is worked out once.

A class holds the records of a source that share a key, their sorted name, and
the keys that tell where else a pair meets. Classes of a key meet in blocks,
all pairs of two blocks at a time in Python, so that neither pairs of records
nor pairs of classes become rows: only counts by ratio or each class's best
come out. No key is left out, however many records have it; a key with many
classes is dealt to many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity
from ..session import at_once

#: Classes per task, about.
TASK_ROWS = 32768
#: Classes of a block of source 1 and of the references.
LEFT_BLOCK, RIGHT_BLOCK = 1024, 4096
#: Rows that a task gathers, and pairs that it compares at a time.
ROWS, PAIRS = 16384, 1 << 20
#: Key types in the order in which a pair is looked for.
SEARCH = (0, 4, 1, 2, 3)
#: Steps from the floor to 100 by which pairs are told apart before they are compared.
STEPS = 64
#: Hashes come first, as they tell most rows apart in sorts; columns that follow tell all.
CLASS = ["class", "key_type", "key", "text", "seen"]
UNIT = ["key_type", "key", "left_block", "right_block"]
FOUND = "class long, key_type int, key string, text string, seen array<string>, blocks int, best array<struct<source:string,other_id:string,score:double>>"
LISTED = ["source1_entity_id", "other_id", "source", "score"]
COUNTED = "source string, common long, total long, pairs long"


def members(records: DataFrame, *columns: str) -> DataFrame:
    """One row per record and usable key: the columns, and those that name its class, where `seen` has the keys at which a pair is looked for earlier."""
    key = lambda t: F.when(F.col("keys")[t].endswith("|"), F.lit("")).otherwise(F.col("keys")[t])
    rows = records.select(*columns, similarity.sorted_tokens(F.col("name")).alias("text"), F.array(*map(key, range(len(SEARCH)))).alias("keys"))
    rows = rows.select(*columns, "text", "keys", F.posexplode("keys").alias("key_type", "key")).where("key <> ''")
    later = {t: SEARCH[SEARCH.index(t) + 1 :] for t in SEARCH}
    seen = F.array(*(F.when(F.col("key_type").isin(*later[t]), F.col("keys")[t]).otherwise(F.lit("")) if later[t] else F.lit("") for t in range(len(SEARCH))))
    rows = rows.select(*columns, "key_type", "key", "text", seen.alias("seen"))
    return rows.withColumn("class", F.xxhash64("key_type", "key", "text", "seen"))


def left_classes(source1: DataFrame) -> DataFrame:
    """CLASS, n (its records)."""
    return members(source1).groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n"))


def right_classes(reference: DataFrame, ids: int = 0) -> DataFrame:
    """source, CLASS, n, and as ids the `ids` smallest entity_ids of the class; n then counts those only."""
    if not ids:
        return members(reference, "source").groupBy(*CLASS, "source").agg(F.count(F.lit(1)).alias("n")).withColumn("ids", F.array().cast("array<string>"))
    order = Window.partitionBy(*CLASS, "source").orderBy("entity_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # the same order, so that rows are not sorted again for groups
    first = members(reference, "source", "entity_id").withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= ids)
    held = first.withColumns({"n": F.count(F.lit(1)).over(whole), "ids": F.collect_list("entity_id").over(whole)})
    return held.where("_place = 1").select("source", *CLASS, "n", "ids")


def units(left: DataFrame, right: DataFrame) -> DataFrame:
    """The classes of both sides, dealt to pairs of blocks of their key; rows of a pair of blocks are together, source 1 first."""
    key = ["key_type", "key"]
    many = lambda df, size: F.ceil(F.count(F.lit(1)) / size).cast("int").alias(df)
    sizes = left.groupBy(*key).agg(many("left_blocks", LEFT_BLOCK)).join(right.groupBy(*key).agg(many("right_blocks", RIGHT_BLOCK)).hint("merge"), key)

    def dealt(classes: DataFrame, own: str, other: str) -> DataFrame:
        rows = classes.join(sizes.hint("merge"), key).withColumn(f"{own}_block", F.pmod(F.col("class"), F.col(f"{own}_blocks")).cast("int"))
        return rows.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))

    hashed = F.col("key_type").cast("long") * (1 << 60) + F.shiftrightunsigned(F.xxhash64(*UNIT), 4)  # units of a key type stay together
    columns = [hashed.alias("unit"), *UNIT, "is_right", "source", "class", "text", "seen", "n", "ids", F.col("right_blocks").alias("blocks")]
    ones = left.withColumns({"source": F.lit(""), "ids": F.array().cast("array<string>"), "is_right": F.lit(False)})
    both = dealt(ones, "left", "right").select(columns).unionByName(dealt(right.withColumn("is_right", F.lit(True)), "right", "left").select(columns))
    rows = sum(at_once(left.count, right.count))  # a number of partitions of its own, as work grows with the product of classes and not with bytes; a task has a cost of its own
    tasks = max(rows // TASK_ROWS, 4 * left.sparkSession.sparkContext.defaultParallelism)
    return both.repartition(tasks, *UNIT).sortWithinPartitions("unit", *UNIT, "is_right").drop("unit")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units, and where units begin in them."""
    held: list[pa.RecordBatch] = []

    def begins(table: pa.Table) -> np.ndarray:
        change = np.zeros(len(table), bool)
        change[:1] = True
        for c in UNIT:
            x = table[c].combine_chunks()
            codes = (x.dictionary_encode().indices if c == "key" else x).to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= ROWS:
            table = pa.Table.from_batches(held)
            at = begins(table)
            if len(at) > 1:
                yield table.slice(0, at[-1]), at[:-1]
            held = table.slice(at[-1]).combine_chunks().to_batches()
    if sum(map(len, held)):
        table = pa.Table.from_batches(held)
        yield table, begins(table)


def _codes(strings: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = strings.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def _met(table: pa.Table, begin: np.ndarray, floor: float, k: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of classes that meet here first and reach the floor, with their common length and the sum of lengths.

    With k, pairs may be missing that cannot be among a row's k best records of
    a source: what two texts have in common is at most the characters that both
    have, so the pairs with the highest bounds are compared first, and of the
    others only those whose bound reaches the k-th best score found.
    """
    is_right = table["is_right"].combine_chunks().to_numpy(zero_copy_only=False)
    kind = table["key_type"].combine_chunks().to_numpy()
    source, sources = _codes(table["source"].combine_chunks())
    records = np.minimum(table["n"].combine_chunks().to_numpy(), max(k, 1))
    text, texts = _codes(table["text"].combine_chunks())
    length = np.array([len(t) for t in texts])[text]
    shared = similarity.Shared(texts)
    seen, known = _codes(table["seen"].combine_chunks().flatten())
    seen = seen.reshape(len(table), len(SEARCH)).astype(np.int64)
    blank = known.index("") if "" in known else -1
    seen[is_right[:, None] & (seen == blank)] = -1  # equal to none
    unit = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(table))))
    rights = np.bincount(unit, is_right, len(begin)).astype(np.int64)
    first = np.append(begin[1:], len(table)) - rights
    seen = np.asfortranarray(seen)
    lefts = np.flatnonzero(~is_right)
    count = rights[unit[lefts]]
    ends = np.cumsum(count)
    kinds = np.append(np.flatnonzero(np.diff(kind[lefts])) + 1, len(lefts))  # where the key type changes
    ratio = lambda common, total: np.where(total == 0, 100.0, 100.0 * 2 * common / np.maximum(total, 1))
    step = lambda ratio: np.clip((ratio - floor) * ((STEPS - 1) / max(100.0 - floor, 1e-9)), 0, STEPS - 1).astype(np.int64)
    at = 0
    while at < len(lefts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        end = min(end, int(kinds[np.searchsorted(kinds, at, "right")]))
        n = count[at:end]
        place = np.repeat(np.arange(end - at), n)
        a = lefts[at:end][place]
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[unit[lefts[at:end]]], n)
        at = end
        for t in SEARCH[: SEARCH.index(kind[lefts[end - 1]])]:  # a pair that shares an earlier key is made there
            keep = np.flatnonzero(seen[:, t][a] != seen[:, t][b])
            a, b, place = a[keep], b[keep], place[keep]
        total = length[a] + length[b]
        keep = np.flatnonzero(ratio(np.minimum(length[a], length[b]), total) >= floor)
        most = shared.bound(text[a[keep]], text[b[keep]])
        bound = ratio(most, total[keep])
        keep, bound = keep[bound >= floor], bound[bound >= floor]
        a, b, total, place = a[keep], b[keep], total[keep], place[keep]
        common = np.zeros(len(a), np.int64)
        todo = np.ones(len(a), bool)
        if k and len(a):
            group = place * len(sources) + source[b]
            groups = int(group.max()) + 1

            def reached(some: np.ndarray, value: np.ndarray) -> np.ndarray:
                """Per group the highest step at or above which the pairs have k records; 0 if they are fewer."""
                held = np.bincount(group[some] * STEPS + step(value), records[b[some]], groups * STEPS).reshape(groups, STEPS)
                enough = np.cumsum(held[:, ::-1], axis=1)[:, ::-1] >= k
                return np.where(enough.any(axis=1), STEPS - 1 - np.argmax(enough[:, ::-1], axis=1), 0)

            steps = step(bound)
            some = np.flatnonzero(steps >= reached(np.arange(len(a)), bound)[group])
            common[some] = similarity.common_lengths(texts, text[a[some]], text[b[some]])
            todo = steps >= reached(some, ratio(common[some], total[some]))[group]
            done = np.zeros(len(a), bool)
            done[some] = True
            left = np.flatnonzero(todo & ~done)
            common[left] = similarity.common_lengths(texts, text[a[left]], text[b[left]])
        else:
            common = similarity.common_lengths(texts, text[a], text[b])
        keep = todo & (ratio(common, total) >= floor)
        yield a[keep], b[keep], common[keep], total[keep]


def _leading(groups: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Places of the first k of each group in the order, by group and order."""
    places = np.lexsort((*order[::-1], *groups[::-1]))
    new = np.ones(len(places), bool)
    new[1:] = np.logical_or.reduce([g[places[1:]] != g[places[:-1]] for g in groups])
    start = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
    return places[np.arange(len(places)) - start < k]


def best_of_classes(left: DataFrame, right: DataFrame, k: int, floor: float) -> DataFrame:
    """CLASS of source 1 and `best`: per source its k best records (score from 0 to 1, ties to the smaller id) among those that meet it at its key first.

    right holds as many ids per class as are asked for. Of pairs of classes the
    k with the best ratio and the smallest first id hold the k best records, as
    each class before another has a record before all of that one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in _units(batches):
            source, sources = _codes(table["source"].combine_chunks())
            held = table["ids"].combine_chunks()
            ids, names = _codes(held.flatten())
            rank = np.empty(len(names), np.int64)
            rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
            ids = rank[ids] if len(names) else np.zeros(0, np.int64)
            names.sort()
            size = held.value_lengths().to_numpy()
            start = np.cumsum(size) - size
            for a, b, common, total in _met(table, begin, floor, k):
                if not len(a):
                    continue
                score = np.where(total == 0, 100.0, 100.0 * 2 * common / np.maximum(total, 1)) / 100
                top = _leading((a, source[b]), (-score, ids[start[b]]), k)
                a, b, score = a[top], b[top], score[top]
                n = size[b]
                each = np.repeat(np.arange(len(a)), n)
                other = ids[np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[b], n)]
                a, s, score = a[each], source[b][each], score[each]
                top = _leading((a, s), (-score, other), k)
                a, s, score, other = a[top], s[top], score[top], other[top]
                rows, offsets = np.unique(a, return_index=True)
                words = lambda x, table: pa.DictionaryArray.from_arrays(pa.array(x.astype(np.int32)), pa.array(table, pa.string())).cast(pa.string())
                best = pa.StructArray.from_arrays([words(s, sources), words(other, names), pa.array(score)], ["source", "other_id", "score"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(offsets, len(a)).astype(np.int32)), best)
                some = table.select([*CLASS, "blocks"]).take(pa.array(rows)).combine_chunks()
                yield from some.append_column("best", lists).to_batches()

    return units(left, right).mapInArrow(run, FOUND)


def best_of_lists(lists: DataFrame, k: int) -> DataFrame:
    """source1_entity_id, other_id, source, score: of the rows (source1_entity_id, best as in FOUND), a pair once and the k best per id and source.

    An other_id must be of one source. Of an id whose rows go on, only its best
    so far are held.
    """

    def reduced(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        one = table["one"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        other, names = _codes(table["other_id"].combine_chunks())
        source, _ = _codes(table["source"].combine_chunks())
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        score = table["score"].combine_chunks().to_numpy()
        once = _leading((one, rank[other]), (-score,), 1)
        best = once[_leading((one[once], source[once]), (-score[once], rank[other[once]]), k)]
        return table.take(pa.array(best)), one[best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, rows, rest = [], 0, None
        for batch in batches:
            best = batch.column("best")
            each = best.flatten()
            parents = pa.array(np.repeat(np.arange(len(batch)), best.value_lengths().to_numpy()))
            new.append(pa.table([batch.column("source1_entity_id").take(parents), each.field("other_id"), each.field("source"), each.field("score")], ["one", "other_id", "source", "score"]))
            rows += len(batch)
            if rows >= ROWS:
                table, one = reduced(pa.concat_tables(([rest] if rest else []) + new).combine_chunks())
                at = int(np.searchsorted(one, one[-1])) if len(one) else 0
                yield from table.slice(0, at).rename_columns(LISTED).to_batches()
                new, rows, rest = [], 0, table.slice(at)
        if new or rest:
            yield from reduced(pa.concat_tables(([rest] if rest else []) + new).combine_chunks())[0].rename_columns(LISTED).to_batches()

    together = lists.select("source1_entity_id", "best").repartition("source1_entity_id").sortWithinPartitions("source1_entity_id")
    return together.mapInArrow(run, "source1_entity_id string, other_id string, source string, score double")


def counts_by_ratio(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """Per source, common length and sum of lengths: the pairs of records that share a key and reach the floor, each counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in _units(batches):
            source, sources = _codes(table["source"].combine_chunks())
            n = table["n"].combine_chunks().to_numpy()
            for a, b, common, total in _met(table, begin, floor):
                if not len(a):
                    continue
                width = int(total.max()) + 1
                found, at = np.unique((source[b].astype(np.int64) * width + common) * width + total, return_inverse=True)
                pairs = np.zeros(len(found), np.int64)
                np.add.at(pairs, at, n[a] * n[b])
                yield pa.RecordBatch.from_arrays([pa.array([sources[i] for i in found // width // width]), pa.array(found // width % width), pa.array(found % width), pa.array(pairs)], ["source", "common", "total", "pairs"])

    found = units(left, right).mapInArrow(run, COUNTED)
    return found.groupBy("source", "common", "total").agg(F.sum("pairs").alias("pairs"))
