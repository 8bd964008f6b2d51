"""Checks of id lists before they are handed in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SHOWN = 50


def missing_ids(ids: DataFrame, lists: DataFrame) -> DataFrame:
    """Ids of the first column that have no row in lists (V-1, J-6)."""
    return ids.select(F.col(ids.columns[0]).alias("source1_entity_id")).distinct().join(lists, "source1_entity_id", "left_anti")


def duplicate_ids(lists: DataFrame) -> DataFrame:
    """Rows whose list repeats an id (V-2, V-5)."""
    return lists.where(F.size("ids") != F.size(F.array_distinct("ids"))).select("source1_entity_id")


def unknown_ids(lists: DataFrame, known: DataFrame) -> DataFrame:
    """source1_entity_id, other_id of listed ids that no reference record has (V-3)."""
    told = lists.select("source1_entity_id", F.explode("ids").alias("other_id"))
    return told.join(known.select(F.col(known.columns[0]).alias("other_id")), "other_id", "left_anti").select("source1_entity_id", "other_id").distinct()


def not_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """source1_entity_id, other_id of matches that are not among the row's candidates (V-4)."""
    some = candidates.select("source1_entity_id", F.col("ids").alias("_candidates"))
    both = matches.join(some, "source1_entity_id", "left")
    other = F.array_except("ids", F.coalesce("_candidates", F.array().cast("array<string>")))
    return both.select("source1_entity_id", F.explode(other).alias("other_id"))


def issues(matches: DataFrame, candidates: DataFrame, ids: DataFrame, known: DataFrame, strict: bool = False) -> DataFrame:
    """check, source1_entity_id, detail: one row per violation (V-6).

    strict adds what the file format promises beyond that: one row per source-1
    id, no other source-1 ids, and only known ids among candidates.
    """
    row = lambda df, name, detail: df.select(F.lit(name).alias("check"), "source1_entity_id", detail.cast("string").alias("detail"))
    none, other = F.lit(None), F.col("other_id")
    found = [
        row(missing_ids(ids, matches), "missing from matches", none),
        row(missing_ids(ids, candidates), "missing from candidates", none),
        row(duplicate_ids(matches), "duplicate id in matches", none),
        row(unknown_ids(matches, known), "match of unknown id", other),
        row(not_candidates(matches, candidates), "match without candidate", other),
        row(duplicate_ids(candidates), "duplicate id in candidates", none),
    ]
    if strict:
        plain = ids.select(F.col(ids.columns[0]).alias("source1_entity_id")).distinct()
        for name, df in (("matches", matches), ("candidates", candidates)):
            found.append(row(df.groupBy("source1_entity_id").count().where("count > 1"), f"more than one row in {name}", none))
            found.append(row(df.join(plain, "source1_entity_id", "left_anti"), f"unknown source-1 id in {name}", none))
        found.append(row(unknown_ids(candidates, known), "candidate of unknown id", other))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def report(found: DataFrame, shown: int = MAX_SHOWN) -> tuple[int, list[str]]:
    """The number of issues and the first of them as text."""
    rows = found.orderBy("check", "source1_entity_id", "detail").limit(shown).collect()
    return found.count(), [f"{r['source1_entity_id']}: {r['check']}" + (f" ({r['detail']})" if r["detail"] else "") for r in rows]
