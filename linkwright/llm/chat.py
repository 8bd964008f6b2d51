"""Cumulative-snapshot collapse and chat formatting (operator 8, native).

A logged conversation is often stored again after every turn, so that earlier
snapshots are prefixes of later ones. Each turn has a hash of its position,
role and text; the exclusive-or of the hashes up to a turn is a rolling hash
of the conversation's prefix (two independent ones, 128 bits together). A
conversation whose whole hash is a proper prefix hash of any conversation is
dropped by an anti-join; of equal ones the smallest conv_id stays. Only what is
left is rendered.

Hashes are shuffled, not texts, until rendering; equal prefixes (a greeting
that a third of all conversations open with) are aggregated before they are
joined, so that both sides of the anti-join have each hash once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_in

TURN = "<|{role}|>\n{text}\n"
UNKNOWN_ROLE = "unknown"


def _content(seed: int):
    null = lambda c: F.col(c).isNull()  # noqa: E731  a null is not an empty text
    return F.xxhash64(F.lit(seed), null("role"), "role", null("text"), "text")


def _tied(rows: DataFrame) -> DataFrame:
    """key of the conversations in which different turns have the same number."""
    same = rows.groupBy("key", "conv_id", "turn").agg(*(f(c).alias(f"{c}_{f.__name__}") for c in ("c1", "c2") for f in (F.min, F.max)))
    return same.where("c1_min <> c1_max or c2_min <> c2_max").select("key").distinct()


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, n (position from 1), h1, h2 of the turns up to it, last.

    Turns of one number are ordered by role and text, for which only the texts
    of conversations with such turns are shuffled (and of few others, which a
    bitmap lets pass): elsewhere what ties is equal.
    """
    told = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text", F.xxhash64("conv_id").alias("key"), _content(1).alias("c1"), _content(2).alias("c2"))
    tied = materialize(_tied(told.drop("role", "text")), "chat-tied")
    rows = maybe_in(told, "key", tied).select("conv_id", "turn", "c1", "c2", *(F.when(F.col("_maybe"), F.col(c)).alias(c) for c in ("role", "text")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last(), "c1", "c2")
    rows = rows.select("conv_id", "turn", "role", "text", "c1", "c2", F.row_number().over(order).alias("n"), F.lead(F.lit(1)).over(order).isNull().alias("last"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "conv_id",
        "n",
        F.bit_xor(F.xxhash64("n", "c1")).over(upto).alias("h1"),
        F.bit_xor(F.xxhash64("n", "c2")).over(upto).alias("h2"),
        "last",
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no other one continues; of equal ones the first."""
    hashes = materialize(prefix_hashes(turns), "chat-prefixes")
    whole = hashes.where("last").groupBy("h1", "h2", "n").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    begun = hashes.where("not last").select("h1", "h2", "n").distinct()
    return whole.join(begun, ["h1", "h2", "n"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")


def format_conversations(turns: DataFrame, turn: str = TURN) -> DataFrame:
    """conv_id, n_turns, n_copies and the rendered text of every maximal conversation.

    turns needs conv_id, turn, role and text. Turns are ordered by `turn`
    (nulls first) and, where that ties, by role and text (nulls last), so that
    repeated rows are repeated turns. A null role is rendered as `unknown`, a null text as empty;
    in comparisons both differ from any value. Rows without a conv_id are left
    out. Texts are rendered whole. Other columns are ignored; an empty table
    gives no rows.
    """
    kept = materialize(maximal_conversations(turns), "chat-maximal")
    before, between, after = (turn.partition("{role}")[0], *turn.partition("{role}")[2].partition("{text}")[::2])
    null = lambda c: F.col(c).isNull().alias(f"no_{c}")
    said = turns.where("conv_id is not null").select("conv_id", F.struct("turn", null("role"), "role", null("text"), "text").alias("x"))
    texts = said.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    told = lambda x: F.concat(F.lit(before), F.coalesce(x["role"], F.lit(UNKNOWN_ROLE)), F.lit(between), F.coalesce(x["text"], F.lit("")), F.lit(after))
    texts = texts.select("conv_id", F.array_join(F.transform("x", told), "").alias("text"))
    return kept.join(texts, "conv_id").select("conv_id", "n_turns", "n_copies", "text")


#: The same in SQL, comparing whole lists of turns.
ORACLE = """
with ordered as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos
  from conversations where conv_id is not null
), whole as (
  select conv_id, count(*) as n_turns, list({'role': role, 'text': text} order by pos) as turns from ordered group by conv_id
), begun as (
  select distinct turns[1:k] as turns from (select turns, unnest(range(1, n_turns)) as k from whole)
), first as (
  select turns, n_turns, min(conv_id) as conv_id, count(*) as n_copies from whole group by turns, n_turns
)
select conv_id, n_turns, n_copies,
  array_to_string(list_transform(turns, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || chr(10)), '') as text
from first where not exists (select 1 from begun where begun.turns = first.turns)
"""
