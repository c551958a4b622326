"""Preference formatting of chat pairs, with DataFrame functions only.

For each pair of a chosen and a rejected conversation, the turns before the first one in
which the two differ are their longest common prefix: it is rendered once, as prompt. The
turns from there on are the two completions; only what the assistant says in them is
learnt from (learn), all else is masked. The result has a row per turn, in long form, so
that a conversation of any length is never gathered in one task; `examples` joins the
turns of ordinary conversations into one row per pair.

A turn is what stands under one turn number: where several different rows share a number
they are one turn of several messages, ordered by role and text. A message that is said
several times at a turn is one row with that number of `copies`; sides that say it
differently often part there.
Null text or role is empty, a null turn number comes before all others, and rows without a
conversation id form conversation -1. A conversation without a counterpart has no common
prefix, its turns are one completion and `paired` is false. Two equal conversations are
all prompt. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import cut

LEARNT_ROLE = "assistant"


def rendered():
    """One message in the markup of the chat template."""
    return F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n"))


def neighbours(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Pairs for a table that names none: conversations 2k and 2k + 1, the even one chosen."""
    conv = F.coalesce(F.col(id_col), F.lit(-1)).cast("bigint")
    return conversations.select("turn", "role", "text", F.floor(conv / 2).cast("bigint").alias("pair_id"), (F.pmod(conv, F.lit(2)) == 0).alias("is_chosen"))


def segments(turns: DataFrame) -> DataFrame:
    """turns: (pair_id, is_chosen, turn, role, text), a row per message. Result: (pair_id,
    part, turn, role, rendered, copies, learn, paired), part being prompt, chosen or
    rejected."""
    rows = turns.select("pair_id", "is_chosen", F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)).alias("turn"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    # A message that both sides have at a turn is one row with both counts.
    count = lambda said: F.sum(F.when(said, 1).otherwise(0)).cast("bigint")
    sides = cut(rows.groupBy("pair_id", "turn", "role", "text").agg(count(F.col("is_chosen")).alias("chosen"), count(~F.col("is_chosen")).alias("rejected")))
    differs = F.col("chosen") != F.col("rejected")
    first = cut(sides.groupBy("pair_id").agg(F.min(F.when(differs, F.col("turn"))).alias("parting"), ((F.max("chosen") > 0) & (F.max("rejected") > 0)).alias("paired")))
    placed = sides.join(first, "pair_id").withColumn("common", F.col("parting").isNull() | (F.col("turn") < F.col("parting")))
    part = F.explode(F.expr("CASE WHEN common THEN array('prompt') ELSE array_compact(array(CASE WHEN chosen > 0 THEN 'chosen' END, CASE WHEN rejected > 0 THEN 'rejected' END)) END"))
    placed = placed.withColumn("part", part)
    copies = F.when(F.col("part") == "rejected", F.col("rejected")).otherwise(F.col("chosen"))
    return placed.select("pair_id", "part", "turn", "role", rendered().alias("rendered"), copies.alias("copies"), (~F.col("common") & (F.col("role") == LEARNT_ROLE)).alias("learn"), "paired")


def examples(turns: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen, rejected, and the learnt parts of each completion
    as (text, learn) pieces. For conversations that fit a row."""
    pieces = F.sort_array(F.collect_list(F.struct("turn", "role", F.expr("repeat(rendered, cast(copies AS int))").alias("rendered"), "learn")))
    parts = segments(turns).groupBy("pair_id", "part").agg(pieces.alias("p"))
    return parts.groupBy("pair_id").agg(
        *(F.max(F.when(F.col("part") == part, F.expr("array_join(transform(p, x -> x.rendered), '')"))).alias(part) for part in ("prompt", "chosen", "rejected")),
        *(F.max(F.when(F.col("part") == part, F.expr("transform(p, x -> struct(x.rendered AS text, x.learn AS learn))"))).alias(f"{part}_mask") for part in ("chosen", "rejected")),
    )


ORACLE = """
WITH rows AS (
    SELECT CAST(floor(coalesce(conv_id, -1) / 2.0) AS BIGINT) AS pair_id, coalesce(conv_id, -1) % 2 = 0 AS is_chosen,
           coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations),
sides AS (
    SELECT pair_id, turn, role, text, count(*) FILTER (WHERE is_chosen) AS chosen, count(*) FILTER (WHERE NOT is_chosen) AS rejected FROM rows GROUP BY ALL),
first AS (
    SELECT pair_id, min(turn) FILTER (WHERE chosen <> rejected) AS parting, max(chosen) > 0 AND max(rejected) > 0 AS paired
    FROM sides GROUP BY pair_id),
placed AS (
    SELECT s.*, f.paired, coalesce(s.turn < f.parting, true) AS common FROM sides s JOIN first f USING (pair_id)),
parts AS (
    SELECT *, 'prompt' AS part, chosen AS copies FROM placed WHERE common
    UNION ALL SELECT *, 'chosen', chosen FROM placed WHERE NOT common AND chosen > 0
    UNION ALL SELECT *, 'rejected', rejected FROM placed WHERE NOT common AND rejected > 0)
SELECT pair_id, part, turn, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered, copies,
       NOT common AND role = 'assistant' AS learn, paired
FROM parts
"""
