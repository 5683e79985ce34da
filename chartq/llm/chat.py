"""Chat formatting by multi-party perspective rotation, in DataFrame functions.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant,
the others as named users, and a mask over what the assistant says (text and end marker), the part to
train on. System turns stay system turns in every rendering; `system` is not a participant.

A long conversation is cut into segments of `SEGMENT_TURNS` consecutive turns, each rendered by itself, so that no
row and no task holds a conversation of unbounded length; turn positions come from the skew-safe ranking, and the
turns of a segment meet the participants of their conversation in an ordinary join.

Edge cases: turns are ordered by turn (nulls first), role, text, so ties and repeated rows have a fixed order; a null
role is the participant `unknown`; a null text is empty; rows with a null conv_id are one conversation; a
conversation of system turns only has no participant and no row; names keep letters, digits, `_` and `-`, all else
becomes `_`; turn markers inside a text are broken up; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartq.operators.ranking import rank_in_group

SEGMENT_TURNS = 512
START, END = "<|im_start|>", "<|im_end|>"


def _name(role: Column) -> Column:
    return F.regexp_replace(role, "[^A-Za-z0-9_-]", "_")


def perspectives(turns: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """One row per (conv_id, segment, participant): n_turns, n_own, `rendered`, and `mask`, the code point
    ranges [start, end) of `rendered` to train on."""
    rows = turns.select("conv_id", F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
                        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|im_"), F.lit("<| im_")).alias("said"))
    placed = rank_in_group(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "said"], out="pos")
    segments = (placed.groupBy("conv_id", F.floor(F.col("pos") / segment_turns).cast("long").alias("segment"))
                .agg(F.array_sort(F.collect_list(F.struct("pos", "role", "said"))).alias("turns")))
    who = rows.where("role <> 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("participant")).distinct()
    met = segments.join(who, segments.conv_id.eqNullSafe(who.c))
    me = F.col("participant")

    def piece(t):
        own = t["role"] == me
        head = F.when(own, F.lit(START + "assistant\n")).when(t["role"] == "system", F.lit(START + "system\n")).otherwise(
            F.concat(F.lit(START + "user name="), _name(t["role"]), F.lit("\n")))
        return F.struct(own.alias("own"), head.alias("head"), F.concat(t["said"], F.lit(END)).alias("body"))

    def step(acc, p):
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        one = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + 1).cast("long").alias("at"), F.when(p["own"], F.concat(acc["mask"], one)).otherwise(acc["mask"]).alias("mask"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))
    pieces = met.select("conv_id", "segment", "participant", F.transform("turns", piece).alias("pieces"))
    return pieces.select(
        "conv_id", "segment", "participant", F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("pieces", zero, step, lambda acc: acc["mask"]).alias("mask"))
