"""Preference pairs: one rendered prompt and two completions with masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import let

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order as array<struct<turn, role, text>>.

    A turn that is there more than once counts once, by the smallest role and text; null roles and
    texts are empty; turns without conv_id or number are no part of a conversation.
    """
    one = turns.where("conv_id is not null and turn is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")).agg(F.min(F.struct(F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))).alias("t"))
    return one.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "t.role", "t.text"))).alias("turns"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def _spans(turns: Column) -> Column:
    """Character spans of a rendering that are learned: what assistants say, with the closing mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["role"]) + len(OPEN) + 1
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Format each pair (pair_id, chosen_id, rejected_id) of conversations.

    The longest common prefix of turns (role and text equal) is rendered once as `prompt`; what
    follows in either conversation is its completion, with the spans of it that count in the loss.
    Equal conversations give two empty completions; a missing or null conversation has no turns.
    Turns are taken whole, whatever their length; an empty table gives no pairs.
    Conversations are assembled by their own id and a pair holds two of them, so a text or
    opening that is common to many conversations brings no rows together.
    """
    convs = conversations(turns)
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    out = pairs.select("pair_id", "chosen_id", "rejected_id")
    for side in ("chosen", "rejected"):
        out = out.join(convs.select(F.col("conv_id").alias(f"{side}_id"), F.col("turns").alias(f"{side}_turns")), f"{side}_id", "left").withColumn(f"{side}_turns", F.coalesce(f"{side}_turns", none))
    equal = F.zip_with("chosen_turns", "rejected_turns", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(equal, False)
    out = out.withColumn("n_prompt_turns", F.when(first == 0, F.size(equal)).otherwise(first - 1).cast("int"))
    for side in ("chosen", "rejected"):
        out = out.withColumn(f"{side}_rest", F.slice(f"{side}_turns", F.col("n_prompt_turns") + 1, F.greatest(F.size(f"{side}_turns"), F.lit(1))))
    return out.select(
        "pair_id", "chosen_id", "rejected_id", "n_prompt_turns",
        _render(F.slice("chosen_turns", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        _render(F.col("chosen_rest")).alias("chosen"), _spans(F.col("chosen_rest")).alias("chosen_spans"),
        _render(F.col("rejected_rest")).alias("rejected"), _spans(F.col("rejected_rest")).alias("rejected_spans"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pair conversation 2k (chosen) with 2k + 1 (rejected); pair_id is k.

    The table holds no judgements, so neighbours by id stand in; an id without its neighbour
    is paired with an empty conversation.
    """
    ids = turns.where("conv_id is not null and turn is not null").select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id")).distinct()
    return ids.select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))
