"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

The longest common prefix of turns is rendered once as the prompt; what follows it in either conversation is
rendered as that side's completion. The mask of a completion lists the stretches that are trained on: the
assistant's texts with their end marker. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: Turn markers. Markers inside a text or a role lose their bars, so that neither can open or close a turn.
START, END = "<|im_start|>", "<|im_end|>"
#: Identifiers in a row among which one task numbers the conversations that share a first turn.
ID_BLOCK = 1 << 12


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and turns, array<struct<role, text>> in order of turn, then role and text. A null role is a user's, a null text empty.

    A null conv_id is a conversation like others here; rows that repeat are turns that repeat. Other columns are ignored, whatever
    their names."""
    clean = lambda v: F.replace(F.replace(v, F.lit(START), F.lit("<im_start>")), F.lit(END), F.lit("<im_end>"))
    turn = F.struct(F.col(turn_col).alias("turn"), clean(F.coalesce(F.col(role_col), F.lit("user"))).alias("role"), clean(text_of(text_col)).alias("text"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), turn.alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def _piece(t: Column) -> Column:
    return F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _piece), "")


def _mask(turns: Column) -> Column:
    """array<struct<start, end>> in code points of the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        text_at = acc["at"] + F.lit(len(START) + 1) + F.length(t["role"])
        text_end = text_at + F.length(t["text"]) + F.lit(len(END))
        own = F.when(t["role"] == "assistant", F.array(F.struct(text_at.alias("start"), text_end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((text_end + 1).alias("at"), F.concat(acc["spans"], own).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, chosen, rejected: array<struct<role, text>>) with prompt_turns, prompt, chosen_text, rejected_text,
    chosen_mask, rejected_mask and usable.

    A side that is null has no turns. A pair is usable if both completions have something to train on; others
    are returned as well. Turns are equal if role and text are. Other columns of pairs are dropped.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = pairs.select("pair_id", F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", 1, shorter), F.slice("r", 1, shorter), lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(same, False)
    split = both.withColumn("prompt_turns", F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int"))
    after = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.size(c))
    split = split.select("pair_id", "prompt_turns", F.slice("c", 1, F.col("prompt_turns")).alias("p"), after("c").alias("c"), after("r").alias("r"))
    out = split.select(
        "pair_id", "prompt_turns", _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen_text"), _render(F.col("r")).alias("rejected_text"),
        _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"),
    )
    return out.withColumn("usable", (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0))


def _weakened(turns: Column) -> Column:
    """The turns up to the last one of the assistant, which gives the answer before it instead, or an empty one if there is none."""
    last = F.size(turns) - F.coalesce(F.array_position(F.transform(F.reverse(turns), lambda t: t["role"] == "assistant"), True), F.lit(0)) + 1
    before = F.slice(turns, 1, last.cast("int") - 1)
    texts = F.transform(F.filter(before, lambda t: t["role"] == "assistant"), lambda t: t["text"])
    answer = F.struct(F.lit("assistant").alias("role"), F.coalesce(F.try_element_at(texts, F.lit(-1)), F.lit("")).alias("text"))
    return F.when(F.exists(turns, lambda t: t["role"] == "assistant"), F.concat(before, F.array(answer)))


def first_turn_pairs(convs: DataFrame) -> DataFrame:
    """pair_id, chosen and rejected, made of conversations without preference labels.

    Conversations that share their first turn are paired in order of conv_id, the first of two as the chosen one. One
    without a partner is paired with itself, ending in its previous answer instead of its last one; without an answer of the
    assistant there is no rejected side. pair_id is the chosen one's conv_id. A null conv_id is in no pair, nor is a
    conversation without turns. Conversations that share a hot first turn are numbered by blocks of identifiers.
    """
    first = F.col("turns")[0]
    rows = convs.where("conv_id is not null and size(turns) > 0").select(F.col("conv_id").cast("long").alias("conv_id"), "turns", F.sha2(F.concat_ws("\n", first["role"], first["text"]), 256).alias("first"))
    rows = rows.withColumn("block", F.floor(F.col("conv_id") / ID_BLOCK))
    counts = rows.groupBy("first", "block").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("first").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.select("first", "block", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("first", "block").orderBy("conv_id"))
    numbered = rows.withColumn("k", within).join(before, ["first", "block"]).withColumn("k", F.col("before") + F.col("k") - 1)
    side = lambda k: F.first(F.when(F.col("k") % 2 == k, F.struct("conv_id", "turns")), True)
    pairs = numbered.groupBy("first", F.floor(F.col("k") / 2).alias("pair")).agg(side(0).alias("c"), side(1).alias("r"))
    return pairs.select(F.col("c.conv_id").alias("pair_id"), F.col("c.turns").alias("chosen"), F.when(F.col("r").isNotNull(), F.col("r.turns")).otherwise(_weakened(F.col("c.turns"))).alias("rejected"))


def mask_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
