"""Preference formatting of chat pairs: the shared prompt once, and two masked completions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh

# The markers of the rendered form.
HEAD_OPEN, HEAD_CLOSE, TURN_END = "<|", "|>\n", "<|end|>\n"


def conversations_as_rows(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``id_col, turns``: a conversation's turns ordered by (turn, role, text), nulls first; null role reads ``user``, null
    text is empty.  A conversation is one training record, so it is gathered in one row; rows with a null id are no
    conversation and are left out."""
    turn = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(HEAD_OPEN), t["role"], F.lit(HEAD_CLOSE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(TURN_END))), "")


def _spans(turns: Column) -> Column:
    """Character spans (start, length) that a loss may use: what the assistant says and the end marker after it."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc, t):
        head, body = F.length(_head(t)), F.length(t["text"]) + len(TURN_END)
        span = F.array(F.struct((acc["at"] + head).alias("start"), body.alias("length")))
        return F.struct((acc["at"] + head + body).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, begin, step)["spans"]


def preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` (two arrays of ``struct<turn, role, text>``) with the columns of one preference record:

    ``prompt_turns`` (length of the longest common prefix of turns, equal in role and text), ``prompt`` (those turns rendered
    once), and for both sides the rendered rest and its trained spans: ``chosen_completion``, ``chosen_mask``,
    ``rejected_completion``, ``rejected_mask`` (start and length in characters of the completion).  User and system turns
    of a completion and all role markers are masked out.

    Two equal conversations give empty completions; nothing in common gives an empty prompt.  A null side counts as
    without turns.  Columns of these names are replaced, others pass through.
    """
    results = ("prompt_turns", "prompt", "chosen_completion", "chosen_mask", "rejected_completion", "rejected_mask")
    kept = [c for c in pairs.columns if c.lower() not in results]
    ct, rt = fresh(pairs, "_c", "_r")
    said = "array<struct<turn:bigint,role:string,text:string>>"
    df = pairs.select(*kept, F.coalesce(F.col(chosen).cast(said), F.array().cast(said)).alias(ct), F.coalesce(F.col(rejected).cast(said), F.array().cast(said)).alias(rt))
    c, r = F.col(ct), F.col(rt)
    # of the shorter side's length; the first unequal position ends the prefix
    same = F.zip_with(F.slice(c, 1, F.size(r)), F.slice(r, 1, F.size(c)), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    first_off = F.array_position(same, F.lit(False)).cast("int")
    df = df.withColumn("prompt_turns", F.when(first_off > 0, first_off - 1).otherwise(F.size(same)))
    n = F.col("prompt_turns")
    rest_c, rest_r = F.slice(c, n + 1, F.size(c) + 1), F.slice(r, n + 1, F.size(r) + 1)
    return df.select(
        *kept, "prompt_turns", _rendered(F.slice(c, F.lit(1), n)).alias("prompt"),
        _rendered(rest_c).alias("chosen_completion"), _spans(rest_c).alias("chosen_mask"),
        _rendered(rest_r).alias("rejected_completion"), _spans(rest_r).alias("rejected_mask"),
    )


def runs(mask: Column) -> Column:
    """A mask as text, ``start:length`` joined by commas."""
    return F.array_join(F.transform(mask, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["length"].cast("string"))), ",")
