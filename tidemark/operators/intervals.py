"""Greedy selection of intervals that do not overlap, for keys of any size.

The rule "keep a row if it starts after the last kept end" looks like a fold over the whole key.  It is a walk along
successor pointers instead: the row kept after row i is the first one that starts after i's end.  A row that starts after the
end of all rows before it is kept whatever came earlier; such *heads* cut a key into islands.  Rows are numbered and cut into
blocks of bounded size; within a block every row's way out is found by one backward pass, heads fix the way into the
blocks behind them, and only runs of blocks without a head need pointer doubling, over rows of linear number per round.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import DAY, running
from tidemark.session import written

DAY_MICROS = DAY * 1_000_000


def successors(df: DataFrame, keys: Sequence[str], start: str, end: str, ident: str, gap: Column | int = 0, strict: bool = True, width: int = DAY_MICROS) -> DataFrame:
    """``keys``, ``ident``, ``_rn`` (row number by start, then ident) and ``_next``: number of the first later row that starts after
    this row's end plus ``gap`` (at or after it unless ``strict``); beyond the last row if there is none.

    Starts and ends are merged into one order and counted in blocks of ``width``: no pair of rows is formed.
    """
    gap = F.lit(gap)
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, F.col(ident).alias("_id"), F.col(start).alias("_s"), (F.col(end) + gap).alias("_e"))
    first, second = (0, 1) if strict else (1, 0)  # at equal values a strict end comes after the starts it does not reach beyond
    marks = rows.select(*keys, "_id", F.explode(F.array(
        F.struct(F.col("_s").alias("v"), F.lit(first).alias("kind"), F.lit(1).alias("one")), F.struct(F.col("_e").alias("v"), F.lit(second).alias("kind"), F.lit(0).alias("one")),
    )).alias("_m")).select(*keys, "_id", "_m.*")
    counted = running(marks, keys, [F.col("v"), F.col("kind"), F.col("_id")], F.floor(F.col("v") / F.lit(width)).cast("long"), {"_upto": F.col("one").cast("long")})
    paired = counted.groupBy(*keys, "_id").agg(F.max(F.when(F.col("one") == 1, F.col("_upto"))).alias("_rn"), F.max(F.when(F.col("one") == 0, F.col("_upto"))).alias("_upto"))
    return paired.select(*keys, F.col("_id").alias(ident), "_rn", (F.greatest("_upto", "_rn") + 1).alias("_next"))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> tuple[DataFrame, Column]:
    """``right`` with renamed keys, and the null-safe condition that joins on them."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(F.col(f"{prefix}{k}"))
    return right.withColumnsRenamed({k: f"{prefix}{k}" for k in keys}), on


def non_overlapping(
    df: DataFrame, keys: Sequence[str], start: str, end: str, ident: str, gap: Column | int = 0, strict: bool = True,
    width: int = DAY_MICROS, block_rows: int = 4096,
) -> DataFrame:
    """``keys``, ``ident``, ``event_no`` (from 1 per key) of the rows that the greedy rule keeps.

    ``ident`` is unique within ``keys``; rows go by start, then ident.  The first row is kept, then each that starts after
    the last kept end plus ``gap`` (at or after it unless ``strict``).  Rows with a null start or end are left out.
    """
    keys = list(keys)
    rows = successors(df, keys, start, end, ident, gap, strict, width).withColumn("_blk", F.floor((F.col("_rn") - 1) / F.lit(block_rows)).cast("long"))
    rows = written(rows)
    ahead = Window.partitionBy(*keys).orderBy("_blk")
    blocks = rows.groupBy(*keys, "_blk").agg(F.max("_next").alias("_reach")).withColumn(  # one row a block
        "_past", F.coalesce(F.max("_reach").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1)))
    inside = Window.partitionBy(*keys, "_blk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
    # what all earlier rows reach, the blocks before by their summary row (number 0)
    carried = rows.unionByName(blocks.select(*keys, "_blk", F.lit(0).cast("long").alias("_rn"), F.col("_past").alias("_next")), allowMissingColumns=True)
    rows = carried.withColumn("_head", F.max("_next").over(inside) <= F.col("_rn")).where(F.col("_rn") > 0)

    out_schema = _schema(df, keys, "_blk long, _rn long, _exit long, _head boolean")
    exits = written(rows.groupBy(*keys, "_blk").applyInPandas(lambda f: _exits(f, keys), out_schema))
    leaving = exits.where("_head").groupBy(*keys, "_blk").agg(F.max_by("_exit", "_rn").alias("_rn"))  # the last head's way out of its block
    with_head = leaving.select(*keys, "_blk").withColumn("_has", F.lit(1))
    fixed, on = _same(blocks, with_head, keys, "_h_")
    runs = blocks.join(fixed.withColumnRenamed("_blk", "_h_blk"), on & (blocks["_blk"] == F.col("_h_blk")), "left").select(*keys, "_blk", "_has")
    runs = runs.withColumn("_since", F.col("_blk") - F.max(F.when(F.col("_has") == 1, F.col("_blk"))).over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    longest = runs.agg(F.max("_since")).first()[0] or 0

    entries = leaving.select(*keys, "_rn")
    jumps = exits.select(*keys, "_rn", "_exit")
    rounds = int(longest).bit_length()
    if rounds:  # only rows that are some row's way out can be a way in
        targets = jumps.select(*keys, F.col("_exit").alias("_rn")).distinct()
        known, on = _same(jumps, targets, keys, "_t_")
        jumps = written(jumps.join(known.withColumnRenamed("_rn", "_t_rn"), on & (jumps["_rn"] == F.col("_t_rn")), "left_semi"))
    for i in range(rounds):
        there, on = _same(entries, jumps, keys, "_t_")
        moved = entries.join(there.withColumnRenamed("_rn", "_t_rn"), on & (entries["_rn"] == F.col("_t_rn"))).select(*keys, F.col("_exit").alias("_rn"))
        entries = written(entries.unionByName(moved).distinct())
        if i + 1 < rounds:
            there, on = _same(jumps, jumps, keys, "_t_")
            there = there.withColumnsRenamed({"_rn": "_t_rn", "_exit": "_t_exit"})
            jumps = written(jumps.join(there, on & (jumps["_exit"] == F.col("_t_rn"))).select(*keys, "_rn", F.col("_t_exit").alias("_exit")))
    ways_in = entries.select(*keys, "_rn", F.floor((F.col("_rn") - 1) / F.lit(block_rows)).cast("long").alias("_blk"), F.lit(True).alias("_entry"))
    walked = rows.select(*keys, "_blk", "_rn", "_next", F.col("_head").alias("_entry")).unionByName(ways_in, allowMissingColumns=True)
    kept = walked.groupBy(*keys, "_blk").applyInPandas(lambda f: _walk(f, keys), _schema(df, keys, "_blk long, _rn long, _in_block long"))
    per_block = written(kept)
    before = per_block.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_count")).withColumn(
        "_before", F.coalesce(F.sum("_count").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    carry = before.select(*keys, "_blk", F.lit(0).cast("long").alias("_rn"), F.col("_before").alias("_in_block"))
    names = rows.select(*keys, "_blk", "_rn", ident)
    merged = per_block.unionByName(carry).unionByName(names, allowMissingColumns=True)
    block = Window.partitionBy(*keys, "_blk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = merged.groupBy(*keys, "_blk", "_rn").agg(F.max("_in_block").alias("_in_block"), F.max(ident).alias(ident)).withColumn("_base", F.first("_in_block").over(block))
    return numbered.where((F.col("_rn") > 0) & F.col("_in_block").isNotNull()).select(*keys, ident, (F.col("_base") + F.col("_in_block")).cast("long").alias("event_no"))


def _schema(df: DataFrame, keys: Sequence[str], rest: str) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), rest])


def _exits(block: pd.DataFrame, keys: Sequence[str]) -> pd.DataFrame:
    """Each row's first pointer out of the block: one backward pass."""
    block = block.sort_values("_rn")
    low, to = int(block["_rn"].iloc[0]), block["_next"].to_numpy()
    out = to.tolist()
    high = low + len(out)
    for i in range(len(out) - 1, -1, -1):
        if out[i] < high:
            out[i] = out[out[i] - low]
    return block[[*keys, "_blk", "_rn"]].assign(_exit=out, _head=block["_head"])


def _walk(block: pd.DataFrame, keys: Sequence[str]) -> pd.DataFrame:
    """Rows kept in the block: those met on the way from its heads and its way in."""
    rows = block[block["_next"].notna()].sort_values("_rn")
    columns = [*keys, "_blk", "_rn"]
    if not len(rows):  # a way out that leads beyond the last row
        return rows[columns].assign(_in_block=np.array([], np.int64))
    low, to = int(rows["_rn"].iloc[0]), rows["_next"].astype(np.int64).tolist()
    kept = np.zeros(len(to), bool)
    for at in block.loc[block["_entry"].fillna(False).astype(bool), "_rn"].tolist():
        i = int(at) - low
        while i < len(to) and not kept[i]:
            kept[i] = True
            i = to[i] - low
    out = rows[kept][columns]
    return out.assign(_in_block=np.arange(1, len(out) + 1))
