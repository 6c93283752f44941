"""Membership intervals from a change log, and batch trade pricing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rename_changes(renames: DataFrame) -> DataFrame:
    """A rename is an addition of the new and a deletion of the old symbol (old_ticker, new_ticker, effective_at)."""
    return renames.select(F.col("new_ticker").alias("ticker"), "effective_at", F.lit("addition").alias("action")).unionByName(
        renames.select(F.col("old_ticker").alias("ticker"), "effective_at", F.lit("deletion").alias("action")))


def membership_intervals(changes: DataFrame, current: DataFrame, start: Column) -> DataFrame:
    """Reverse additions and deletions from a current snapshot into half-open intervals.

    ``changes``: ticker, effective_at, action; ``current``: ticker.  Runs of equal
    actions are collapsed: in each run only the latest change is consistent with
    what follows, the others are contradictions (see :func:`contradictions`).
    An index changes a ticker a handful of times, so per-ticker windows are small.
    """
    runs = _runs(changes, current)
    w = Window.partitionBy("ticker").orderBy("run")
    runs = runs.withColumns({"next_at": F.lead("at").over(w), "next_valid": F.lead("valid").over(w), "first": F.row_number().over(w) == 1})
    opened = runs.where("action = 'addition' and valid").select(
        "ticker", F.col("at").alias("effective_from"), F.when(F.col("next_valid"), F.col("next_at")).alias("effective_to"))
    from_start = runs.where("action = 'deletion' and first").select(
        "ticker", start.alias("effective_from"), F.when(F.col("valid"), F.col("at")).alias("effective_to"))
    steady = current.select("ticker").join(changes.select("ticker").distinct(), "ticker", "left_anti").select(
        "ticker", start.alias("effective_from"), F.lit(None).cast("timestamp").alias("effective_to"))
    return opened.unionByName(from_start).unionByName(steady)


def contradictions(changes: DataFrame, current: DataFrame) -> DataFrame:
    """Number of changes per ticker that disagree with the state right after them."""
    return _runs(changes, current).groupBy("ticker").agg(
        F.sum(F.col("changes") - F.col("valid").cast("long")).alias("contradictions")).where("contradictions > 0")


def _runs(changes: DataFrame, current: DataFrame) -> DataFrame:
    # at one instant a deletion precedes an addition
    log = changes.select("ticker", "effective_at", "action").distinct()
    order = Window.partitionBy("ticker").orderBy("effective_at", F.desc("action"))
    log = log.withColumn("_new", F.coalesce((F.col("action") != F.lag("action").over(order)).cast("int"), F.lit(1)))
    log = log.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = log.groupBy("ticker", "run", "action").agg(F.max("effective_at").alias("at"), F.count(F.lit(1)).alias("changes"))
    last = F.max("run").over(Window.partitionBy("ticker")) == F.col("run")
    now = current.select("ticker").distinct().withColumn("_in", F.lit(True))
    present = F.coalesce("_in", F.lit(False))
    return runs.join(now, "ticker", "left").withColumn(
        "valid", F.when(~last, True).otherwise((F.col("action") == "addition") == present)).drop("_in")


def trade_returns(trades: DataFrame, capital: float = 10_000.0, slippage_bps: float = 5.0, commission_bps: float = 1.0) -> DataFrame:
    """Shares, ending value, pnl and return of priced trades (entry_open, exit_close)."""
    s, c = slippage_bps / 10_000.0, commission_bps / 10_000.0
    d = trades.withColumns({"entry_price": F.col("entry_open") * (1 + s), "exit_price": F.col("exit_close") * (1 - s)})
    d = d.withColumn("shares", capital / F.nullif(F.col("entry_price") * (1 + c), F.lit(0.0)))
    d = d.withColumn("ending_value", F.col("shares") * F.col("exit_price") * (1 - c))
    return d.withColumns({"pnl": F.col("ending_value") - capital, "return_pct": (F.col("ending_value") - capital) / capital})
