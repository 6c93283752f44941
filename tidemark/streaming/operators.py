"""Streaming forms of the operators; each equals its batch twin on a bounded replay."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling_bars(ticks: DataFrame, ts: str, key: str, price: str, ident: str, width: str, delay: str) -> DataFrame:
    """Bars finalised ``delay`` after their end; later rows are dropped, never back-filled."""
    o = F.struct(ts, ident)
    return ticks.withWatermark(ts, delay).groupBy(key, F.window(ts, width)).agg(
        F.min_by(price, o).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, o).alias("close"), F.count(F.lit(1)).alias("volume"))


def sliding_counts(events: DataFrame, ts: str, key: str, value: Column, width: str, slide: str, delay: str) -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(key, F.window(ts, width, slide)).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))


def first_seen(events: DataFrame, ts: str, ident: str, delay: str) -> DataFrame:
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([ident])


def bursts(events: DataFrame, ts: str, key: str, gap: str, delay: str) -> DataFrame:
    """Activity bursts: session windows closed by ``gap`` of silence."""
    return events.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("events"))


def interval_join(decisions: DataFrame, labels: DataFrame, d_ts: str, l_ts: str, d_key: str, l_key: str, within: str, delay: str) -> DataFrame:
    """Decisions joined to labels that end within ``within`` after them; both sides bounded by watermarks."""
    d, l = decisions.withWatermark(d_ts, delay), labels.withWatermark(l_ts, delay)  # noqa: E741
    return d.join(l, F.expr(f"{d_key} = {l_key} AND {l_ts} >= {d_ts} AND {l_ts} <= {d_ts} + INTERVAL {within}"))
