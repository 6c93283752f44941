"""Classification, ranking and trade-economics measures as aggregates."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import non_overlapping
from tidemark.operators.ordered import quantiles, value_counts


def classification(df: DataFrame, keys: Sequence[str], target: str, probability: str) -> DataFrame:
    """AUC (average ranks), average precision, threshold metrics, Brier, log loss, ECE, top-decile lift per key."""
    p = F.col(probability)  # NaN stays: greatest and least would make it 1
    d = df.withColumn("_p", F.when(F.isnan(p), p).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))).withColumn("_y", F.col(target).cast("double"))
    c = value_counts(d, keys, "_p", {"_pos": F.col("_y")})
    tp, seen = F.col("_pos_n") - F.col("_pos_le") + F.col("_pos"), F.col("_n") - F.col("_le") + F.col("_eq")
    P, N = F.max("_pos_n"), F.max(F.col("_n") - F.col("_pos_n"))
    curve = c.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("_pos") * (F.col("_le") - (F.col("_eq") - 1) / 2)) - P * (P + 1) / 2, P * N).alias("roc_auc"),
        F.when(N > 0, F.try_divide(F.sum(F.col("_pos") * tp / seen), P)).alias("average_precision"))
    hat, y, eps = F.col("_p") >= 0.5, F.col("_y"), 2.220446049250313e-16
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("_p")))
    cutoff = quantiles(d, keys, "_p", {"cutoff": 0.9})
    top = _join(d, cutoff, keys).groupBy(*keys).agg(F.avg(F.when(F.col("_p") >= F.col("cutoff"), y)).alias("top_decile_positive_rate"))
    hits = F.sum(F.when(hat, y).otherwise(0.0))
    base = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg((hat.cast("double") == y).cast("double")).alias("accuracy"),
        F.coalesce(F.try_divide(hits, F.count_if(hat)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(hits, F.sum(y)), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * hits, F.count_if(hat) + F.sum(y)), F.lit(0.0)).alias("f1"),
        F.avg((F.col("_p") - y) * (F.col("_p") - y)).alias("brier_score"),
        F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"), F.avg(y).alias("base_positive_rate"))
    out = _join(_join(_join(base, curve, keys), top, keys), calibration_error(d, keys, "_y", "_p"), keys)
    return out.withColumn("top_decile_lift", F.try_divide("top_decile_positive_rate", "base_positive_rate"))


def _join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    # without keys ``b`` is a single aggregate row
    return a.join(b, list(keys)) if keys else a.join(F.broadcast(b))


def probability_bin(p: str, bins: int = 10, right_closed: bool = False) -> Column:
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    return sum((F.col(p) > e if right_closed else F.col(p) >= e).cast("int") for e in edges)


def calibration_error(df: DataFrame, keys: Sequence[str], target: str, probability: str, right_closed: bool = False) -> DataFrame:
    """Expected calibration error over ten bins; both edge conventions."""
    b = df.withColumn("_bin", probability_bin(probability, right_closed=right_closed)).groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("_c"), F.avg(target).alias("_t"), F.avg(probability).alias("_m"))
    return b.groupBy(*keys).agg((F.sum(F.col("_c") * F.abs(F.col("_t") - F.col("_m"))) / F.sum("_c")).alias("expected_calibration_error"))


def _discounts(k: int) -> list[float]:
    out = [0.0]
    for i in range(1, k + 1):
        out.append(out[-1] + 1.0 / math.log2(i + 1))
    return out


def ndcg(df: DataFrame, group: Sequence[str], score: str, gain: str, k: int) -> DataFrame:
    """NDCG@k with linear gains; tied scores share their average gain (cumulative discounts per tie run)."""
    table = F.array(*[F.lit(x) for x in _discounts(k)])
    upto = lambda pos: F.element_at(table, (F.least(pos, F.lit(k)) + 1).cast("int"))

    def dcg(by: str, name: str) -> DataFrame:
        c = value_counts(df.withColumn("_gain", F.col(gain).cast("double")), group, by, {"_g": F.col("_gain")})
        first, last = F.col("_n") - F.col("_le"), F.col("_n") - F.col("_le") + F.col("_eq")
        return c.groupBy(*group).agg(F.sum(F.col("_g") / F.col("_eq") * (upto(last) - upto(first))).alias(name), F.max("_n").alias(f"{name}_rows"))

    both = dcg(score, "_dcg").join(dcg(gain, "_ideal"), list(group))
    return both.select(*group, F.col("_dcg_rows").alias("rows"), F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).otherwise(0.0).alias("ndcg"))


def profit_factor(ret: str) -> Column:
    gains, losses = F.sum(F.when(F.col(ret) > 0, F.col(ret)).otherwise(0.0)), -F.sum(F.when(F.col(ret) < 0, F.col(ret)).otherwise(0.0))
    return F.when(losses > 0, gains / losses).when(gains > 0, gains / 1e-12)


def period_returns(trades: DataFrame, keys: Sequence[str], session: str, group: str, ret: str) -> DataFrame:
    """Mean per decision group, summed per session (one row per session: calendar-sized)."""
    g = trades.where(F.col(ret).isNotNull()).groupBy(*keys, session, group).agg(F.avg(ret).alias("_g"))
    return g.groupBy(*keys, session).agg(F.sum("_g").alias("session_return"))


def equity(periods: DataFrame, keys: Sequence[str], session: str, value: str = "session_return", additive: bool = False) -> DataFrame:
    """Equity curve and drawdown along sessions; multiplicative, or additive cumulative sums."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(session).rowsBetween(Window.unboundedPreceding, 0)
    curve = F.sum(value).over(w) if additive else F.product(1 + F.greatest(F.col(value), F.lit(-0.999999))).over(w)
    d = periods.withColumn("equity", curve)
    peak = F.max("equity").over(w)
    return d.withColumn("drawdown", F.col("equity") - peak if additive else F.col("equity") / peak - 1)


def economics(trades: DataFrame, keys: Sequence[str], session: str, group: str, ret: str, excess: Mapping[str, str] | None = None) -> DataFrame:
    """Trade and session economics per key: mean, win rate, profit factor, compounded return, drawdown."""
    base = trades.groupBy(*keys).agg(
        F.count(ret).alias("selected_trades"), F.countDistinct(group).alias("selected_decision_groups"), F.avg(ret).alias("avg_trade_return"),
        *[F.avg(c).alias(n) for n, c in (excess or {}).items()],
        F.avg((F.col(ret) > 0).cast("double")).alias("win_rate"), profit_factor(ret).alias("profit_factor"))
    curve = equity(period_returns(trades, keys, session, group, ret), keys, session)
    sess = curve.groupBy(*keys).agg(
        (F.max_by("equity", session) - 1).alias("cumulative_return"), F.abs(F.min("drawdown")).alias("max_drawdown"),
        F.avg((F.col("session_return") < 0).cast("double")).alias("negative_session_rate"), F.count(F.lit(1)).alias("sessions"))
    return _join(base, sess, keys).withColumn("return_drawdown_ratio", F.try_divide("cumulative_return", "max_drawdown"))


# Measures whose worst case is the largest value; all others take the smallest.
BAD_HIGH = ("max_drawdown", "negative_session_rate", "average_turnover")


def conservative(economic_rows: DataFrame, measures: Sequence[str]) -> DataFrame:
    return economic_rows.agg(*[(F.max(m) if m in BAD_HIGH else F.min(m)).alias(m) for m in measures])


def non_overlapping_groups(groups: DataFrame, keys: Sequence[str], group: str, entry: str, exit_: str) -> DataFrame:
    """Groups kept by the greedy rule entry > last exit.

    Input is reduced to distinct groups, i.e. decision times.
    """
    g = groups.groupBy(*keys, group).agg(F.min(F.unix_micros(entry)).alias("_s"), F.max(F.unix_micros(exit_)).alias("_e"))
    return non_overlapping(g, keys, "_s", "_e", group)


def bootstrap(blocks: DataFrame, keys: Sequence[str], session: str, total: str, count: str, iterations: int, seed: int) -> DataFrame:
    """95 % session-block bootstrap interval of sum/count.

    ``blocks`` has one row per session.  Draw (iteration, position) picks the
    session with ordinal md5(seed:iteration:position) mod n, so any engine and
    any task layout draws the same blocks.
    """
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(session)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    b = blocks.withColumns({"_pos": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(whole)})
    draws = b.select(*keys, "_pos", "_n", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("_it"))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_it").cast("string"), F.col("_pos").cast("string")))
    draws = draws.select(*keys, "_it", F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.col("_n")).alias("_pos"))
    s = draws.join(b.select(*keys, "_pos", F.col(total).alias("_t"), F.col(count).alias("_c")), [*keys, "_pos"])
    samples = s.groupBy(*keys, "_it").agg(F.try_divide(F.sum("_t"), F.sum("_c")).alias("_v"))
    ci = quantiles(samples, keys, "_v", {"low": 0.025, "high": 0.975})
    point = blocks.groupBy(*keys).agg((F.sum(total) / F.sum(count)).alias("point"))
    return _join(point, ci, keys)


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Long metrics (metric, value) against thresholds (metric, kind 'min'|'max', limit): failing rows.

    A missing or null metric fails its gate.
    """
    j = thresholds.join(metrics, "metric", "left")
    bad = F.col("value").isNull() | ((F.col("kind") == "min") & (F.col("value") < F.col("limit"))) | ((F.col("kind") == "max") & (F.col("value") > F.col("limit")))
    return j.where(bad).select("metric", "kind", "limit", "value")
