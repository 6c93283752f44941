"""Technical features per ticker and per (ticker, session).

Row-frame windows run over row blocks with a halo, so one long series is spread
over many tasks.  (ticker, session) and (ticker, minute-of-day) groups are
bounded by the calendar and use plain windows.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import ratio
from tidemark.operators.ordered import ewm, frame, own, row_blocks, time_block

WILDER = 1.0 / 14.0


def span(n: int) -> float:
    """Smoothing factor of an exponential mean of span n."""
    return 2.0 / (n + 1.0)


def guarded(agg: Column, counted: str, w, minimum: int) -> Column:
    """Window aggregate that is null until ``minimum`` non-null values are in the frame."""
    return F.when(F.count(counted).over(w) >= minimum, agg.over(w))


def blocks(df: DataFrame, ts: str, back: int, ahead: int = 0, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    stamp = F.col(ts).cast("timestamp")
    return row_blocks(df, keys, [F.col(ts)], time_block(stamp, 365 * 86_400), back=back, ahead=ahead)


def true_range(prior: str = "prior_close") -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col(prior)), F.abs(F.col("low") - F.col(prior)))


def apart(df: DataFrame, w, wanted: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Adds ``<column>_<i>``, the value i rows before, for every ``step`` rows within the last ``rows`` (``wanted``: column -> (step, rows))."""
    return df.withColumns({f"{c}_{i}": F.lag(c, i).over(w) for c, (step, rows) in wanted.items() for i in range(step, rows, step)})


def parts(column: str, step: int, rows: int) -> list[Column]:
    """The columns of :func:`apart`, own row first: what ``step`` rows each give, side by side over ``rows`` rows."""
    return [F.col(column), *[F.col(f"{column}_{i}") for i in range(step, rows, step)]]


def pooled_std(column: str, step: int, rows: int) -> Column:
    """Sample deviation of ``rows`` values from ``_m`` means and ``_v`` population variances of ``step`` rows each."""
    means = parts(f"_m_{column}", step, rows)
    mean = sum(means) / len(means)
    squares = sum(v + (m - mean) * (m - mean) for m, v in zip(means, parts(f"_v_{column}", step, rows)))
    return F.sqrt(squares * step / (rows - 1.0))


def z_reaches(z: str, value: str, total: str, squares: str, rows: int, edge: float) -> Column:
    """Whether a z-score among ``rows`` values is at least ``edge`` > 0; ties, which rounding would decide, by their sums, exact for whole numbers."""
    gap, spread = rows * F.col(value) - F.col(total), rows * F.col(squares) - F.col(total) * F.col(total)
    exact = (gap >= 0) & (gap * gap * (rows - 1) >= edge * edge * rows * spread)
    return F.when(F.abs(F.col(z) - edge) < 1e-9, exact).otherwise(F.col(z) >= edge)


def daily_windows(bars: DataFrame, ts: str = "date", keys: Sequence[str] = ("ticker",), horizon: int = 0) -> DataFrame:
    """Row-frame features of a bar series (returns, volatility, means, extremes, ATR, RSI, volume pressure).

    A long frame is put together from short ones some rows apart, so that its cost does not grow with its rows; nothing is
    subtracted from a running sum, so no digits are lost.  Minimum periods come from running counts.  With ``horizon`` the forward
    return of that many bars (``future_return``) comes from the same blocks.
    """
    w = frame(keys)
    rows = lambda a, b=0: frame(keys, a, b)
    kept = {*bars.columns, "_rn", "_blk", "_home", "_ag", "_al", "_gain", "_loss"}
    d = blocks(bars, ts, back=280, ahead=horizon, keys=keys)
    if horizon:
        d = d.withColumns({"_exit": F.lead("close", horizon).over(w), "_entry": F.lead("open").over(w)}).withColumn("future_return", ratio("_exit", "_entry") - 1)
    d = d.withColumns({
        "prior_close": F.lag("close").over(w), **{f"_lag_{k}": F.lag("close", k).over(w) for k in (5, 10, 20, 60)}})
    delta = F.col("close") - F.col("prior_close")
    d = d.withColumns({
        "bar_count": F.col("_rn"), "return_1d": ratio("close", "prior_close") - 1,
        **{f"return_{k}d": ratio("close", f"_lag_{k}") - 1 for k in (5, 10, 20, 60)},
        "true_range": true_range(), "_gain": F.when(delta > 0, delta).when(delta <= 0, 0.0), "_loss": F.when(delta < 0, -delta).when(delta >= 0, 0.0)})
    counted = {"close": (50, 200, 252), "return_1d": (10, 20, 60), "high": (20,), "low": (20,), "volume": (20,)}
    d = d.withColumns({
        **{f"_n_{c}": F.count(c).over(rows(Window.unboundedPreceding)) for c in counted},
        "_s_close": F.sum("close").over(rows(-9)),
        **{f"_{a}_{c}": f(c).over(rows(-9)) for c in ("return_1d", "volume") for a, f in (("m", F.avg), ("v", F.var_pop))},
        "_s_volume": F.sum("volume").over(rows(-9)), "_q_volume": F.sum(F.col("volume") * F.col("volume")).over(rows(-9)),
        "_max_close": F.max("close").over(rows(-5)), "_min_close": F.min("close").over(rows(-5)),
        "_max_high": F.max("high").over(rows(-4)), "_min_low": F.min("low").over(rows(-4)),
        # short means are summed row by row, in the order of the SQL: their rounded values are compared
        "sma_20": guarded(F.avg("close"), "close", rows(-19), 20),
        **{a: guarded(F.avg(c), c, rows(-13), 14) for a, c in (("atr_14", "true_range"), ("_ag", "_gain"), ("_al", "_loss"))},
        "prior_volume_median": guarded(F.percentile("volume", F.lit(0.5)), "volume", rows(-20, -1), 5)})
    d = d.withColumns({f"_n_{c}_{k}": F.lag(f"_n_{c}", k, 0).over(w) for c, ks in counted.items() for k in ks})
    d = apart(d, w, {
        "_s_close": (10, 50), "_m_return_1d": (10, 60), "_v_return_1d": (10, 60), "_m_volume": (10, 20), "_v_volume": (10, 20), "_s_volume": (10, 20), "_q_volume": (10, 20),
        "_max_close": (6, 36), "_min_close": (6, 36), "_max_high": (5, 20), "_min_low": (5, 20)})
    full = lambda c, k, least, x: F.when(F.col(f"_n_{c}") - F.col(f"_n_{c}_{k}") >= least, x)
    d = d.withColumns({
        **{f"realized_vol_{k}d": full("return_1d", k, k, pooled_std("return_1d", 10, k)) for k in (10, 20, 60)},
        "sma_50": full("close", 50, 50, sum(parts("_s_close", 10, 50)) / 50), "_s50_close": sum(parts("_s_close", 10, 50)),
        "_max36_close": F.greatest(*parts("_max_close", 6, 36)), "_min36_close": F.least(*parts("_min_close", 6, 36)),
        "recent_high_20": full("high", 20, 5, F.greatest(*parts("_max_high", 5, 20))), "recent_low_20": full("low", 20, 5, F.least(*parts("_min_low", 5, 20))),
        "volume_sum_20": full("volume", 20, 20, sum(parts("_s_volume", 10, 20))), "volume_squares_20": full("volume", 20, 20, sum(parts("_q_volume", 10, 20))),
        "_vs": full("volume", 20, 20, pooled_std("volume", 10, 20)), "_vm": full("volume", 20, 20, sum(parts("_s_volume", 10, 20)) / 20)})
    d = apart(d, w, {"_s50_close": (50, 200), "_max36_close": (36, 252), "_min36_close": (36, 252)}).withColumns(
        {"prior_high_20": F.lag("recent_high_20").over(w), "prior_low_20": F.lag("recent_low_20").over(w)})
    d = d.withColumns({
        "sma_200": full("close", 200, 200, sum(parts("_s50_close", 50, 200)) / 200),
        "high_252": full("close", 252, 20, F.greatest(*parts("_max36_close", 36, 252))), "low_252": full("close", 252, 20, F.least(*parts("_min36_close", 36, 252)))})
    d = d.withColumn("_sma_lag", F.lag("sma_200", 20).over(w))
    out = d.withColumns({
        **{f"dist_sma_{k}": ratio("close", f"sma_{k}") - 1 for k in (20, 50, 200)},
        "sma_200_slope_20d": ratio("sma_200", "_sma_lag") - 1,
        "atr_pct_14": ratio("atr_14", "close"), "rsi_14": rsi("_ag", "_al"),
        "volume_z20": ratio(F.col("volume") - F.col("_vm"), "_vs"), "volume_ratio_20": ratio("volume", "_vm"),
        "gap_return": ratio("open", "prior_close") - 1, "intraday_return": ratio("close", "open") - 1,
        "range_pct": ratio(F.col("high") - F.col("low"), "prior_close"),
        "close_location": ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
        "dollar_volume_log": F.log1p(F.col("close") * F.col("volume")),
        "pct_from_52w_high": ratio("close", "high_252") - 1, "pct_from_52w_low": ratio("close", "low_252") - 1,
        "volume_burst_20bar": ratio("volume", "prior_volume_median"),
    })
    return own(out.drop(*[c for c in out.columns if c.startswith("_") and c not in kept]))


def rsi(gain: str, loss: str, edges: bool = False) -> Column:
    """RSI from average gain and loss; with ``edges`` a zero loss gives 100 (or 50 when flat)."""
    base = 100 - 100 / (1 + ratio(gain, loss))
    if not edges:
        return base
    return F.when((F.col(loss) == 0) & (F.col(gain) > 0), 100.0).when((F.col(loss) == 0) & (F.col(gain) == 0), 50.0).otherwise(base)


def mean_of_mean(inner: str, outer: str, a: float, c: float) -> Column:
    """Exponential mean (factor ``c``) of the exponential mean ``inner`` (factor ``a``) of a series whose mean with ``c`` is ``outer``."""
    return (F.col(inner) * (c * (1 - a)) - F.col(outer) * (a * (1 - c))) / (c - a)


def exponential(
    df: DataFrame, keys: Sequence[str] = ("ticker",), spans: Mapping[int, int] | None = None,
    macd_periods: tuple[int, int, int] = (1, 1, 1),
) -> DataFrame:
    """EMA / MACD / Wilder RSI and ATR on numbered rows (``_rn``, ``prior_close``, OHLC).

    ``spans`` maps span -> min_periods; ``macd_periods`` are the min periods of
    the 12, 26 and 9 means.
    """
    spans = spans if spans is not None else {10: 1, 20: 1, 50: 1}
    delta = F.col("close") - F.col("prior_close")
    d = df.withColumns({"_g": F.when(delta > 0, delta).when(delta <= 0, 0.0), "_l": F.when(delta < 0, -delta).when(delta >= 0, 0.0), "_tr": true_range()})
    m12, m26, m9 = macd_periods
    series = {f"ema_{k}": ("close", span(k), 1) for k in spans}
    series |= {"_e12": ("close", span(12), 1), "_e26": ("close", span(26), 1), "_ag_w": ("_g", WILDER, 2), "_al_w": ("_l", WILDER, 2),
               "atr_14_wilder": ("_tr", WILDER, 1)} | ({"_e9": ("close", span(9), 1)} if max(m12, m26) == 1 else {})
    d = ewm(d, keys, series)
    first = max(m12, m26)
    macd = F.when(F.col("_rn") >= first, F.col("_e12") - F.col("_e26"))
    if first == 1:  # one pass: the mean of a mean is a sum of two means
        d = d.withColumns({"macd": macd, "macd_signal": mean_of_mean("_e12", "_e9", span(12), span(9)) - mean_of_mean("_e26", "_e9", span(26), span(9))})
    else:
        d = ewm(d.withColumn("macd", macd), keys, {"macd_signal": ("macd", span(9), first)})
    d = d.withColumns({
        **{f"ema_{k}": F.when(F.col("_rn") >= m, F.col(f"ema_{k}")) for k, m in spans.items()},
        "macd_signal": F.when(F.col("_rn") >= first + m9 - 1, F.col("macd_signal")),
        "rsi_14_wilder": rsi("_ag_w", "_al_w", edges=True),
    })
    return d.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop("_g", "_l", "_tr", "_e9", "_e12", "_e26", "_ag_w", "_al_w")


def session_windows(bars: DataFrame, ts: str = "timestamp", opening_minutes: int = 30) -> DataFrame:
    """Session-reset features: n-bar returns, volatility, VWAP, growing opening and premarket ranges, clock.

    Expects ``session_date_et`` and ``minute_et``.
    """
    sess = Window.partitionBy("ticker", "session_date_et").orderBy(ts)
    run = sess.rowsBetween(Window.unboundedPreceding, 0)
    rows = lambda a: sess.rowsBetween(a, 0)
    from_open = F.col("minute_et") - 570
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    d = bars.withColumns({**{f"return_{k}bar": ratio("close", F.lag("close", k).over(sess)) - 1 for k in (1, 3, 6, 12)},
                          "_pv": typical * F.col("volume")})
    opening, pre = from_open.between(0, opening_minutes), F.col("minute_et").between(240, 569)
    d = d.withColumns({
        **{f"volatility_{k}bar": guarded(F.stddev_samp("return_1bar"), "return_1bar", rows(-k + 1), max(2, k // 2)) for k in (3, 6, 12)},
        "session_vwap": ratio(F.sum("_pv").over(run), F.sum("volume").over(run)),
        "opening_range_high": F.max(F.when(opening, F.col("high"))).over(run),
        "opening_range_low": F.min(F.when(opening, F.col("low"))).over(run),
        "_pre_high": F.max(F.when(pre, F.col("high"))).over(run), "_pre_low": F.min(F.when(pre, F.col("low"))).over(run),
        "session_progress": F.greatest(F.lit(0.0), F.least(F.lit(1.0), from_open / 390.0)),
    })
    radians = 2 * F.pi() * F.col("session_progress")
    return d.withColumns({
        "dist_session_vwap": ratio("close", "session_vwap") - 1,
        "session_vwap_slope_3bar": ratio("session_vwap", F.lag("session_vwap", 3).over(sess)) - 1,
        "session_vwap_slope_6bar": ratio("session_vwap", F.lag("session_vwap", 6).over(sess)) - 1,
        "opening_range_width_pct": (F.col("opening_range_high") - F.col("opening_range_low")) / F.col("close"),
        "dist_opening_range_high": ratio("close", "opening_range_high") - 1,
        "dist_opening_range_low": ratio("close", "opening_range_low") - 1,
        "above_opening_range": F.coalesce(F.col("close") > F.col("opening_range_high"), F.lit(False)).cast("int"),
        "below_opening_range": F.coalesce(F.col("close") < F.col("opening_range_low"), F.lit(False)).cast("int"),
        "premarket_range_pct": (F.col("_pre_high") - F.col("_pre_low")) / F.col("close"),
        "session_minute_sin": F.sin(radians), "session_minute_cos": F.cos(radians),
        "is_opening": from_open.between(0, 59).cast("int"), "is_midday": from_open.between(120, 239).cast("int"),
        "is_power_hour": from_open.between(330, 390).cast("int"),
    }).drop("_pv", "_pre_high", "_pre_low")


def session_summary(bars: DataFrame, ts: str = "timestamp", regular: Column | None = None) -> DataFrame:
    """First open and last close per (ticker, session) with the prior session close and overnight gap."""
    kept = bars if regular is None else bars.where(regular)
    g = kept.groupBy("ticker", "session_date_et").agg(
        F.min_by("open", ts).alias("session_open"), F.max_by("close", ts).alias("session_close"))
    d = blocks(g, "session_date_et", back=1)
    d = own(d.withColumn("prior_session_close", F.lag("session_close").over(frame(["ticker"]))))
    return d.withColumn("overnight_gap", ratio("session_open", "prior_session_close") - 1).drop("_rn")


def same_minute_relative_volume(bars: DataFrame, ts: str = "timestamp", minimum: int = 3) -> DataFrame:
    """Volume against the median of the last 20 prior sessions at the same minute (one row per session: calendar-bounded)."""
    w = Window.partitionBy("ticker", "minute_et").orderBy(ts).rowsBetween(-20, -1)
    base = guarded(F.percentile("volume", F.lit(0.5)), "volume", w, minimum)
    return bars.withColumn("relative_volume_same_minute_20d", ratio("volume", base))


def expanding_volatility_regime(bars: DataFrame, value: str, ts: str, session: str = "session_date_et", minimum: int = 6) -> DataFrame:
    """High-volatility flag: expanding session std above its own expanding median (session-bounded frames)."""
    w = Window.partitionBy(session).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    d = bars.withColumn("_vol", guarded(F.stddev_samp(value), value, w, minimum))
    d = d.withColumn("_thr", guarded(F.percentile("_vol", F.lit(0.5)), "_vol", w, minimum))
    return d.withColumns({"expanding_volatility": F.col("_vol"),
                          "regime_high_volatility": F.coalesce(F.col("_vol") > F.col("_thr"), F.lit(False)).cast("int")}).drop("_vol", "_thr")


def microstructure() -> dict[str, Column]:
    """Spread, imbalance and trade size from bid, ask, bid_size, ask_size, trade_count, volume."""
    b, a, bs, as_, tc = (F.col(c) for c in ("bid", "ask", "bid_size", "ask_size", "trade_count"))
    ok = F.coalesce((b > 0) & (a >= b) & (bs >= 0) & (as_ >= 0) & (tc > 0), F.lit(False))
    return {
        "microstructure_available": ok.cast("int"), "spread_pct": F.when(ok, ratio(a - b, (a + b) / 2)),
        "quote_imbalance": F.when(ok, ratio(bs - as_, bs + as_)), "average_trade_size": F.when(ok, F.col("volume") / tc)}


def confirmation(bars: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Latest regular session of one-minute bars per ticker: VWAP, returns, burst, range flags, label.

    Expects ``session_date_et`` and ``minute_et``; only one session per ticker is ranked.
    """
    regular = bars.where(F.col("minute_et").between(570, 960))
    last = regular.groupBy("ticker").agg(F.max("session_date_et").alias("session_date_et"))
    s = regular.join(last, ["ticker", "session_date_et"], "left_semi")
    w = Window.partitionBy("ticker").orderBy(ts)
    s = s.withColumns({"_v15": F.sum("volume").over(w.rowsBetween(-14, 0)),
                       "_back": F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc(ts)))})
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    opening = F.col("minute_et").between(570, 599)
    pick = lambda c, k: F.max(F.when(F.col("_back") == k, F.col(c)))
    g = s.groupBy("ticker").agg(
        F.max("session_date_et").alias("session_date"), pick("close", 1).alias("close"),
        *[pick("close", k + 1).alias(f"_c{k}") for k in (5, 15, 30)],
        ratio(F.sum(typical * F.col("volume")), F.sum("volume")).alias("vwap"), pick("_v15", 1).alias("volume_15m"),
        F.percentile(F.when(F.col("_back") > 1, F.col("_v15")), F.lit(0.5)).alias("_base"),
        F.max(F.when(opening, F.col("high"))).alias("opening_range_high"), F.min(F.when(opening, F.col("low"))).alias("opening_range_low"))
    g = g.withColumns({
        "dist_vwap": ratio("close", "vwap") - 1, **{f"return_{k}m": ratio("close", f"_c{k}") - 1 for k in (5, 15, 30)},
        "volume_burst_15m": ratio("volume_15m", "_base"),
        "above_opening_range": F.coalesce(F.col("close") > F.col("opening_range_high"), F.lit(False)),
        "below_opening_range": F.coalesce(F.col("close") < F.col("opening_range_low"), F.lit(False))}).drop("_c5", "_c15", "_c30", "_base")
    up, ret, burst = F.col("dist_vwap") > 0, F.col("return_15m"), F.col("volume_burst_15m")
    return g.withColumn("confirmation_signal", F.when(up & (ret > 0) & (burst >= 1.2) & F.col("above_opening_range"), "bullish_breakout_confirmation")
                        .when(up & (ret > 0) & (burst >= 1.0), "bullish_vwap_confirmation")
                        .when((F.col("dist_vwap") < 0) & (ret < 0) & (burst >= 1.0), "bearish_pressure")
                        .when(up & (ret >= 0), "constructive_above_vwap").otherwise("neutral"))
