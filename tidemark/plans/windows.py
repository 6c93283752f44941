"""WIN queries: daily series on bars_supp, session series on bars_hour."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.clean import ratio
from tidemark.functions.clock import et_date, et_minute
from tidemark.operators import features as W
from tidemark.operators.ordered import frame, own
from tidemark.plans.fmt import n, r, s, us
from tidemark.plans.registry import query

KEY = ("ticker", "date")


def daily(v):
    return W.daily_windows(v.bars_supp)


def pick(df, *cols, longs=()):
    return df.select("ticker", s("date"), *[n(c) if c in longs else r(c) for c in cols])


_P = "PARTITION BY ticker ORDER BY date"
# base CTE of the daily oracles: lags and first differences
D = f"""q AS (SELECT *, row_number() OVER ({_P}) AS rn, lag(close) OVER ({_P}) AS pc FROM bars_supp),
 d AS (SELECT *, close / pc - 1 AS r1, CASE WHEN close - pc > 0 THEN close - pc WHEN pc IS NOT NULL THEN 0 END AS g,
   CASE WHEN close - pc < 0 THEN pc - close WHEN pc IS NOT NULL THEN 0 END AS l,
   greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM q)"""


def roll(fn: str, col: str, k: int, m: int, lo: int | None = None, hi: str = "CURRENT ROW") -> str:
    lo = k - 1 if lo is None else lo
    over = f"OVER ({_P} ROWS BETWEEN {lo} PRECEDING AND {hi})"
    return f"CASE WHEN count({col}) {over} >= {m} THEN {fn} {over} END"


def dsql(cols: str) -> str:
    return f"WITH {D} SELECT ticker, CAST(date AS VARCHAR) AS date, {cols} FROM d"


def daily_query(name, cols_sql, names, longs=(), doc=""):
    def fn(v):
        return pick(daily(v), *names, longs=longs)

    fn.__doc__ = doc
    query(name, dsql(cols_sql), ("bars_supp",))(fn)


daily_query("win_02", ", ".join([f"round(close / lag(close, {k}) OVER ({_P}) - 1, 6) AS return_{k}d" for k in (1, 5, 10, 20, 60)]),
            [f"return_{k}d" for k in (1, 5, 10, 20, 60)], doc="Horizon returns per ticker.")
daily_query("win_03", ", ".join([f"round({roll('stddev_samp(r1)', 'r1', k, k)}, 6) AS realized_vol_{k}d" for k in (10, 20, 60)]),
            [f"realized_vol_{k}d" for k in (10, 20, 60)], doc="Rolling sample volatility with minimum periods.")
query("win_04", f"""WITH {D}, m AS (SELECT *, {', '.join(f"{roll('avg(close)', 'close', k, k)} AS sma_{k}" for k in (20, 50, 200))} FROM d)
SELECT ticker, CAST(date AS VARCHAR) AS date, round(sma_20, 6) AS sma_20, round(close / sma_20 - 1, 6) AS dist_sma_20, round(close / sma_50 - 1, 6) AS dist_sma_50,
 round(close / sma_200 - 1, 6) AS dist_sma_200, round(sma_200 / lag(sma_200, 20) OVER ({_P}) - 1, 6) AS sma_200_slope_20d FROM m""", ("bars_supp",))(
    lambda v: pick(daily(v), "sma_20", "dist_sma_20", "dist_sma_50", "dist_sma_200", "sma_200_slope_20d"))
daily_query("win_05", f"""round({roll('max(high)', 'high', 20, 5)}, 6) AS recent_high_20, round({roll('min(low)', 'low', 20, 5)}, 6) AS recent_low_20,
 round({roll('max(high)', 'high', 20, 5, 20, '1 PRECEDING')}, 6) AS prior_high_20, round({roll('min(low)', 'low', 20, 5, 20, '1 PRECEDING')}, 6) AS prior_low_20,
 round(close / ({roll('max(close)', 'close', 252, 20)}) - 1, 6) AS pct_from_52w_high, round(close / ({roll('min(close)', 'close', 252, 20)}) - 1, 6) AS pct_from_52w_low""",
            ["recent_high_20", "recent_low_20", "prior_high_20", "prior_low_20", "pct_from_52w_high", "pct_from_52w_low"], doc="Rolling extremes with and without the current row.")
daily_query("win_06", f"round(volume / nullif({roll('quantile_cont(volume, 0.5)', 'volume', 20, 5, 20, '1 PRECEDING')}, 0), 6) AS volume_burst_20bar",
            ["volume_burst_20bar"], doc="Volume against the median of the prior 20 bars.")
query("win_12", f"""WITH {D}, m AS (SELECT *, {roll('avg(g)', 'g', 14, 14)} AS ag, {roll('avg(l)', 'l', 14, 14)} AS al FROM d)
SELECT ticker, CAST(date AS VARCHAR) AS date, round(100 - 100 / (1 + ag / nullif(al, 0)), 6) AS rsi_14,
 round(CASE WHEN al = 0 AND ag > 0 THEN 100 WHEN al = 0 AND ag = 0 THEN 50 ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END, 6) AS rsi_14_edges FROM m""", ("bars_supp",))(
    lambda v: daily(v).select("ticker", s("date"), r("rsi_14"), r(W.rsi("_ag", "_al", edges=True), "rsi_14_edges")))
daily_query("win_13", f"round(tr, 6) AS true_range, round({roll('avg(tr)', 'tr', 14, 14)}, 6) AS atr_14, round({roll('avg(tr)', 'tr', 14, 14)} / close, 6) AS atr_pct_14",
            ["true_range", "atr_14", "atr_pct_14"], doc="True range and rolling ATR.")
daily_query("win_19", """round((high - low) / pc, 6) AS range_pct, round((close - low) / nullif(high - low, 0), 6) AS close_location, round(close / open - 1, 6) AS intraday_return,
 round(ln(1 + close * volume), 6) AS dollar_volume_log, round(open / pc - 1, 6) AS gap_return""", ["range_pct", "close_location", "intraday_return", "dollar_volume_log", "gap_return"],
            doc="Range, close location, intraday return, log dollar volume, gap.")
daily_query("win_20", f"""round((volume - ({roll('avg(volume)', 'volume', 20, 20)})) / nullif({roll('stddev_samp(volume)', 'volume', 20, 20)}, 0), 6) AS volume_z20,
 round(volume / ({roll('avg(volume)', 'volume', 20, 20)}), 6) AS volume_ratio_20""", ["volume_z20", "volume_ratio_20"], doc="Volume z-score and ratio.")

@query("win_21", dsql(f"""round((close - ({roll('max(high)', 'high', 20, 5)})) / nullif({roll('avg(tr)', 'tr', 14, 14)}, 0), 6) AS dist_recent_high_atr,
 round((close - ({roll('min(low)', 'low', 20, 5)})) / nullif({roll('avg(tr)', 'tr', 14, 14)}, 0), 6) AS dist_recent_low_atr"""), ("bars_supp",))
def win_21(v):
    """Distance to the recent high and low in ATR units."""
    return daily(v).select("ticker", s("date"), r(ratio(F.col("close") - F.col("recent_high_20"), "atr_14"), "dist_recent_high_atr"),
                           r(ratio(F.col("close") - F.col("recent_low_20"), "atr_14"), "dist_recent_low_atr"))


daily_query("win_22", "rn AS bar_count", ["bar_count"], ["bar_count"], "Running bar count per ticker.")

# --- exponential means: the oracle runs the recursion row by row -----------------------------------------
_EWM = f"""{D},
 e AS (
  SELECT ticker, date, rn, close, pc, close AS ema_10, close AS ema_20, close AS ema_50, close AS e12, close AS e26, tr AS atr, CAST(NULL AS DOUBLE) AS ag, CAST(NULL AS DOUBLE) AS al,
    CAST(0 AS DOUBLE) AS sig FROM d WHERE rn = 1
  UNION ALL
  SELECT d.ticker, d.date, d.rn, d.close, d.pc, 2/11.0::DOUBLE * d.close + 9/11.0::DOUBLE * e.ema_10, 2/21.0::DOUBLE * d.close + 19/21.0::DOUBLE * e.ema_20,
    2/51.0::DOUBLE * d.close + 49/51.0::DOUBLE * e.ema_50, 2/13.0::DOUBLE * d.close + 11/13.0::DOUBLE * e.e12, 2/27.0::DOUBLE * d.close + 25/27.0::DOUBLE * e.e26,
    d.tr / 14 + e.atr * 13 / 14, CASE WHEN d.rn = 2 THEN d.g ELSE d.g / 14 + e.ag * 13 / 14 END, CASE WHEN d.rn = 2 THEN d.l ELSE d.l / 14 + e.al * 13 / 14 END,
    0.2::DOUBLE * ((2/13.0::DOUBLE * d.close + 11/13.0::DOUBLE * e.e12) - (2/27.0::DOUBLE * d.close + 25/27.0::DOUBLE * e.e26)) + 0.8::DOUBLE * e.sig
  FROM e JOIN d ON d.ticker = e.ticker AND d.rn = e.rn + 1)"""


def ewm_query(name, cols, select, doc):
    def fn(v):
        d = W.exponential(daily(v).select("ticker", "date", "close", "high", "low", "prior_close", "_rn"))
        return select(d)

    fn.__doc__ = doc
    query(name, f"WITH RECURSIVE {_EWM} SELECT ticker, CAST(date AS VARCHAR) AS date, {cols} FROM e", ("bars_supp",))(fn)


ewm_query("win_09", "round(ema_10, 6) AS ema_10, round(ema_20, 6) AS ema_20, round(ema_50, 6) AS ema_50, round(close / ema_50 - 1, 6) AS dist_ema_50",
          lambda d: d.select("ticker", s("date"), r("ema_10"), r("ema_20"), r("ema_50"), r(F.col("close") / F.col("ema_50") - 1, "dist_ema_50")),
          "Exponential means by exact recursion.")
ewm_query("win_10", "round(e12 - e26, 4) AS macd, round(sig, 4) AS macd_signal, round(e12 - e26 - sig, 4) AS macd_histogram",
          lambda d: d.select("ticker", s("date"), *[r(c, digits=4) for c in ("macd", "macd_signal", "macd_histogram")]), "MACD, signal and histogram.")
ewm_query("win_11", "round(CASE WHEN al = 0 AND ag > 0 THEN 100 WHEN al = 0 AND ag = 0 THEN 50 ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END, 6) AS rsi_14_wilder",
          lambda d: pick(d, "rsi_14_wilder"), "Wilder RSI with edge rules.")
ewm_query("win_13w", "round(atr, 6) AS atr_14_wilder, round(atr / close, 6) AS atr_pct", lambda d: d.select(
    "ticker", s("date"), r("atr_14_wilder"), r(F.col("atr_14_wilder") / F.col("close"), "atr_pct")), "Wilder ATR.")

_SETUP_SQL = f"""WITH RECURSIVE {_EWM}, z AS (SELECT e.*, d.high, d.low, d.volume, d.tr, d.open, lag(e.ema_10) OVER w AS prior_ema_10, lag(e.e12 - e.e26 - e.sig) OVER w AS prior_hist,
   lag(e.close) OVER w AS prior_close, lag(e.close, 3) OVER w AS c3, lag(e.close, 6) OVER w AS c6,
   CASE WHEN count(d.volume) OVER w20 >= 20 THEN (d.volume - avg(d.volume) OVER w20) / nullif(stddev_samp(d.volume) OVER w20, 0) END AS vz,
   CASE WHEN count(d.volume) OVER p20 >= 5 THEN d.volume / nullif(quantile_cont(d.volume, 0.5) OVER p20, 0) END AS burst,
   CASE WHEN count(d.tr) OVER w14 >= 14 THEN avg(d.tr) OVER w14 END AS atr14
  FROM e JOIN d USING (ticker, date) WINDOW w AS (PARTITION BY e.ticker ORDER BY e.date), w20 AS (PARTITION BY e.ticker ORDER BY e.date ROWS 19 PRECEDING),
   p20 AS (PARTITION BY e.ticker ORDER BY e.date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), w14 AS (PARTITION BY e.ticker ORDER BY e.date ROWS 13 PRECEDING))"""


def setups(v):
    d = W.exponential(daily(v))
    b = W.blocks(d, "date", back=8)
    w = frame(["ticker"])
    return own(b.withColumns({"prior_ema_10": F.lag("ema_10").over(w), "prior_hist": F.lag("macd_histogram").over(w),
                              "c3": F.lag("close", 3).over(w), "c6": F.lag("close", 6).over(w)}))


def flag(c):
    return F.coalesce(c, F.lit(False)).cast("long")


@query("win_25", _SETUP_SQL + """ SELECT ticker, CAST(date AS VARCHAR) AS date, round(prior_close, 6) AS prior_close, round(prior_ema_10, 6) AS prior_ema_10,
 round(prior_hist, 6) AS prior_macd_histogram, CAST(coalesce(e12 - e26 - sig > prior_hist, false) AS BIGINT) AS macd_improving,
 CAST(ema_10 > ema_20 AS BIGINT) AS ema10_gt_ema20, CAST(ema_20 > ema_50 AS BIGINT) AS ema20_gt_ema50 FROM z""", ("bars_supp",))
def win_25(v):
    """Prior-row states, MACD improvement and mean ordering."""
    d = setups(v)
    return d.select("ticker", s("date"), r("prior_close"), r("prior_ema_10"), r("prior_hist", "prior_macd_histogram"),
                    flag(F.col("macd_histogram") > F.col("prior_hist")).alias("macd_improving"),
                    flag(F.col("ema_10") > F.col("ema_20")).alias("ema10_gt_ema20"), flag(F.col("ema_20") > F.col("ema_50")).alias("ema20_gt_ema50"))


@query("win_27", _SETUP_SQL + """ SELECT ticker, CAST(date AS VARCHAR) AS date, round(close / c3 - 1 - (close / c6 - 1) / 2, 6) AS return_acceleration_3v6,
 CAST(coalesce(burst >= 1.3, false) AS BIGINT) + CAST(coalesce(vz >= 0.5, false) AS BIGINT) + CAST(close > ema_20 AS BIGINT) + CAST(ema_10 > ema_20 AS BIGINT)
 + CAST(coalesce(e12 - e26 - sig > prior_hist, false) AS BIGINT) + CAST(coalesce(close > open, false) AS BIGINT) + CAST(coalesce(close / prior_close - 1 > 0.05, false) AS BIGINT)
 + CAST(coalesce(close / c3 - 1 > 0, false) AS BIGINT) AS setup_candidate_score FROM z""", ("bars_supp",))
def win_27(v):
    """Setup score: sum of eight boolean signals; return acceleration."""
    d = setups(v)
    c = F.col
    r3, r6 = c("close") / c("c3") - 1, c("close") / c("c6") - 1
    score = sum(flag(x) for x in (c("volume_burst_20bar") >= 1.3, W.z_reaches("volume_z20", "volume", "volume_sum_20", "volume_squares_20", 20, 0.5), c("close") > c("ema_20"), c("ema_10") > c("ema_20"),
                                  c("macd_histogram") > c("prior_hist"), c("close") > c("open"), c("return_1d") > 0.05, r3 > 0))
    return d.select("ticker", s("date"), r(r3 - r6 / 2, "return_acceleration_3v6"), score.alias("setup_candidate_score"))


@query("win_28", dsql(f"""round(1.0::DOUBLE * ({roll('avg(tr)', 'tr', 14, 14)}) / close, 6) AS setup_stop_pct, round(1.5::DOUBLE * ({roll('avg(tr)', 'tr', 14, 14)}) / close, 6) AS setup_target_pct,
 round(CASE WHEN ({roll('avg(tr)', 'tr', 14, 14)}) > 0 THEN 1.5::DOUBLE END, 6) AS risk_reward"""), ("bars_supp",))
def win_28(v):
    """Stop and target distance from ATR and their ratio."""
    d = daily(v).withColumns({"stop": F.col("atr_14") / F.col("close"), "target": 1.5 * F.col("atr_14") / F.col("close")})
    return d.select("ticker", s("date"), r("stop", "setup_stop_pct"), r("target", "setup_target_pct"), r(ratio("target", "stop"), "risk_reward"))


@query("win_29", _SETUP_SQL + """ SELECT ticker, CAST(date AS VARCHAR) AS date, round(atr14, 6) AS atr_14, round(ema_20, 6) AS ema_20, round(vz, 6) AS volume_z20, round(e12 - e26, 4) AS macd FROM z""", ("bars_supp",))
def win_29(v):
    """Price-feature bundle: rolling and exponential features of one series together."""
    return W.exponential(daily(v)).select("ticker", s("date"), r("atr_14"), r("ema_20"), r("volume_z20"), r("macd", digits=4))


@query("win_30", """WITH b AS (SELECT *, low AS bid, high AS ask, volume * 3 AS bid_size, volume + 7 AS ask_size, volume - 1 AS trade_count FROM bars_user),
 k AS (SELECT *, bid > 0 AND ask >= bid AND trade_count > 0 AS ok FROM b)
SELECT ticker, CAST(date AS VARCHAR) AS date, CAST(ok AS BIGINT) AS microstructure_available, round(CASE WHEN ok THEN (ask - bid) / ((ask + bid) / 2) END, 6) AS spread_pct,
 round(CASE WHEN ok THEN (bid_size - ask_size) / (bid_size + ask_size) END, 6) AS quote_imbalance, round(CASE WHEN ok THEN volume / trade_count END, 6) AS average_trade_size FROM k""", ("bars_user",))
def win_30(v):
    """Microstructure features, null where the quote is not valid."""
    b = v.bars_user.withColumns({"bid": F.col("low"), "ask": F.col("high"), "bid_size": F.col("volume") * 3, "ask_size": F.col("volume") + 7, "trade_count": F.col("volume") - 1})
    out = b.withColumns(W.microstructure())
    return out.select("ticker", s("date"), n("microstructure_available"), r("spread_pct"), r("quote_imbalance"), r("average_trade_size"))


# --- session series ----------------------------------------------------------------------------------------
_SP = "PARTITION BY ticker, session_date_et ORDER BY timestamp"


def hourly(v):
    return W.session_windows(v.bars_hour)


def hpick(df, *cols, longs=()):
    return df.select("ticker", us("timestamp"), *[n(c) if c in longs else r(c) for c in cols])


def hsql(cols: str, pre: str = "", frm: str = "bars_hour") -> str:
    return f"{pre} SELECT ticker, epoch_us(timestamp) AS timestamp, {cols} FROM {frm}"


query("win_01", hsql(", ".join(f"round(close / nullif(lag(close, {k}) OVER ({_SP}), 0) - 1, 6) AS return_{k}bar" for k in (1, 3, 6, 12))), ("bars_hour",))(
    lambda v: hpick(hourly(v), *[f"return_{k}bar" for k in (1, 3, 6, 12)]))

_S1 = f"WITH x AS (SELECT *, close / nullif(lag(close) OVER ({_SP}), 0) - 1 AS r1, (high + low + close) / 3 * volume AS pv FROM bars_hour)"
query("win_03s", hsql(", ".join(
    f"round(CASE WHEN count(r1) OVER ({_SP} ROWS {k - 1} PRECEDING) >= {max(2, k // 2)} THEN stddev_samp(r1) OVER ({_SP} ROWS {k - 1} PRECEDING) END, 6) AS volatility_{k}bar"
    for k in (3, 6, 12)), _S1, "x"), ("bars_hour",))(lambda v: hpick(hourly(v), "volatility_3bar", "volatility_6bar", "volatility_12bar"))

query("win_07", hsql("""round(CASE WHEN count(volume) OVER w >= 3 THEN volume / nullif(quantile_cont(volume, 0.5) OVER w, 0) END, 6) AS relative_volume_same_minute_20d""") +
      " WINDOW w AS (PARTITION BY ticker, minute_et ORDER BY timestamp ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)", ("bars_hour",))(
    lambda v: hpick(W.same_minute_relative_volume(v.bars_hour), "relative_volume_same_minute_20d"))

_VW = f"""{_S1}, y AS (SELECT *, sum(pv) OVER w / nullif(sum(volume) OVER w, 0) AS vwap, max(CASE WHEN minute_et BETWEEN 570 AND 600 THEN high END) OVER w AS oh,
 min(CASE WHEN minute_et BETWEEN 570 AND 600 THEN low END) OVER w AS ol, max(CASE WHEN minute_et BETWEEN 240 AND 569 THEN high END) OVER w AS ph,
 min(CASE WHEN minute_et BETWEEN 240 AND 569 THEN low END) OVER w AS pl FROM x WINDOW w AS ({_SP} ROWS UNBOUNDED PRECEDING))"""
query("win_14", hsql(f"""round(vwap, 6) AS session_vwap, round(close / vwap - 1, 6) AS dist_session_vwap,
 round(vwap / lag(vwap, 3) OVER ({_SP}) - 1, 6) AS session_vwap_slope_3bar, round(vwap / lag(vwap, 6) OVER ({_SP}) - 1, 6) AS session_vwap_slope_6bar""", _VW, "y"), ("bars_hour",))(
    lambda v: hpick(hourly(v), "session_vwap", "dist_session_vwap", "session_vwap_slope_3bar", "session_vwap_slope_6bar"))
query("win_15", hsql("""round(oh, 6) AS opening_range_high, round(ol, 6) AS opening_range_low, round((oh - ol) / close, 6) AS opening_range_width_pct,
 round(close / oh - 1, 6) AS dist_opening_range_high, round(close / nullif(ol, 0) - 1, 6) AS dist_opening_range_low,
 CAST(coalesce(close > oh, false) AS BIGINT) AS above_opening_range, CAST(coalesce(close < ol, false) AS BIGINT) AS below_opening_range""", _VW, "y"), ("bars_hour",))(
    lambda v: hpick(hourly(v), "opening_range_high", "opening_range_low", "opening_range_width_pct", "dist_opening_range_high", "dist_opening_range_low",
                    "above_opening_range", "below_opening_range", longs=("above_opening_range", "below_opening_range")))
query("win_16", hsql("round((ph - pl) / close, 6) AS premarket_range_pct", _VW, "y"), ("bars_hour",))(lambda v: hpick(hourly(v), "premarket_range_pct"))
_PROG = "greatest(0, least(1, (minute_et - 570) / 390.0::DOUBLE))"
query("win_18", hsql(f"""round({_PROG}, 6) AS session_progress, round(sin(2 * pi() * {_PROG}), 6) AS session_minute_sin, round(cos(2 * pi() * {_PROG}), 6) AS session_minute_cos,
 CAST(minute_et BETWEEN 570 AND 629 AS BIGINT) AS is_opening, CAST(minute_et BETWEEN 690 AND 809 AS BIGINT) AS is_midday, CAST(minute_et BETWEEN 900 AND 960 AS BIGINT) AS is_power_hour"""), ("bars_hour",))(
    lambda v: hpick(hourly(v), "session_progress", "session_minute_sin", "session_minute_cos", "is_opening", "is_midday", "is_power_hour",
                    longs=("is_opening", "is_midday", "is_power_hour")))


@query("win_17", """WITH g AS (SELECT ticker, session_date_et, arg_min(open, timestamp) AS o, arg_max(close, timestamp) AS c FROM bars_hour WHERE minute_et >= 570 GROUP BY 1, 2),
 l AS (SELECT *, o / lag(c) OVER (PARTITION BY ticker ORDER BY session_date_et) - 1 AS gap FROM g)
SELECT b.ticker, epoch_us(b.timestamp) AS timestamp, round(CASE WHEN b.minute_et >= 570 THEN l.gap END, 6) AS overnight_gap FROM bars_hour b LEFT JOIN l USING (ticker, session_date_et)""", ("bars_hour",))
def win_17(v):
    """Overnight gap on regular rows: session open over prior session close."""
    reg = F.col("minute_et") >= 570
    g = W.session_summary(v.bars_hour, regular=reg).select("ticker", "session_date_et", "overnight_gap")
    out = v.bars_hour.join(g, ["ticker", "session_date_et"], "left")
    return out.select("ticker", us("timestamp"), r(F.when(reg, F.col("overnight_gap")), "overnight_gap"))


@query("win_08", """WITH m AS (SELECT upper(event_type) AS ticker, date_trunc('minute', ts) AS ts, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2),
 d AS (SELECT *, CAST(ts AS DATE) AS day FROM m),
 a AS (SELECT *, sum(volume) OVER (PARTITION BY ticker, day ORDER BY ts ROWS 14 PRECEDING) AS v15 FROM d)
SELECT ticker, epoch_us(ts) AS ts, v15 AS volume_15, round(v15 / nullif(CASE WHEN count(v15) OVER w >= 15 THEN quantile_cont(v15, 0.5) OVER w END, 0), 6) AS volume_burst FROM a
WINDOW w AS (PARTITION BY ticker, day ORDER BY ts ROWS 119 PRECEDING)""")
def win_08(v):
    """Rolling 15-bar volume against its rolling median (120), per ticker and day of minute bars."""
    m = v.t("events").groupBy(F.upper("event_type").alias("ticker"), F.date_trunc("minute", "ts").alias("ts")).agg(
        F.count(F.lit(1)).cast("double").alias("volume")).withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("ticker", "day").orderBy("ts")
    a = m.withColumn("v15", F.sum("volume").over(w.rowsBetween(-14, 0)))
    base = W.guarded(F.percentile("v15", F.lit(0.5)), "v15", w.rowsBetween(-119, 0), 15)
    return a.select("ticker", us("ts"), F.col("v15").alias("volume_15"), r(ratio("v15", base), "volume_burst"))


@query("win_23", """WITH b AS (SELECT *, (epoch_us(bar_start) // 3600000000) % 24 AS slot, (epoch_us(bar_start) // 3600000000) AS ord FROM bars_hour),
 t AS (SELECT *, row_number() OVER w AS rn, CASE WHEN ord - lag(ord) OVER w = 1 AND (slot = lag(slot) OVER w + 1 OR (slot = 0 AND lag(slot) OVER w = 23)) THEN 1 ELSE 0 END AS ok
   FROM b WINDOW w AS (PARTITION BY ticker ORDER BY bar_start))
SELECT ticker, epoch_us(timestamp) AS timestamp, CAST(ok AS BIGINT) AS transition_valid,
 CAST(CASE WHEN count(ok) OVER (PARTITION BY ticker ORDER BY bar_start ROWS 4 PRECEDING) = 5 AND min(ok) OVER (PARTITION BY ticker ORDER BY bar_start ROWS 4 PRECEDING) = 1 THEN 1 ELSE 0 END AS BIGINT) AS exact_history FROM t""", ("bars_hour",))
def win_23(v):
    """Grid-transition validity and 'last five transitions all valid'."""
    hours = F.floor(F.unix_micros("bar_start") / 3_600_000_000)
    d = W.blocks(v.bars_hour.withColumns({"slot": F.pmod(hours, F.lit(24)), "ord": hours}), "bar_start", back=8)
    w = frame(["ticker"])
    step = (F.col("ord") - F.lag("ord").over(w) == 1) & ((F.col("slot") == F.lag("slot").over(w) + 1) | ((F.col("slot") == 0) & (F.lag("slot").over(w) == 23)))
    d = d.withColumn("ok", flag(step))
    five = frame(["ticker"], -4, 0)
    d = own(d.withColumn("exact", flag((F.count("ok").over(five) == 5) & (F.min("ok").over(five) == 1))))
    return d.select("ticker", us("timestamp"), n("ok", "transition_valid"), n("exact", "exact_history"))


@query("win_24", f"""{_S1}, a AS (SELECT *, CASE WHEN count(r1) OVER w >= 6 THEN stddev_samp(r1) OVER w END AS vol FROM x WHERE ticker = 'CLICK' WINDOW w AS (PARTITION BY session_date_et ORDER BY timestamp ROWS UNBOUNDED PRECEDING)),
 b AS (SELECT *, CASE WHEN count(vol) OVER w >= 6 THEN quantile_cont(vol, 0.5) OVER w END AS thr FROM a WINDOW w AS (PARTITION BY session_date_et ORDER BY timestamp ROWS UNBOUNDED PRECEDING))
SELECT epoch_us(timestamp) AS timestamp, round(vol, 6) AS expanding_volatility, CAST(coalesce(vol > thr, false) AS BIGINT) AS regime_high_volatility FROM b""", ("bars_hour",))
def win_24(v):
    """Expanding std against its expanding median within the session."""
    q = hourly(v).where("ticker = 'CLICK'")
    out = W.expanding_volatility_regime(q, "return_1bar", "timestamp")
    return out.select(us("timestamp"), r("expanding_volatility"), n("regime_high_volatility"))


@query("win_26", """SELECT ticker, count(*) FILTER (WHERE g > 3600000000) AS gaps FROM
 (SELECT ticker, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY ticker, session_date_et ORDER BY timestamp) AS g FROM bars_hour) GROUP BY 1""", ("bars_hour",))
def win_26(v):
    """Within-session gaps larger than the bar interval."""
    w = Window.partitionBy("ticker", "session_date_et").orderBy("timestamp")
    gap = F.unix_micros("timestamp") - F.unix_micros(F.lag("timestamp").over(w))
    return v.bars_hour.withColumn("g", gap).groupBy("ticker").agg(F.count_if(F.col("g") > 3_600_000_000).alias("gaps"))


@query("win_32", f"""{_S1} SELECT ticker, epoch_us(timestamp) AS timestamp, round(r1, 6) AS return_1bar, round(close / nullif(lag(close, 3) OVER ({_SP}), 0) - 1, 6) AS return_3bar,
 round(CASE WHEN count(r1) OVER ({_SP} ROWS 11 PRECEDING) >= 4 THEN stddev_samp(r1) OVER ({_SP} ROWS 11 PRECEDING) END, 6) AS volatility_12bar FROM x WHERE ticker IN ('CLICK', 'VIEW')""", ("bars_hour",))
def win_32(v):
    """Benchmark series: session returns and 12-bar volatility (minimum 4)."""
    b = v.bars_hour.where(F.col("ticker").isin("CLICK", "VIEW"))
    w = Window.partitionBy("ticker", "session_date_et").orderBy("timestamp")
    d = b.withColumns({"return_1bar": ratio("close", F.lag("close").over(w)) - 1, "return_3bar": ratio("close", F.lag("close", 3).over(w)) - 1})
    d = d.withColumn("volatility_12bar", W.guarded(F.stddev_samp("return_1bar"), "return_1bar", w.rowsBetween(-11, 0), 4))
    return hpick(d, "return_1bar", "return_3bar", "volatility_12bar")


def minute_bars(v):
    ev = v.t("events").withColumns({"ticker": F.upper("event_type"), "timestamp": F.date_trunc("minute", "ts")})
    from tidemark.sources.views import bars

    b = bars(ev, ["ticker", "timestamp"], "value", F.count(F.lit(1)).cast("double"), ["ts", "event_id"])
    return b.withColumns({"session_date_et": et_date("timestamp"), "minute_et": et_minute("timestamp")})


CONFIRM_SQL = """m AS (SELECT upper(event_type) AS ticker, date_trunc('minute', ts) AS timestamp, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
   arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2),
 e AS (SELECT *, (timestamp AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS l FROM m),
 f AS (SELECT *, CAST(l AS DATE) AS sd, hour(l) * 60 + minute(l) AS mi FROM e), g AS (SELECT * FROM f WHERE mi BETWEEN 570 AND 960),
 h AS (SELECT * FROM g WHERE (ticker, sd) IN (SELECT (ticker, max(sd)) FROM g GROUP BY ticker)),
 i AS (SELECT *, sum(volume) OVER (PARTITION BY ticker ORDER BY timestamp ROWS 14 PRECEDING) AS v15, row_number() OVER (PARTITION BY ticker ORDER BY timestamp DESC) AS back FROM h),
 j AS (SELECT ticker, max(sd) AS sd, max(close) FILTER (WHERE back = 1) AS close, max(close) FILTER (WHERE back = 6) AS c5, max(close) FILTER (WHERE back = 16) AS c15, max(close) FILTER (WHERE back = 31) AS c30,
   sum((high + low + close) / 3 * volume) / nullif(sum(volume), 0) AS vwap, max(v15) FILTER (WHERE back = 1) AS v15, quantile_cont(v15, 0.5) FILTER (WHERE back > 1) AS base,
   max(high) FILTER (WHERE mi BETWEEN 570 AND 599) AS oh, min(low) FILTER (WHERE mi BETWEEN 570 AND 599) AS ol FROM i GROUP BY 1),
 c AS (SELECT *, close / vwap - 1 AS dv, close / c5 - 1 AS r5, close / c15 - 1 AS r15, close / c30 - 1 AS r30, v15 / nullif(base, 0) AS burst,
   coalesce(close > oh, false) AS above, coalesce(close < ol, false) AS below FROM j),
 cs AS (SELECT *, CASE WHEN dv > 0 AND r15 > 0 AND burst >= 1.2 AND above THEN 'bullish_breakout_confirmation' WHEN dv > 0 AND r15 > 0 AND burst >= 1 THEN 'bullish_vwap_confirmation'
   WHEN dv < 0 AND r15 < 0 AND burst >= 1 THEN 'bearish_pressure' WHEN dv > 0 AND r15 >= 0 THEN 'constructive_above_vwap' ELSE 'neutral' END AS sig FROM c)"""


@query("win_31", f"""WITH {CONFIRM_SQL} SELECT ticker, CAST(sd AS VARCHAR) AS session_date, close, round(vwap, 6) AS vwap, round(dv, 6) AS dist_vwap, round(r5, 6) AS return_5m, round(r15, 6) AS return_15m,
 round(r30, 6) AS return_30m, v15 AS volume_15m, round(burst, 6) AS volume_burst_15m, CAST(above AS BIGINT) AS above_opening_range, CAST(below AS BIGINT) AS below_opening_range, sig AS confirmation_signal FROM cs""")
def win_31(v):
    """Latest-session one-minute confirmation per ticker."""
    c = W.confirmation(minute_bars(v))
    return c.select("ticker", s("session_date"), "close", r("vwap"), r("dist_vwap"), r("return_5m"), r("return_15m"), r("return_30m"), "volume_15m",
                    r("volume_burst_15m"), n("above_opening_range"), n("below_opening_range"), "confirmation_signal")


@query("jon_22", f"""WITH {CONFIRM_SQL}, p AS (SELECT upper(source_family) AS ticker, round(avg(relevance), 9) AS prob FROM news GROUP BY 1),
 k AS (SELECT p.*, row_number() OVER (ORDER BY prob DESC, ticker) AS rk FROM p)
SELECT k.ticker, k.rk AS entry_model_rank, cs.sig AS confirmation_signal, t.c AS candidate_bars,
 CASE WHEN cs.sig = 'bearish_pressure' THEN 'avoid_entry_1m_bearish' WHEN rk <= 20 AND cs.sig IN ('bullish_breakout_confirmation', 'bullish_vwap_confirmation') THEN 'entry_watch_confirmed'
  WHEN rk <= 50 AND cs.sig IN ('bullish_breakout_confirmation', 'bullish_vwap_confirmation', 'constructive_above_vwap') THEN 'watch_for_entry'
  WHEN rk <= 20 AND prob >= 0 THEN 'model_positive_wait_for_1m_confirmation' ELSE 'neutral' END AS decision
FROM k LEFT JOIN cs USING (ticker) LEFT JOIN (SELECT ticker, count(*) AS c FROM bars_hour GROUP BY 1) t USING (ticker)""", ("news", "bars_hour"))
def jon_22(v):
    """Decision report: scores, latest one-minute confirmation and candidate metadata."""
    from tidemark.operators.signals import decision_label

    p = v.news.groupBy(F.upper("source_family").alias("ticker")).agg(F.round(F.avg("relevance"), 9).alias("prob"))
    ranked = p.withColumn("entry_model_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("prob"), "ticker")))
    meta = v.bars_hour.groupBy("ticker").agg(F.count(F.lit(1)).alias("candidate_bars"))
    out = ranked.join(W.confirmation(minute_bars(v)).select("ticker", "confirmation_signal"), "ticker", "left").join(meta, "ticker", "left")
    return out.select("ticker", n("entry_model_rank"), "confirmation_signal", "candidate_bars", decision_label("entry_model_rank", "prob", "confirmation_signal").alias("decision"))
