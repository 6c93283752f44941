"""Normalisation of tickers, numbers, bars, events and memberships."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import et_date, et_instant, et_minute
from tidemark.functions.ident import event_id, provider_event_id

# Accepted spellings of each bar size, and its minutes.
TIMEFRAMES = {
    "1m": ("1m", "1min", "1t", "1minute"), "5m": ("5m", "5min", "5t", "5minute"),
    "1h": ("1h", "60m", "60min", "1hour"), "1d": ("1d", "d", "day", "1day", "daily"),
}
TIMEFRAME_MINUTES = {"1m": 1, "5m": 5, "1h": 60}
FEEDS = ("sip", "alpaca_sip", "consolidated", "cta_utp", "iex")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def timeframe(value) -> Column:
    key = F.lower(F.trim(_c(value)))
    out = F.when(F.lit(False), "")
    for canon, spellings in TIMEFRAMES.items():
        out = out.when(key.isin(*spellings), canon)
    return out  # unknown spellings are null


def ticker(value) -> Column:
    t = F.replace(F.upper(F.trim(_c(value).cast("string"))), F.lit("/"), F.lit("."))
    return F.when(t.rlike(r"^[A-Z0-9.\-]{1,16}$"), t)


def canonical_symbol(value) -> Column:
    return F.replace(F.trim(F.upper(F.coalesce(_c(value), F.lit("")))), F.lit("."), F.lit("-"))


def provider_symbol(value, provider) -> Column:
    c, p = canonical_symbol(value), F.lower(F.trim(_c(provider)))
    return (
        F.when(p.isin("alpaca", "finviz", "seeking_alpha"), F.replace(c, F.lit("-"), F.lit(".")))
        .when(p == "sec", F.replace(c, F.lit("-"), F.lit(""))).otherwise(c)
    )


def number(value) -> Column:
    return _number(_c(value), ",")


def _number(c: Column, drop: str) -> Column:
    t = F.trim(F.regexp_replace(c.cast("string"), drop, ""))
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def percent(value) -> Column:
    return _number(_c(value), "[%]")


def market_cap_millions(value) -> Column:
    t = F.trim(F.regexp_replace(_c(value).cast("string"), ",", ""))
    unit = F.upper(F.right(t, F.lit(1)))
    scale = F.when(unit == "B", 1000.0).when(unit == "K", 0.001).otherwise(1.0)
    return _number(F.when(unit.isin("B", "M", "K"), F.regexp_replace(t, "(?i)[BMK]$", "")).otherwise(t), ",") * scale


def finite(value) -> Column:
    """NaN and infinities are missing."""
    v = _c(value).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v)


def ratio(a, b) -> Column:
    """a / b with a zero denominator as missing."""
    return F.try_divide(_c(a).cast("double"), F.nullif(_c(b).cast("double"), F.lit(0.0)))


def ieee_ratio(a, b) -> Column:
    """a / b as doubles divide: 0 / 0 is NaN, x / 0 is infinite (an error in Spark's own division)."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def first_number(df: DataFrame, names: Sequence[str], default: float | None = None) -> Column:
    """First present, non-null numeric column of the list."""
    present = [F.col(n).try_cast("double") for n in names if n in df.columns]
    return F.coalesce(*present, F.lit(default).cast("double")) if present else F.lit(default).cast("double")


def ohlcv_valid(o="open", h="high", l="low", c="close", v="volume") -> Column:  # noqa: E741
    o, h, l, c, v = map(_c, (o, h, l, c, v))  # noqa: E741
    return F.coalesce(
        (o > 0) & (h > 0) & (l > 0) & (c > 0) & (v >= 0) & (h >= F.greatest(o, c, l)) & (l <= F.least(o, c, h)), F.lit(False))


def canonical_bars(
    df: DataFrame, frame: str, feed: str = "sip", adjustment: str = "all", policy: str = "observed",
    sessions: DataFrame | None = None, delay_s: int = 30, daily_delay_s: int = 900,
) -> DataFrame:
    """Bars with interval end, availability and a validity flag.

    Input: ticker, bar_start (or date for daily bars), OHLCV, ingested_at.  Daily
    bars take their interval from ``sessions``; a date that is no session has a
    null interval and ``session_error``.
    """
    out = df.withColumns({"ticker": ticker("ticker"), "timeframe": F.lit(frame), "price_feed": F.lit(feed.lower()),
                          "adjustment": F.lit(adjustment)})
    if frame == "1d":
        cal = sessions.select(F.col("session_date").alias("date"), "open_utc", "close_utc")
        out = out.join(cal, "date", "left").withColumnsRenamed({"open_utc": "bar_start", "close_utc": "bar_end"})
        delay = daily_delay_s
    else:
        out = out.withColumn("bar_end", F.col("bar_start") + F.expr(f"interval {TIMEFRAME_MINUTES[frame]} minutes"))
        delay = delay_s
    ready = F.col("bar_end") + F.expr(f"interval {delay} seconds")
    available = F.greatest(ready, F.col("ingested_at")) if policy == "observed" else ready
    return out.withColumns({
        "available_at": available, "availability_policy": F.lit(policy), "session_error": F.col("bar_end").isNull(),
        "ohlcv_valid": ohlcv_valid(), "feed_known": F.lit(feed.lower() in FEEDS), "schema_version": F.lit("market_data.v1"),
    })


def canonical_events(df: DataFrame, policy: str = "observed") -> DataFrame:
    """Events with first-seen and availability times, clipped sentiment, raw hash and identity.

    Input: ticker, source, timestamp, title, url, raw (JSON), collected_at,
    sentiment_numeric, sentiment_scored_at.  JSON created/updated times override.
    One row per event id, the earliest first seen.
    """
    j = lambda p: F.nullif(F.trim(F.get_json_object("raw", p)), F.lit(""))
    from tidemark.functions.clock import strict_instant

    published = F.coalesce(strict_instant(j("$.created_at")), F.col("timestamp"))
    updated = strict_instant(j("$.updated_at"))
    content = F.greatest(published, updated)
    seen = F.col("collected_at")
    available = F.greatest(content, seen) if policy == "observed" else content
    out = df.withColumns({
        "published_at": published, "provider_updated_at": updated, "first_seen_at": seen, "available_at": available,
        "sentiment_numeric": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), finite("sentiment_numeric"))),
        "raw_sha256": F.sha2(F.coalesce("raw", F.lit("")), 256),
    })
    out = out.withColumns({
        "feature_available_at": F.when(F.col("sentiment_numeric").isNotNull(), F.greatest("available_at", "sentiment_scored_at"))
        .otherwise(F.col("available_at")),
        "event_id": event_id("ticker", "source", "published_at", "title", "url", provider_event_id("raw")),
        "availability_policy": F.lit(policy), "schema_version": F.lit("market_data.v1"),
    })
    whole = F.struct(*[c for c in out.columns if c != "event_id"])
    tie = F.struct("first_seen_at", "published_at", "raw_sha256")
    return out.groupBy("event_id").agg(F.min_by(whole, tie).alias("e")).select("event_id", "e.*")


def sanitize_events(df: DataFrame, now: Column, order: str) -> DataFrame:
    """Trim, default and deduplicate raw events; the reason a row is dropped is kept in ``verdict``.

    ``order`` is the input order column; the first of equal
    (ticker, timestamp, source, title, url) rows wins.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = df.withColumns({
        "ticker": F.trim(F.upper(empty("ticker"))), "source": F.trim(F.coalesce("source", F.lit("unknown"))),
        "title": empty("title"), "url": empty("url"), "summary": empty("summary"),
    }).withColumn("text", F.coalesce(F.nullif(empty("text"), F.lit("")), F.nullif("summary", F.lit("")), F.col("title")))
    score = [c for c in ("engagement_score", "engagement_comments", "engagement_upvote_ratio") if c in df.columns]
    out = out.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in score})
    bad = (F.col("ticker") == "") | F.col("timestamp").isNull() | (F.col("title") == "")
    keys = ["ticker", "timestamp", "source", "title", "url"]
    firsts = out.where(~bad).groupBy(*keys).agg(F.min(order).alias("_first"))
    on = [F.col(f"o.{k}") == F.col(f"f.{k}") for k in keys]
    joined = out.alias("o").join(firsts.alias("f"), [*on], "left").select("o.*", "_first")
    return joined.withColumn(
        "verdict",
        F.when(bad, "missing_required").when(F.col(order) != F.col("_first"), "duplicate")
        .when(F.col("timestamp") > now + F.expr("interval 5 minutes"), "future").otherwise("kept"),
    ).drop("_first")


def feature_bars(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Bars ready for features: typed, with session date, minute and group id."""
    return df.withColumns({
        "ticker": F.trim(F.upper("ticker")), **{c: F.col(c).try_cast("double") for c in ("open", "high", "low", "close", "volume")},
        "session_date_et": et_date(ts), "minute_et": et_minute(ts),
        "decision_group_id": F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX"),
    })


def regular_bars(df: DataFrame, minutes: int, ts: str = "bar_start", end: str = "bar_end") -> DataFrame:
    """Valid, aligned, exact-duration bars of the regular session with their slot."""
    m = et_minute(ts)
    exact = (F.unix_micros(end) - F.unix_micros(ts)) == minutes * 60_000_000
    return df.where(ohlcv_valid() & m.between(570, 959) & (F.pmod(m - 570, F.lit(minutes)) == 0) & exact).withColumns({
        "session_date_et": et_date(ts), "minute_et": m, "slot": F.floor((m - 570) / minutes).cast("int")})


def swing_cutoff(day) -> Column:
    """18:00 New York on the session date."""
    return et_instant(day, 1080)
