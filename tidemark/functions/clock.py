"""Time-of-day, calendar and availability expressions (all instants are UTC)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ET = "America/New_York"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def et(ts) -> Column:
    """Wall-clock New York time of an instant."""
    return F.from_utc_timestamp(_c(ts), ET)


def et_date(ts) -> Column:
    return F.to_date(et(ts))


def et_minute(ts) -> Column:
    return (F.hour(et(ts)) * 60 + F.minute(et(ts))).cast("int")


def slot(ts, bar_minutes: int, open_minute: int = 570) -> Column:
    """Index of the bar in the regular session; negative before the open."""
    return F.floor((et_minute(ts) - open_minute) / bar_minutes).cast("int")


def next_weekday(day) -> Column:
    d = _c(day)
    dow = F.dayofweek(d)  # 1 = Sunday ... 7 = Saturday
    return F.date_add(d, F.when(dow == 6, 3).when(dow == 7, 2).otherwise(1))


def feature_date(ts) -> Column:
    """Trading date an item can first influence: after 16:00 ET or on a weekend, the next weekday."""
    day, local = et_date(ts), et(ts)
    seconds = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    micro = F.unix_micros(local) % 1_000_000
    late = (seconds > 57_600) | ((seconds == 57_600) & (micro > 0))
    weekend = F.dayofweek(day).isin(1, 7)
    return F.when(late | weekend, next_weekday(day)).otherwise(day)


def time_bucket(ts) -> Column:
    local = et(ts)
    seconds = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    micro = F.unix_micros(local) % 1_000_000
    return (
        F.when(seconds < 34_200, "pre_market")
        .when((seconds < 57_600) | ((seconds == 57_600) & (micro == 0)), "intraday")
        .otherwise("after_hours")
    )


def et_instant(day, minutes: int = 0) -> Column:
    """UTC instant of a New York wall-clock time on a date."""
    return F.to_utc_timestamp(_c(day).cast("timestamp") + F.expr(f"interval {minutes} minutes"), ET)


def strict_instant(text) -> Column:
    """Parse only strings that carry a zone; naive or malformed input becomes null."""
    t = F.trim(_c(text))
    return F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(t))


def latest(*ts) -> Column:
    """Greatest non-null instant."""
    return F.greatest(*[_c(t) for t in ts])


def month_key(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def stride_offset(session, stride: int) -> Column:
    """Rotating decision offset of a session: proleptic ordinal of the date modulo the stride."""
    return F.pmod(F.datediff(_c(session), F.lit("0001-01-01").cast("date")) + 1, F.lit(stride))


def market_sessions(spark_df_dates: DataFrame, date: str, early_close: dict[str, int] | None = None) -> DataFrame:
    """Weekday session table (09:30-16:00 ET) for the span of ``date``; a real calendar can replace it.

    ``early_close`` maps ISO date -> closing minute of day.
    """
    span = spark_df_dates.agg(F.min(date).alias("a"), F.max(date).alias("z"))
    days = span.select(F.explode(F.sequence("a", "z")).alias("session_date")).where(
        ~F.dayofweek("session_date").isin(1, 7))
    close = F.lit(960)
    for iso, minute in (early_close or {}).items():
        close = F.when(F.col("session_date") == F.lit(iso).cast("date"), F.lit(minute)).otherwise(close)
    wall = lambda m: F.to_utc_timestamp(
        F.col("session_date").cast("timestamp") + F.make_dt_interval(mins=m), ET)
    days = days.withColumns({"open_utc": wall(F.lit(570)), "close_utc": wall(close)})
    # one row per calendar day: a single ordered pass is bounded by the calendar
    w = Window.partitionBy(F.lit(0)).orderBy("session_date")
    return days.withColumns({
        "next_open_utc": F.lead("open_utc").over(w), "session_ordinal": F.row_number().over(w).cast("long")})


def bar_grid(sessions: DataFrame, step_minutes: int) -> DataFrame:
    """Every bar start of every session: open, open+step, ... , close-step."""
    step = F.expr(f"interval {step_minutes} minutes")
    return sessions.select("session_date", F.explode(F.sequence(F.col("open_utc"), F.col("close_utc") - step, step)).alias("bar_start"))


def horizon_bars(name) -> Column:
    """Number of bars in a target name such as ``target_up_12b``; null when absent."""
    return F.nullif(F.regexp_extract(_c(name), r"_(\d+)b", 1), F.lit("")).cast("int")


def horizon_minutes(text) -> Column:
    """``1h`` / ``90m`` / ``2d`` as minutes."""
    t = F.lower(F.trim(_c(text)))
    n = F.nullif(F.regexp_extract(t, r"^(\d+)[mhd]$", 1), F.lit("")).cast("int")
    return n * F.when(t.endswith("h"), 60).when(t.endswith("d"), 1440).otherwise(1)
