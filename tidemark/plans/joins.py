"""JON queries."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.clock import feature_date
from tidemark.operators import joins as J
from tidemark.operators.ordered import as_of
from tidemark.plans.fmt import n, r, s, us
from tidemark.plans.registry import query

FAMILIES = ("click", "error", "purchase", "signup", "view")
METRICS = ("urgent", "high", "medium", "not specified", "low")

_status_sql = ", ".join(
    f"coalesce(s_{f}.status, 'not_collected') AS source_status_{f}, coalesce(s_{f}.row_count, 0) AS source_observed_rows_{f}, "
    f"epoch_us(s_{f}.completed_at) AS source_status_available_at_{f}, epoch_us(s_{f}.requested_end) AS source_coverage_end_{f}"
    for f in FAMILIES)
_status_joins = " ".join(
    f"ASOF LEFT JOIN (SELECT * FROM one WHERE source_family = '{f}') s_{f} ON d.ticker = s_{f}.ticker AND d.decision_time >= s_{f}.completed_at"
    for f in FAMILIES)
_ONE = """one AS (SELECT * FROM collections QUALIFY row_number() OVER
    (PARTITION BY ticker, source_family, completed_at ORDER BY collection_id DESC) = 1)"""


@query("jon_01", f"""WITH {_ONE}
SELECT d.ticker, epoch_us(d.decision_time) AS decision_time, {_status_sql},
  epoch_us(greatest({', '.join(f's_{f}.completed_at' for f in FAMILIES)})) AS source_state_available_at
FROM decisions_user d {_status_joins}""", ("decisions_user", "collections"))
def jon_01(v):
    """Latest collection status per source family known at each decision."""
    out = J.source_status(v.decisions_user.select("ticker", "decision_time"), v.collections, FAMILIES)
    times = [c for c in out.columns if "_at" in c or "_end_" in c] + ["decision_time"]
    return out.withColumns({c: F.unix_micros(c) for c in dict.fromkeys(times) if not c.startswith("source_status_") or "available" in c})


@query("jon_02", """SELECT d.decision_id, d.ticker, """ + ", ".join(
    f"f{i}.value AS fundamental_{J._name(m)}, epoch_us(f{i}.available_at) AS fundamental_available_at_{J._name(m)}"
    for i, m in enumerate(METRICS)) + " FROM decisions_cust d " + " ".join(
    f"ASOF LEFT JOIN (SELECT * FROM facts WHERE metric = '{m}' QUALIFY row_number() OVER (PARTITION BY ticker, available_at ORDER BY fact_id DESC) = 1) f{i} "
    f"ON d.ticker = f{i}.ticker AND d.decision_time >= f{i}.available_at" for i, m in enumerate(METRICS)),
    ("decisions_cust", "facts"))
def jon_02(v):
    """Fundamental facts as of the decision, all metrics in one pass."""
    out = J.fundamentals(v.decisions_cust, v.facts, METRICS)
    return out.select("decision_id", "ticker", *[f"fundamental_{J._name(m)}" for m in METRICS],
                      *[us(f"fundamental_available_at_{J._name(m)}") for m in METRICS])


_MINUTE = """minute AS (SELECT ticker, m + INTERVAL 1 MINUTE + INTERVAL 30 SECOND AS available_at, close, volume
  FROM (SELECT upper(event_type) AS ticker, date_trunc('minute', ts) AS m, arg_max(value, (ts, event_id)) AS close,
        CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2))"""


def minute_rows(v):
    ev = v.t("events").groupBy(F.upper("event_type").alias("ticker"), F.date_trunc("minute", "ts").alias("m")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return ev.withColumn("available_at", F.col("m") + F.expr("interval 90 seconds"))


@query("jon_03", f"""WITH {_MINUTE}
SELECT b.ticker, epoch_us(b.available_at) AS decision_time, m.close AS one_minute_close, m.volume AS one_minute_volume,
  epoch_us(m.available_at) AS matched_at
FROM bars_hour b ASOF LEFT JOIN minute m ON b.ticker = m.ticker AND b.available_at >= m.available_at""", ("bars_hour",))
def jon_03(v):
    """Latest available one-minute row per hourly decision."""
    d = v.bars_hour.select("ticker", F.col("available_at").alias("decision_time"))
    out = J.latest_row(d, minute_rows(v), ["ticker"], "decision_time", "available_at", ["close", "volume"])
    return out.select("ticker", us("decision_time"), F.col("close").alias("one_minute_close"),
                      F.col("volume").alias("one_minute_volume"), us("matched_at"))


@query("jon_04", f"""WITH {_MINUTE}
SELECT b.ticker, epoch_us(b.available_at) AS decision_time,
  CASE WHEN m.available_at >= b.available_at - INTERVAL 4 MINUTE THEN m.close END AS one_minute_close,
  CASE WHEN m.available_at >= b.available_at - INTERVAL 4 MINUTE THEN epoch_us(m.available_at) END AS matched_at
FROM bars_hour b ASOF LEFT JOIN minute m ON b.ticker = m.ticker AND b.available_at >= m.available_at""", ("bars_hour",))
def jon_04(v):
    """As-of join with a four-minute tolerance."""
    d = v.bars_hour.select("ticker", F.col("available_at").alias("decision_time"))
    out = J.latest_row(d, minute_rows(v), ["ticker"], "decision_time", "available_at", ["close"], tolerance_s=240)
    return out.select("ticker", us("decision_time"), F.col("close").alias("one_minute_close"), us("matched_at"))


@query("jon_05", f"""WITH {_ONE}
SELECT d.ticker, epoch_us(d.decision_time) AS decision_time, """ + ", ".join(
    f"CAST(coalesce(s_{f}.status = 'observed', false) AS BIGINT) AS source_available_{f}, coalesce(s_{f}.row_count, 0) AS source_rows_{f}"
    for f in FAMILIES) + f" FROM decisions_user d {_status_joins}", ("decisions_user", "collections"))
def jon_05(v):
    """Latest source-availability record per family: flag and row count."""
    c = v.collections.withColumn("available", (F.col("status") == "observed").cast("long"))
    parts = {f: (F.col("source_family") == f, ["available", "row_count"]) for f in FAMILIES}
    out = as_of(v.decisions_user.select("ticker", "decision_time"), c, ["ticker"], "decision_time", "completed_at", parts, ["collection_id"])
    return out.select("ticker", us("decision_time"),
                      *[F.coalesce(F.col(f)["available"], F.lit(0)).cast("long").alias(f"source_available_{f}") for f in FAMILIES],
                      *[F.coalesce(F.col(f)["row_count"], F.lit(0)).cast("long").alias(f"source_rows_{f}") for f in FAMILIES])


_MEMBER_JOIN = """FROM decisions_cust d LEFT JOIN memberships m ON d.ticker = m.ticker AND d.decision_time >= m.effective_from
  AND d.decision_time >= m.available_at AND (m.effective_to IS NULL OR d.decision_time < m.effective_to)"""


def member_match(v, decisions):
    start = F.greatest("effective_from", "available_at")
    return J.interval_match(decisions, v.memberships, ["ticker"], "decision_time", start, F.col("effective_to"),
                            "snapshot_id", ["sector", "liquidity_bucket", F.col("snapshot_id").alias("universe_snapshot_id")])


@query("jon_06", f"""SELECT d.decision_id, d.ticker, epoch_us(d.decision_time) AS decision_time, count(m.snapshot_id) AS match_count,
  CASE WHEN count(m.snapshot_id) = 1 THEN max(m.sector) END AS sector,
  CASE WHEN count(m.snapshot_id) = 1 THEN max(m.liquidity_bucket) END AS liquidity_bucket,
  CASE WHEN count(m.snapshot_id) = 1 THEN max(m.snapshot_id) END AS universe_snapshot_id
{_MEMBER_JOIN} GROUP BY 1, 2, 3""", ("decisions_cust", "memberships"))
def jon_06(v):
    """Universe membership: half-open interval, knowledge time, zero/one/many matches reported."""
    return member_match(v, v.decisions_cust).select(
        "decision_id", "ticker", us("decision_time"), "match_count", "sector", "liquidity_bucket", "universe_snapshot_id")


@query("jon_07", f"""SELECT ticker, decision_time, max(decision_id) AS decision_id, arg_max(sector, decision_id) AS sector,
    arg_max(liquidity_bucket, decision_id) AS liquidity_bucket
FROM (SELECT d.decision_id, d.ticker, epoch_us(d.decision_time) AS decision_time, max(m.sector) AS sector, max(m.liquidity_bucket) AS liquidity_bucket
  {_MEMBER_JOIN} GROUP BY 1, 2, 3 HAVING count(m.snapshot_id) = 1) GROUP BY 1, 2""", ("decisions_cust", "memberships"))
def jon_07(v):
    """Clip rows to membership intervals, overwrite metadata, one row per (ticker, time)."""
    kept = member_match(v, v.decisions_cust).where("match_count = 1")
    best = F.max(F.struct("decision_id", "sector", "liquidity_bucket"))
    return kept.groupBy("ticker", us("decision_time")).agg(best.alias("m")).select(
        "ticker", "decision_time", "m.decision_id", "m.sector", "m.liquidity_bucket")


@query("jon_08", """SELECT b.ticker, CAST(b.date AS VARCHAR) AS date, round(b.close, 6) AS close, round(m.b_close, 6) AS market_close,
  CAST(m.date IS NULL AS BIGINT) AS unmatched FROM bars_supp b LEFT JOIN bench_market m USING (date)""", ("bars_supp", "bench_market"))
def jon_08(v):
    """Exact market-benchmark join by time; unmatched rows are flagged."""
    m = v.bench_market.withColumn("_hit", F.lit(1))
    return v.bars_supp.join(m, "date", "left").select(
        "ticker", s("date"), r("close"), r("b_close", "market_close"), n(F.col("_hit").isNull(), "unmatched"))


_sector_join = """FROM bars_supp b JOIN supp_dim d USING (ticker) LEFT JOIN bench_sector x ON x.sector = d.sector AND x.date = b.date"""


@query("jon_09", f"SELECT b.ticker, CAST(b.date AS VARCHAR) AS date, d.sector, round(x.s_close, 6) AS sector_close {_sector_join}",
       ("bars_supp", "supp_dim", "bench_sector"))
def jon_09(v):
    """Sector benchmark by (primary benchmark, time)."""
    b = v.bars_supp.join(v.supp_dim.select("ticker", "sector"), "ticker")
    return b.join(v.bench_sector, ["sector", "date"], "left").select("ticker", s("date"), "sector", r("s_close", "sector_close"))


@query("jon_10", """WITH q AS (SELECT date, close, CAST(date + 1 AS TIMESTAMP) AS av FROM bars_user WHERE ticker = 'U1'),
 p AS (SELECT date, close, CAST(date + 1 AS TIMESTAMP) + INTERVAL 15 SECOND AS av FROM bars_user WHERE ticker = 'U2')
SELECT d.ticker, CAST(d.date AS VARCHAR) AS date, q.close AS qqq_close, p.close AS spy_close, m.c AS sector_close,
  epoch_us(greatest(d.decision_time, q.av, p.av, m.av)) AS feature_available_at
FROM decisions_user d LEFT JOIN q USING (date) LEFT JOIN p USING (date)
LEFT JOIN (SELECT date, round(avg(close), 6) AS c, max(CAST(date + 1 AS TIMESTAMP) + INTERVAL 45 SECOND) AS av FROM bars_user GROUP BY 1) m USING (date)""",
       ("decisions_user", "bars_user"))
def jon_10(v):
    """Three benchmark lookups by bar end with running maximum of availability."""
    b = v.bars_user
    end = F.date_add("date", 1).cast("timestamp")
    q = b.where("ticker = 'U1'").select("date", F.col("close").alias("qqq_close"), end.alias("av_q"))
    p = b.where("ticker = 'U2'").select("date", F.col("close").alias("spy_close"), (end + F.expr("interval 15 seconds")).alias("av_p"))
    m = b.groupBy("date").agg(r(F.avg("close"), "sector_close")).withColumn("av_m", end + F.expr("interval 45 seconds"))
    out = v.decisions_user.join(q, "date", "left").join(p, "date", "left").join(m, "date", "left")
    return out.select("ticker", s("date"), "qqq_close", "spy_close", "sector_close",
                      us(F.greatest("decision_time", "av_q", "av_p", "av_m"), "feature_available_at"))


@query("jon_11", f"""SELECT b.ticker, CAST(b.date AS VARCHAR) AS date, round(m.b_close, 6) AS market_close, round(x.s_close, 6) AS sector_close,
 round(m.b_open, 6) AS market_open, round(x.s_open, 6) AS sector_open {_sector_join} LEFT JOIN bench_market m ON m.date = b.date""",
       ("bars_supp", "supp_dim", "bench_sector", "bench_market"))
def jon_11(v):
    """Daily market and sector benchmarks by session date."""
    b = v.bars_supp.join(v.supp_dim.select("ticker", "sector"), "ticker")
    return b.join(v.bench_market, "date", "left").join(v.bench_sector, ["sector", "date"], "left").select(
        "ticker", s("date"), r("b_close", "market_close"), r("s_close", "sector_close"), r("b_open", "market_open"), r("s_open", "sector_open"))


_bench_ret = """br AS (SELECT date, b_close / lag(b_close) OVER (ORDER BY date) - 1 AS ret FROM bench_market)"""


def bench_returns(v):
    """One row per date, so the single ordered pass is calendar-bounded."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return v.bench_market.select("date", (F.col("b_close") / F.lag("b_close").over(w) - 1).alias("ret"))


@query("jon_12", f"""WITH {_bench_ret}
SELECT b.ticker, CAST(b.date AS VARCHAR) AS date, round(coalesce(br.ret, 0), 6) AS spy_return_1d, round(coalesce(br.ret, 0), 6) AS sector_return_1d
FROM bars_supp b LEFT JOIN br ON br.date = b.date AND dayofweek(b.date) BETWEEN 1 AND 5""", ("bars_supp", "bench_market"))
def jon_12(v):
    """Daily benchmark merge with zero fallback; sector falls back to the market series."""
    br = bench_returns(v).where(F.dayofweek("date").between(2, 6))
    out = v.bars_supp.join(br, "date", "left")
    ret = F.coalesce("ret", F.lit(0.0))
    return out.select("ticker", s("date"), r(ret, "spy_return_1d"), r(ret, "sector_return_1d"))


@query("jon_13", f"""WITH {_bench_ret}
SELECT b.ticker, CAST(b.date AS VARCHAR) AS date, round(br.ret, 6) AS spy_return_1d, CAST(NULL AS DOUBLE) AS spy_vwap
FROM bars_supp b LEFT JOIN br ON br.date = b.date AND dayofweek(b.date) BETWEEN 1 AND 5""", ("bars_supp", "bench_market"))
def jon_13(v):
    """Benchmark merge for enrichment: missing stays null, absent columns are added as null."""
    br = bench_returns(v).where(F.dayofweek("date").between(2, 6))
    return v.bars_supp.join(br, "date", "left").select(
        "ticker", s("date"), r("ret", "spy_return_1d"), F.lit(None).cast("double").alias("spy_vwap"))


@query("jon_14", """SELECT b.ticker, CAST(b.date AS VARCHAR) AS date,
  round(CASE WHEN e.b_open > 0 THEN x.b_close / e.b_open - 1 END, 6) AS market_return,
  round(CASE WHEN se.s_open > 0 THEN sx.s_close / se.s_open - 1 END, 6) AS sector_return
FROM bars_supp b JOIN supp_dim d USING (ticker)
LEFT JOIN bench_market e ON e.date = b.date + 1 LEFT JOIN bench_market x ON x.date = b.date + 5
LEFT JOIN bench_sector se ON se.sector = d.sector AND se.date = b.date + 1
LEFT JOIN bench_sector sx ON sx.sector = d.sector AND sx.date = b.date + 5""", ("bars_supp", "supp_dim", "bench_market", "bench_sector"))
def jon_14(v):
    """Benchmark return over the label interval, for market and sector."""
    b = v.bars_supp.join(v.supp_dim.select("ticker", "sector"), "ticker").select(
        "ticker", "sector", "date", F.date_add("date", 1).alias("entry"), F.date_add("date", 5).alias("exit"))
    out = J.benchmark_path(b, v.bench_market, [], "entry", "exit", "market_return", open_="b_open", close="b_close")
    out = J.benchmark_path(out, v.bench_sector, ["sector"], "entry", "exit", "sector_return", open_="s_open", close="s_close")
    return out.select("ticker", s("date"), r("market_return"), r("sector_return"))


@query("jon_17", """WITH p AS (SELECT ticker, session, score AS opportunity FROM evidence),
 q AS (SELECT ticker, session, downside FROM evidence WHERE regime <> 'risk_off'),
 c AS (SELECT session, avg(downside) AS base FROM evidence GROUP BY 1)
SELECT p.ticker, CAST(p.session AS VARCHAR) AS session, round(p.opportunity, 6) AS p_opportunity, round(q.downside, 6) AS p_downside,
  round(q.downside - c.base, 6) AS calibrated_downside, CAST(q.ticker IS NOT NULL AS BIGINT) AS complete
FROM p LEFT JOIN q USING (ticker, session) LEFT JOIN c USING (session)""", ("evidence",))
def jon_17(v):
    """Opportunity, downside and calibration outputs joined one to one, with a completeness flag."""
    e = v.evidence
    p = e.select("ticker", "session", F.col("score").alias("opportunity"))
    q = e.where("regime <> 'risk_off'").select("ticker", "session", "downside")
    c = e.groupBy("session").agg(F.avg("downside").alias("base"))
    return p.join(q, ["ticker", "session"], "left").join(c, "session", "left").select(
        "ticker", s("session"), r("opportunity", "p_opportunity"), r("downside", "p_downside"),
        r(F.col("downside") - F.col("base"), "calibrated_downside"), n(F.col("downside").isNotNull(), "complete"))


@query("jon_18", """WITH ds AS (SELECT ticker, date, max(close) AS close, max(volume) AS vol FROM bars_user GROUP BY 1, 2),
 pr AS (SELECT ticker, session AS date, score, CASE WHEN regime = 'risk_on' THEN liquidity END AS vol FROM evidence)
SELECT pr.ticker, CAST(pr.date AS VARCHAR) AS date, round(pr.score, 6) AS score, coalesce(pr.vol, ds.vol) AS volume, ds.close
FROM pr LEFT JOIN ds USING (ticker, date)""", ("bars_user", "evidence"))
def jon_18(v):
    """Predictions joined to the deduplicated dataset; existing prediction columns win."""
    ds = v.bars_user.groupBy("ticker", "date").agg(F.max("close").alias("close"), F.max("volume").alias("ds_vol"))
    pr = v.evidence.select("ticker", F.col("session").alias("date"), "score",
                           F.when(F.col("regime") == "risk_on", F.col("liquidity")).alias("vol"))
    return pr.join(ds, ["ticker", "date"], "left").select(
        "ticker", s("date"), r("score"), F.coalesce("vol", "ds_vol").alias("volume"), "close")


@query("jon_19", """WITH pr AS (SELECT ticker, session, ret, target FROM evidence),
 ds AS (SELECT ticker, session, CASE WHEN regime = 'neutral' THEN ret + 1e-3 ELSE ret END AS ret, target FROM evidence WHERE liquidity > 1)
SELECT count(*) AS predictions, count(*) FILTER (WHERE ds.ticker IS NULL) AS unmatched,
  count(*) FILTER (WHERE abs(pr.ret - ds.ret) > 1e-12) AS target_mismatch, round(max(abs(pr.ret - ds.ret)), 6) AS max_abs_diff
FROM pr LEFT JOIN ds USING (ticker, session)""", ("evidence",))
def jon_19(v):
    """Every prediction must match the frozen dataset and agree on the target to 1e-12."""
    e = v.evidence
    ds = e.where("liquidity > 1").select("ticker", "session", F.lit(1).alias("_hit"),
                                         F.when(F.col("regime") == "neutral", F.col("ret") + 1e-3).otherwise(F.col("ret")).alias("d_ret"))
    j = e.select("ticker", "session", "ret").join(ds, ["ticker", "session"], "left")
    gap = F.abs(F.col("ret") - F.col("d_ret"))
    return j.agg(F.count(F.lit(1)).alias("predictions"), F.count_if(F.col("_hit").isNull()).alias("unmatched"),
                 F.count_if(gap > 1e-12).alias("target_mismatch"), r(F.max(gap), "max_abs_diff"))


@query("jon_20", """SELECT b.ticker, CAST(b.date AS VARCHAR) AS date, round(b.close, 6) AS close, b.volume, round(c.b_close, 6) AS spy_close
FROM bars_supp b LEFT JOIN bench_market c USING (date)""", ("bars_supp", "bench_market"))
def jon_20(v):
    """Add only approved context columns that the dataset lacks."""
    base = v.bars_supp
    context = v.bench_market.withColumnsRenamed({"b_close": "spy_close", "b_volume": "volume"})
    approved = [c for c in ("spy_close", "volume", "close") if c in context.columns and c not in base.columns]
    return base.join(context.select("date", *approved), "date", "left").select("ticker", s("date"), r("close"), "volume", r("spy_close"))


@query("jon_21", """SELECT b.ticker, CAST(b.date AS VARCHAR) AS date, d.sector, d.industry, round(d.market_cap, 6) AS market_cap
FROM bars_supp b LEFT JOIN supp_dim d USING (ticker)""", ("bars_supp", "supp_dim"))
def jon_21(v):
    """Candidate metadata joined by ticker (one metadata row per ticker)."""
    meta = v.supp_dim.groupBy("ticker").agg(F.min(F.struct("sector", "industry", "market_cap")).alias("m"))
    return v.bars_supp.join(meta, "ticker", "left").select("ticker", s("date"), "m.sector", "m.industry", r("m.market_cap", "market_cap"))


@query("jon_24", """SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers FROM bars_user
WHERE ticker IN (SELECT ticker FROM evidence WHERE target = 1 AND regime = 'risk_on')""", ("bars_user", "evidence"))
def jon_24(v):
    """Semi join: rows of tickers in a set."""
    keep = v.evidence.where("target = 1 AND regime = 'risk_on'").select("ticker")
    return v.bars_user.join(keep, "ticker", "left_semi").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("ticker").alias("tickers"))


@query("jon_25", """SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers FROM bars_user
WHERE ticker NOT IN (SELECT ticker FROM evidence WHERE target = 1 AND regime = 'risk_on')""", ("bars_user", "evidence"))
def jon_25(v):
    """Anti join: development rows are those not in the holdout set."""
    drop = v.evidence.where("target = 1 AND regime = 'risk_on'").select("ticker")
    return v.bars_user.join(drop, "ticker", "left_anti").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("ticker").alias("tickers"))


@query("jon_27", """WITH c AS (SELECT event_id, CASE WHEN CAST(l AS TIME) > TIME '16:00:00' OR dayofweek(l) IN (0, 6)
    THEN CAST(l AS DATE) + CAST(CASE dayofweek(l) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INT) ELSE CAST(l AS DATE) END AS cand
  FROM (SELECT event_id, (first_seen AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS l FROM news)),
 td AS (SELECT DISTINCT date FROM bars_user WHERE dayofweek(date) BETWEEN 2 AND 4)
SELECT c.event_id, CAST(min(td.date) AS VARCHAR) AS date FROM c JOIN td ON td.date >= c.cand GROUP BY 1""", ("news", "bars_user"))
def jon_27(v):
    """Event to the first trading date at or after its candidate date."""
    ev = v.news.select("event_id", feature_date("first_seen").alias("candidate"))
    dates = v.bars_user.select("date").where(F.dayofweek("date").between(3, 5))
    return J.forward_date(ev, dates, "candidate", "date", "trading_date").select("event_id", s("trading_date", "date"))
