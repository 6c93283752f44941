"""AGG queries."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.clean import ratio
from tidemark.functions.clock import time_bucket
from tidemark.operators import crosssection as X
from tidemark.operators.features import session_summary
from tidemark.operators.ordered import quantiles, row_blocks, frame, own, time_block
from tidemark.operators import diagnostics as D
from tidemark.plans.crosssection import ASEL, SEL, QCUT, quantile_trades, selected
from tidemark.plans.evaluation import outcome_report
from tidemark.plans.fmt import n, r, s, us
from tidemark.sources.views import OUTCOMES
from tidemark.plans.registry import query
from tidemark.sources.views import bars

EX = ("evidence_x",)
def sent():
    return F.coalesce("sentiment", F.lit(0.0))
DAYK = ("ticker", F.to_date("first_seen").alias("date"))


@query("agg_01", """SELECT ticker, CAST(CAST(first_seen AS DATE) AS VARCHAR) AS date, count(*) AS news_count, round(avg(sentiment), 6) AS sentiment_mean, round(min(sentiment), 6) AS sentiment_min,
 round(max(sentiment), 6) AS sentiment_max, round(avg(CASE WHEN sentiment > 0.15 THEN 1 ELSE 0 END), 6) AS sentiment_pos_frac, round(avg(CASE WHEN sentiment < -0.15 THEN 1 ELSE 0 END), 6) AS sentiment_neg_frac FROM news GROUP BY ALL""", ("news",))
def agg_01(v):
    """Daily text aggregate per ticker."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    g = v.news.groupBy(*DAYK).agg(
        F.count(F.lit(1)).alias("news_count"), r(F.avg("sentiment"), "sentiment_mean"), r(F.min("sentiment"), "sentiment_min"), r(F.max("sentiment"), "sentiment_max"),
        r(share(F.col("sentiment") > 0.15), "sentiment_pos_frac"), r(share(F.col("sentiment") < -0.15), "sentiment_neg_frac"))
    return g.withColumn("date", F.col("date").cast("string"))


FAM = ("click", "error", "purchase", "signup", "view")


@query("agg_02", f"SELECT ticker, CAST(CAST(first_seen AS DATE) AS VARCHAR) AS date, {', '.join(chr(99) + f'ount(*) FILTER (WHERE source_family = {chr(39)}{f}{chr(39)}) AS source_count_{f}' for f in FAM)} FROM news GROUP BY ALL", ("news",))
def agg_02(v):
    """Counts pivoted by source family (declared families, so no extra pass)."""
    p = v.news.groupBy(*DAYK).pivot("source_family", list(FAM)).count().na.fill(0)
    return p.select("ticker", s("date"), *[n(f, f"source_count_{f}") for f in FAM])


@query("agg_03", """SELECT ticker, CAST(CAST(first_seen AS DATE) AS VARCHAR) AS date, count(*) FILTER (WHERE source_family = 'view') AS reddit_mentions, coalesce(CAST(sum(k) FILTER (WHERE source_family = 'view') AS BIGINT), 0) AS reddit_score_sum,
 round(avg(sentiment) FILTER (WHERE source_family = 'view'), 6) AS reddit_sentiment_mean, round(avg(relevance) FILTER (WHERE source_family = 'view'), 6) AS reddit_upvote_ratio_mean FROM news GROUP BY ALL""", ("news",))
def agg_03(v):
    """Conditional subset aggregate."""
    hit = F.col("source_family") == "view"
    g = v.news.groupBy(*DAYK).agg(F.count_if(hit).alias("reddit_mentions"), F.coalesce(F.sum(F.when(hit, F.col("k"))), F.lit(0)).cast("long").alias("reddit_score_sum"),
                                  r(F.avg(F.when(hit, F.col("sentiment"))), "reddit_sentiment_mean"), r(F.avg(F.when(hit, F.col("relevance"))), "reddit_upvote_ratio_mean"))
    return g.withColumn("date", F.col("date").cast("string"))


_LT = "CAST((first_seen AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS TIME)"


@query("agg_04", f"""SELECT ticker, CAST(CAST(first_seen AS DATE) AS VARCHAR) AS date, count(*) AS event_count, count(*) FILTER (WHERE source_family = 'error') AS event_error_count,
 count(*) FILTER (WHERE {_LT} < TIME '09:30:00') AS event_time_pre_market_count, count(*) FILTER (WHERE {_LT} >= TIME '09:30:00' AND {_LT} <= TIME '16:00:00') AS event_time_intraday_count,
 count(*) FILTER (WHERE {_LT} > TIME '16:00:00') AS event_time_after_hours_count FROM news GROUP BY ALL""", ("news",))
def agg_04(v):
    """Event type and time-bucket counts per date."""
    d = v.news.withColumn("bucket", time_bucket("first_seen"))
    g = d.groupBy(*DAYK).agg(F.count(F.lit(1)).alias("event_count"), F.count_if(F.col("source_family") == "error").alias("event_error_count"),
                             *[F.count_if(F.col("bucket") == b).alias(f"event_time_{b}_count") for b in ("pre_market", "intraday", "after_hours")])
    return g.withColumn("date", F.col("date").cast("string"))


@query("agg_05", """WITH d AS (SELECT CAST(first_seen AS DATE) AS date, count(*) AS c, avg(coalesce(sentiment, 0)) AS m FROM news WHERE k % 10 = 0 GROUP BY 1),
 z AS (SELECT *, count(*) OVER w AS k, avg(c) OVER w AS a, stddev_samp(c) OVER w AS sd, avg(m) OVER (ORDER BY date ROWS 4 PRECEDING) AS m5 FROM d WINDOW w AS (ORDER BY date ROWS 29 PRECEDING))
SELECT CAST(date AS VARCHAR) AS date, c AS market_context_news_count, round(m, 6) AS market_context_sentiment_mean, round(coalesce(CASE WHEN k >= 5 THEN (c - a) / nullif(sd, 0) END, 0), 6) AS market_context_news_count_z30,
 round(m - m5, 6) AS market_context_sentiment_momentum_5d FROM z""", ("news",))
def agg_05(v):
    """Market-context daily aggregate with 30-row z-score and 5-row momentum (one row per date)."""
    d = v.news.where("k % 10 = 0").groupBy(F.to_date("first_seen").alias("date")).agg(F.count(F.lit(1)).alias("c"), F.avg(sent()).alias("m"))
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    w30 = w.rowsBetween(-29, 0)
    z = d.withColumns({"k": F.count("c").over(w30), "a": F.avg("c").over(w30), "sd": F.stddev_samp("c").over(w30), "m5": F.avg("m").over(w.rowsBetween(-4, 0))})
    return z.select(s("date"), n("c", "market_context_news_count"), r("m", "market_context_sentiment_mean"),
                    r(F.coalesce(F.when(F.col("k") >= 5, ratio(F.col("c") - F.col("a"), "sd")), F.lit(0.0)), "market_context_news_count_z30"),
                    r(F.col("m") - F.col("m5"), "market_context_sentiment_momentum_5d"))


@query("agg_06", """WITH g AS (SELECT ticker, session_date_et, arg_min(open, timestamp) AS o, arg_max(close, timestamp) AS c FROM bars_hour GROUP BY 1, 2)
SELECT ticker, CAST(session_date_et AS VARCHAR) AS session, o AS session_open, c AS session_close, lag(c) OVER (PARTITION BY ticker ORDER BY session_date_et) AS prior_session_close FROM g""", ("bars_hour",))
def agg_06(v):
    """Session open, close and prior close per ticker."""
    return session_summary(v.bars_hour).select("ticker", s("session_date_et", "session"), "session_open", "session_close", "prior_session_close")


@query("agg_07", """WITH m AS (SELECT user_id, date_trunc('minute', ts) AS m, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)
SELECT user_id, epoch_us(time_bucket(INTERVAL 5 MINUTE, m)) AS bar_start, arg_min(open, m) AS open, max(high) AS high, min(low) AS low, arg_max(close, m) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM m GROUP BY 1, 2""")
def agg_07(v):
    """One-minute to five-minute roll-up."""
    ev = v.t("events")
    m = bars(ev, ["user_id", F.date_trunc("minute", "ts").alias("m")], "value", F.count(F.lit(1)), ["ts", "event_id"])
    g = m.groupBy("user_id", F.window("m", "5 minutes").alias("w")).agg(
        F.min_by("open", "m").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "m").alias("close"), F.sum("volume").alias("volume"))
    return g.select("user_id", us("w.start", "bar_start"), "open", "high", "low", "close", "volume")


@query("agg_08", """SELECT group_id, round(avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END), 6) AS eligible_breadth_positive, round(avg(CASE WHEN score > 0.5 THEN 1 ELSE 0 END), 6) AS eligible_breadth_above_vwap FROM evidence_x GROUP BY 1""", EX)
def agg_08(v):
    """Cross-section breadth per decision group."""
    up = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return v.evidence.groupBy("group_id").agg(r(up(F.col("ret") > 0), "eligible_breadth_positive"), r(up(F.col("score") > 0.5), "eligible_breadth_above_vwap"))


@query("agg_09", "SELECT e.ticker, e.group_id, g.c AS group_size, g.e AS eligible_count FROM evidence_x e JOIN (SELECT group_id, count(*) AS c, count(*) FILTER (WHERE liquidity >= 2) AS e FROM evidence_x GROUP BY 1) g USING (group_id)", EX)
def agg_09(v):
    """Group size and eligible count, joined back (pre-aggregated rather than a group window)."""
    g = v.evidence.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"), F.count_if(F.col("liquidity") >= 2).alias("eligible_count"))
    return v.evidence.select("ticker", "group_id").join(g, "group_id")


_RB = "CASE WHEN x < 0.33 THEN 'low' WHEN x < 0.66 THEN 'medium' ELSE 'high' END"


@query("agg_10", f"""WITH c AS (SELECT ticker, regime, count(*) AS k FROM evidence_x GROUP BY 1, 2), m AS (SELECT ticker, regime AS mode FROM c QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY k DESC, regime) = 1),
 t AS (SELECT ticker, avg(target) AS x, avg(CASE WHEN liquidity >= 2 THEN 1 ELSE 0 END) AS cov FROM evidence_x GROUP BY 1)
SELECT ticker, mode AS stable_regime, {_RB} AS label_rate_bucket, {_RB.replace('x <', 'cov <')} AS coverage_bucket FROM t JOIN m USING (ticker)""", EX)
def agg_10(v):
    """Ticker summaries: stable mode (ties lexicographic), label-rate and coverage buckets."""
    c = v.evidence.groupBy("ticker", "regime").agg(F.count(F.lit(1)).alias("k"))
    m = c.groupBy("ticker").agg(F.min_by("regime", F.struct(-F.col("k"), F.col("regime"))).alias("stable_regime"))
    t = v.evidence.groupBy("ticker").agg(F.avg("target").alias("x"), F.avg(F.when(F.col("liquidity") >= 2, 1.0).otherwise(0.0)).alias("cov"))
    bucket = lambda c: F.when(F.col(c) < 0.33, "low").when(F.col(c) < 0.66, "medium").otherwise("high")
    return t.join(m, "ticker").select("ticker", "stable_regime", bucket("x").alias("label_rate_bucket"), bucket("cov").alias("coverage_bucket"))


@query("agg_11", """SELECT ticker, CAST(session AS VARCHAR) AS session, regime AS recovered, 1::BIGINT AS valid_one_hot FROM evidence_x""", EX)
def agg_11(v):
    """One-hot to category and one-hot validity."""
    cats = ("neutral", "risk_off", "risk_on")
    d = v.evidence.withColumns({f"is_{c}": (F.col("regime") == c).cast("int") for c in cats})
    best = F.greatest(*[F.col(f"is_{c}") for c in cats])
    rec = F.lit(None).cast("string")
    for c in reversed(cats):
        rec = F.when(F.col(f"is_{c}") == best, c).otherwise(rec)
    valid = (sum(F.col(f"is_{c}") for c in cats) == 1).cast("long")
    return d.select("ticker", s("session"), rec.alias("recovered"), valid.alias("valid_one_hot"))


_DIMS = ("month", "fold_bucket", "time_bucket", "market_regime", "sector", "market_cap_bucket", "liquidity_bucket", "liquidity_rank_quartile", "volatility_rank_quartile")
_STRATA = " UNION ALL ".join(f"""SELECT p.scope, '{x}' AS dimension, p.value, s.selected_rows, p.population_rows, s.decision_groups, s.sessions,
 {", ".join(f"round(s.{o}, 6) AS selected_{o}, round(p.{o}, 6) AS population_{o}, round(s.{o} - p.{o}, 6) AS delta_{o}" for o in OUTCOMES)},
 round(s.pos, 6) AS selected_positive_rate, CAST(s.selected_rows >= 100 AND s.sessions >= 20 AS BIGINT) AS meets_minimum_evidence
 FROM (SELECT scope, {x} AS value, count(*) AS population_rows, {", ".join(f"avg({o}) AS {o}" for o in OUTCOMES)} FROM attributed WHERE {x} IS NOT NULL GROUP BY ALL) p
 JOIN (SELECT scope, {x} AS value, count(*) AS selected_rows, count(DISTINCT group_id) AS decision_groups, {", ".join(f"avg({o}) AS {o}" for o in OUTCOMES)},
   avg(CASE WHEN net_excess_1b > 0 THEN 1 ELSE 0 END) AS pos, count(DISTINCT session) AS sessions FROM sel WHERE {x} IS NOT NULL GROUP BY ALL) s USING (scope, value)""" for x in _DIMS)


@query("agg_12", f"WITH {ASEL} {_STRATA}", ("attributed",))
def agg_12(v):
    """Stratified selected-against-population summaries over nine dimensions and eight outcomes in one pass."""
    out = D.strata(v.attributed, _DIMS, OUTCOMES, "net_excess_1b")
    kinds = [f"{a}_{o}" for o in OUTCOMES for a in ("selected", "population", "delta")]
    return out.select("scope", "dimension", "value", "selected_rows", "population_rows", "decision_groups", "sessions", *[r(c) for c in kinds], r("selected_positive_rate"), n("meets_minimum_evidence"))


@query("agg_13", """WITH d AS (SELECT *, least(10, greatest(1, ceil(row_number() OVER (PARTITION BY group_id ORDER BY score, ticker)::DOUBLE / count(*) OVER (PARTITION BY group_id) * 10))) AS dec FROM evidence_x)
SELECT CAST(dec AS BIGINT) AS score_decile, count(*) AS rows, round(avg(ret), 6) AS mean_ret, round(avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END), 6) AS positive_rate FROM d GROUP BY 1""", EX)
def agg_13(v):
    """Score decile table by first rank within the group."""
    d = X.ordinal(v.evidence, ["group_id"], "score", "ticker", "rk")
    dec = F.least(F.lit(10), F.greatest(F.lit(1), F.ceil(F.col("rk") / F.col("group_n") * 10)))
    return d.groupBy(n(dec, "score_decile")).agg(F.count(F.lit(1)).alias("rows"), r(F.avg("ret"), "mean_ret"), r(F.avg((F.col("ret") > 0).cast("double")), "positive_rate"))


@query("agg_14", f"""WITH {SEL} SELECT scope, group_id, round(p, 6) AS population, round(s, 6) AS selected, round(o, 6) AS oracle FROM (SELECT scope, group_id, avg(ret) AS p FROM evidence_x GROUP BY ALL)
 JOIN (SELECT scope, group_id, avg(ret) AS s FROM sel GROUP BY ALL) USING (scope, group_id)
 JOIN (SELECT scope, group_id, avg(ret) AS o FROM (SELECT * FROM evidence_x QUALIFY row_number() OVER (PARTITION BY scope, group_id ORDER BY ret DESC, ticker) <= 10) GROUP BY ALL) USING (scope, group_id)""", EX)
def agg_14(v):
    """Paired group means: selected, population and best k."""
    return outcome_report(v, ("ret",)).select("scope", "group_id", r("p", "population"), r("s", "selected"), r("o", "oracle"))


@query("agg_15", """WITH h AS (SELECT ticker, sector, industry, row_number() OVER (PARTITION BY sector ORDER BY sha256('42:' || ticker)) AS p, count(*) OVER (PARTITION BY sector) AS k FROM supp_dim),
 z AS (SELECT *, p <= CASE WHEN k >= 2 THEN least(greatest(1, round_even(k * 0.2::DOUBLE, 0)), k - 1) ELSE 0 END AS ho FROM h)
SELECT 'sector' AS dimension, sector AS stratum, count(*) AS tickers, count(*) FILTER (WHERE ho) AS holdout, count(*) FILTER (WHERE NOT ho) AS development FROM z GROUP BY ALL
UNION ALL SELECT 'industry', industry, count(*), count(*) FILTER (WHERE ho), count(*) FILTER (WHERE NOT ho) FROM z GROUP BY ALL""", ("supp_dim",))
def agg_15(v):
    """Holdout representation per dimension and stratum."""
    h = X.stratified_holdout(v.supp_dim, "sector", 0.2, 42).select("ticker", "holdout")
    d = v.supp_dim.join(h, "ticker").unpivot(["ticker", "holdout"], ["sector", "industry"], "dimension", "stratum")
    return d.groupBy("dimension", "stratum").agg(F.count(F.lit(1)).alias("tickers"), F.count_if("holdout").alias("holdout"), F.count_if(~F.col("holdout")).alias("development"))


@query("agg_17", """WITH t AS (SELECT industry, sector, ticker, market_cap, row_number() OVER (PARTITION BY sector ORDER BY market_cap DESC, ticker) AS p FROM supp_dim)
SELECT sector AS monitor_theme, count(DISTINCT ticker) AS tickers, round(avg(market_cap), 6) AS avg_score, round(max(market_cap), 6) AS max_score, string_agg(ticker, ',' ORDER BY p) FILTER (WHERE p <= 8) AS top_candidates FROM t GROUP BY 1""", ("supp_dim",))
def agg_17(v):
    """Theme report: distinct tickers, mean, maximum and the first eight names."""
    base = v.supp_dim.groupBy("sector").agg(F.countDistinct("ticker").alias("tickers"), r(F.avg("market_cap"), "avg_score"), r(F.max("market_cap"), "max_score"))
    top = X.top_k(v.supp_dim, ["sector"], [F.desc("market_cap"), F.col("ticker")], 8, "p").groupBy("sector").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "ticker"))), lambda x: x["ticker"]), ",").alias("top_candidates"))
    return base.join(top, "sector").select(F.col("sector").alias("monitor_theme"), "tickers", "avg_score", "max_score", "top_candidates")


@query("agg_18", """WITH c AS (SELECT regime, count(*) AS k FROM evidence_x GROUP BY 1), t AS (SELECT count(*) AS rp, max(k)::DOUBLE / sum(k) AS ms, CAST(sum(k) AS BIGINT) AS s FROM c)
SELECT 'summary' AS scope, rp AS regimes_present, round(ms, 6) AS max_single_regime_share, s AS rows FROM t UNION ALL SELECT 'regime:' || regime, rp, round(k::DOUBLE / s, 6), k FROM c, t""", EX)
def agg_18(v):
    """Regime counts with a rolled-up summary row."""
    c = v.evidence.groupBy("regime").agg(F.count(F.lit(1)).alias("k"))
    t = c.agg(F.count(F.lit(1)).alias("rp"), (F.max("k") / F.sum("k")).alias("ms"), F.sum("k").alias("total"))
    detail = c.join(F.broadcast(t)).select(F.concat(F.lit("regime:"), "regime").alias("scope"), n("rp", "regimes_present"), r(F.col("k") / F.col("total"), "max_single_regime_share"), n("k", "rows"))
    return t.select(F.lit("summary").alias("scope"), n("rp", "regimes_present"), r("ms", "max_single_regime_share"), n("total", "rows")).unionByName(detail)


@query("agg_19", """WITH e AS (SELECT *, liquidity AS ev, CASE WHEN downside > 0.9 THEN 0.5 ELSE 0 END AS low, regime <> 'risk_off' AS el FROM evidence_x)
SELECT count(*) AS rows, count(*) FILTER (WHERE el) AS catalyst_eligible_rows, round(avg(CAST(el AS INT)), 6) AS catalyst_coverage_rate, count(*) FILTER (WHERE ev > 1) AS rows_with_catalyst,
 round(sum(ev * low) / sum(ev), 6) AS low_relevance_event_rate FROM e""", EX)
def agg_19(v):
    """Catalyst coverage audit in one aggregate."""
    low = F.when(F.col("downside") > 0.9, 0.5).otherwise(0.0)
    el = F.col("regime") != "risk_off"
    return v.evidence.agg(F.count(F.lit(1)).alias("rows"), F.count_if(el).alias("catalyst_eligible_rows"), r(F.avg(el.cast("double")), "catalyst_coverage_rate"),
                          F.count_if(F.col("liquidity") > 1).alias("rows_with_catalyst"), r(F.sum(F.col("liquidity") * low) / F.sum("liquidity"), "low_relevance_event_rate"))


@query("agg_20", """SELECT """ + ", ".join(f"count(*) FILTER (WHERE source_family = '{f}') AS positive_{f}" for f in FAM) + """, round(avg(CASE WHEN relevance < 0.5 THEN 1 ELSE 0 END), 6) AS low_relevance_rate,
 round(avg(CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END), 6) AS generic_rate, count(*) FILTER (WHERE feature_available_at < first_seen) AS alignment_errors FROM news""", ("news",))
def agg_20(v):
    """News audit: rows per source, low-relevance and generic rates, alignment errors."""
    d = v.news
    return d.agg(*[F.count_if(F.col("source_family") == f).alias(f"positive_{f}") for f in FAM], r(F.avg((F.col("relevance") < 0.5).cast("double")), "low_relevance_rate"),
                 r(F.avg((F.col("k") % 11 == 0).cast("double")), "generic_rate"), F.count_if(F.col("feature_available_at") < F.col("first_seen")).alias("alignment_errors"))


_REG = ("risk_on", "neutral", "risk_off")


@query("agg_21", f"""WITH {QCUT} SELECT count(*) AS rows, {', '.join(f"count(*) FILTER (WHERE regime = '{x}') AS {x}_rows" for x in _REG)},
 {', '.join(f"(SELECT count(*) FROM tq WHERE regime = '{x}') AS selected_{x}_trades" for x in _REG)}, (SELECT count(DISTINCT regime) FROM tq) AS selected_regimes_present FROM evidence_x""", EX)
def agg_21(v):
    """Regime audit with the selected subset."""
    a = v.evidence.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("regime") == x).alias(f"{x}_rows") for x in _REG])
    b = quantile_trades(v).agg(*[F.count_if(F.col("regime") == x).alias(f"selected_{x}_trades") for x in _REG], F.countDistinct("regime").alias("selected_regimes_present"))
    return a.join(F.broadcast(b))  # one-row aggregates


@query("agg_22", f"WITH {QCUT} SELECT regime AS market_regime, count(*) AS selected_trades, round(avg(ret), 6) AS avg_trade_return, round(avg(CAST(ret > 0 AS INT)), 6) AS win_rate, round(avg(target), 6) AS target_hit_rate FROM tq GROUP BY 1", EX)
def agg_22(v):
    """Profit summary per regime."""
    return quantile_trades(v).groupBy(F.col("regime").alias("market_regime")).agg(
        F.count(F.lit(1)).alias("selected_trades"), r(F.avg("ret"), "avg_trade_return"), r(F.avg((F.col("ret") > 0).cast("double")), "win_rate"), r(F.avg("target"), "target_hit_rate"))


@query("agg_23", """SELECT ticker, count(*) AS rows, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, count(*) FILTER (WHERE close > open) AS up_rows, round(avg(volume), 6) AS mean_volume FROM bars_supp GROUP BY 1""", ("bars_supp",))
def agg_23(v):
    """Enrichment audit per ticker."""
    return v.bars_supp.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), s(F.min("date"), "first_date"), s(F.max("date"), "last_date"), F.count_if(F.col("close") > F.col("open")).alias("up_rows"),
                                             r(F.avg("volume"), "mean_volume"))


_PF = ("score", "downside", "ret", "sparse")
PROFILE_SQL = " UNION ALL ".join(f"""SELECT '{f}' AS feature, count(*) AS rows, count({f}) AS observed, round(avg(CASE WHEN {f} IS NULL THEN 1 ELSE 0 END), 6) AS missing_rate, round(avg({f}), 6) AS mean, round(stddev_pop({f}), 6) AS std FROM p""" for f in _PF)


def profile(df, features):
    """Rows, observed, missing rate, mean and population std per feature, one pass."""
    long = X.unpivot(df, [], features)
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("observed"), F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"),
                                       F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


@query("agg_24", f"WITH p AS (SELECT *, CASE WHEN liquidity >= 2 THEN liquidity END AS sparse FROM evidence_x) {PROFILE_SQL}", EX)
def agg_24(v):
    """Feature reference profile."""
    d = v.evidence.withColumn("sparse", F.when(F.col("liquidity") >= 2, F.col("liquidity")))
    return profile(d, _PF).select("feature", "rows", "observed", r("missing_rate"), r("mean"), r("std"))


@query("agg_25", "SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, CAST(min(session) AS VARCHAR) AS first_date, CAST(max(session) AS VARCHAR) AS last_date, round(avg(ret), 6) AS target_mean, round(avg(target), 6) AS target_positive_rate FROM evidence_x", EX)
def agg_25(v):
    """Dataset fingerprint summary."""
    return v.evidence.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("ticker").alias("tickers"), s(F.min("session"), "first_date"), s(F.max("session"), "last_date"),
                          r(F.avg("ret"), "target_mean"), r(F.avg("target"), "target_positive_rate"))


@query("agg_26", "SELECT scope, count(DISTINCT ticker) AS tickers, count(DISTINCT session) AS sessions, count(DISTINCT group_id) AS groups FROM evidence_x GROUP BY 1", EX)
def agg_26(v):
    """Distinct tickers, sessions and groups."""
    return v.evidence.groupBy("scope").agg(*[F.countDistinct(c).alias(a) for c, a in (("ticker", "tickers"), ("session", "sessions"), ("group_id", "groups"))])


@query("agg_27", "SELECT source, lang AS theme, count(*) AS rows FROM documents GROUP BY 1, 2")
def agg_27(v):
    """Row counts per (source, theme)."""
    return v.t("documents").groupBy("source", F.col("lang").alias("theme")).agg(F.count(F.lit(1)).alias("rows"))


@query("agg_28", """WITH e AS (SELECT DISTINCT ticker, f.source_family FROM collections, (SELECT DISTINCT source_family FROM collections) f), o AS (SELECT DISTINCT ticker, source_family FROM collections WHERE status IN ('observed', 'observed_empty'))
SELECT source_family, count(*) AS expected_pairs, count(o.ticker) AS observed_pairs, count(*) - count(o.ticker) AS missing_pairs FROM e LEFT JOIN o USING (ticker, source_family) GROUP BY 1""", ("collections",))
def agg_28(v):
    """Collection status roll-up: expected against observed (ticker, family) pairs."""
    tickers = v.collections.select("ticker").distinct().withColumn("source_family", F.explode(F.array(*[F.lit(f) for f in FAM])))
    ok = v.collections.where(F.col("status").isin("observed", "observed_empty")).select("ticker", "source_family").distinct().withColumn("hit", F.lit(1))
    return tickers.join(ok, ["ticker", "source_family"], "left").groupBy("source_family").agg(
        F.count(F.lit(1)).alias("expected_pairs"), F.count("hit").alias("observed_pairs"), F.count_if(F.col("hit").isNull()).alias("missing_pairs"))


@query("agg_29", """WITH d AS (SELECT ticker, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY ticker ORDER BY timestamp) AS g FROM bars_hour)
SELECT ticker, round(quantile_cont(g, 0.5) / 60000000, 6) AS bar_minutes FROM d WHERE g > 0 AND g <= 21600000000 GROUP BY 1""", ("bars_hour",))
def agg_29(v):
    """Inferred bar duration: median positive gap of at most six hours."""
    b = row_blocks(v.bars_hour, ["ticker"], [F.col("timestamp")], time_block("timestamp", 30 * 86_400), back=1)
    g = own(b.withColumn("gap", F.unix_micros("timestamp") - F.unix_micros(F.lag("timestamp").over(frame(["ticker"])))))
    q = quantiles(g.where("gap > 0 and gap <= 21600000000"), ["ticker"], "gap", {"m": 0.5})
    return q.select("ticker", r(F.col("m") / 60_000_000, "bar_minutes"))


# --- text rules --------------------------------------------------------------------------------------------------
RULES = (  # (name, keywords, escalation): rules as data, with words that occur in the prose
    ("shipping", ("tanker", "ship", "port"), ("attack", "strike")), ("energy", ("gas", "oil", "lng"), ("sanction", "ban", "tion")),
    ("chips", ("taiwan", "tsmc", "sand"), ("export ban", "restriction", "ther")), ("cyber", ("breach", "hack", "und"), ("outage", "shutdown", "ent")))
_rule_sql = " UNION ALL ".join(f"SELECT '{a}' AS flashpoint, '{'|'.join(k)}' AS kw, '{'|'.join(e)}' AS esc" for a, k, e in RULES)


def flashpoints(events, rules, now):
    """Flashpoint scores of (body, published, sentiment, doc_id, title) rows.

    ``rules`` is a short literal list, so each text is tested once per rule by a
    row expression and exploded only where it hits.
    """
    hits = F.array_compact(F.array(*[F.when(T.has_any("body", k), F.struct(F.lit(a).alias("flashpoint"), T.has_any("body", e).alias("esc"))) for a, k, e in rules]))
    h = events.select("doc_id", "title", "published", "sentiment", F.explode(hits).alias("h")).select("*", "h.*")
    g = h.groupBy("flashpoint").agg(F.count(F.lit(1)).alias("event_count"), F.count_if("esc").alias("escalation_event_count"),
                                    F.count_if(F.col("published") >= now - F.expr("interval 6 hours")).alias("recent_event_count_6h"), F.avg("sentiment").alias("mean_sentiment"),
                                    F.max("published").alias("latest"), F.min_by("title", "doc_id").alias("sample_headline"))
    inten = F.least(F.lit(1.0), F.col("event_count") / 25 + F.col("escalation_event_count") / 10 + F.col("recent_event_count_6h") / 10)
    return g.withColumn("shock_score", F.least(F.lit(1.0), inten + 0.25 * F.greatest(F.lit(0.0), -F.col("mean_sentiment"))))


def rule_events(v):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    ev = v.headlines.withColumns({"body": F.lower(T.joined("title", "summary", "text")), "sentiment": F.col("doc_id") % 97 / F.lit(48.0) - 1})
    return ev.where(F.col("published") >= now - F.expr("interval 48 hours")), now


FLASH_SQL = f"""rules AS ({_rule_sql}), h AS (SELECT *, lower(coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(text, '')) AS body, doc_id % 97 / 48.0::DOUBLE - 1 AS sent FROM headlines WHERE published >= TIMESTAMP '2024-01-29 00:00:00'),
 m AS (SELECT r.flashpoint, h.*, regexp_matches(body, esc) AS e FROM h, rules r WHERE regexp_matches(body, kw)),
 fg AS (SELECT flashpoint, count(*) AS c, count(*) FILTER (WHERE e) AS ec, count(*) FILTER (WHERE published >= TIMESTAMP '2024-01-30 18:00:00') AS rc, avg(sent) AS ms, max(published) AS latest, arg_min(title, doc_id) AS title FROM m GROUP BY 1),
 fp AS (SELECT *, least(1.0::DOUBLE, least(1.0::DOUBLE, c / 25.0::DOUBLE + ec / 10.0::DOUBLE + rc / 10.0::DOUBLE) + 0.25 * greatest(0, -ms)) AS shock FROM fg)"""


@query("agg_16", f"WITH {FLASH_SQL} SELECT flashpoint, c AS event_count, ec AS escalation_event_count, rc AS recent_event_count_6h, round(ms, 6) AS mean_sentiment, round(shock, 6) AS shock_score, epoch_us(latest) AS latest_timestamp, title AS sample_headline FROM fp", ("headlines",))
def agg_16(v):
    """Flashpoint aggregates per rule over whole texts."""
    ev, now = rule_events(v)
    return flashpoints(ev, RULES, now).select("flashpoint", "event_count", "escalation_event_count", "recent_event_count_6h", r("mean_sentiment"), r("shock_score"), us("latest", "latest_timestamp"), "sample_headline")


@query("jon_23", f"""WITH {FLASH_SQL}, th AS (SELECT * FROM (VALUES ('shipping', 'AFRICA', 'ASIA'), ('energy', 'MIDDLE EAST', 'EUROPE'), ('chips', 'AMERICA', 'ASIA'), ('cyber', 'EUROPE', 'AFRICA')) t(flashpoint, pos, neg)),
 la AS (SELECT ticker, max(date) AS date, arg_max(close, date) AS close FROM bars_supp GROUP BY 1)
SELECT la.ticker, CAST(la.date AS VARCHAR) AS date, d.sector AS monitor_theme, round(least(1, coalesce((SELECT sum(shock) FROM fp JOIN th USING (flashpoint) WHERE th.pos = d.sector), 0)), 6) AS global_positive_impact,
 round(least(1, coalesce((SELECT sum(shock) FROM fp JOIN th USING (flashpoint) WHERE th.neg = d.sector), 0)), 6) AS global_negative_impact FROM la LEFT JOIN supp_dim d USING (ticker)""", ("headlines", "bars_supp", "supp_dim"))
def jon_23(v):
    """Theme join: latest row per ticker, theme dimension, flashpoint impact by theme."""
    ev, now = rule_events(v)
    themes = {"shipping": ("AFRICA", "ASIA"), "energy": ("MIDDLE EAST", "EUROPE"), "chips": ("AMERICA", "ASIA"), "cyber": ("EUROPE", "AFRICA")}
    fp = flashpoints(ev, RULES, now)

    def impact(side):
        theme = F.lit(None).cast("string")
        for k, pair in themes.items():
            theme = F.when(F.col("flashpoint") == k, pair[side]).otherwise(theme)
        return fp.groupBy(theme.alias("sector")).agg(F.sum("shock_score").alias(f"i{side}"))

    last = v.bars_supp.groupBy("ticker").agg(F.max("date").alias("date"))
    out = last.join(v.supp_dim.select("ticker", "sector"), "ticker", "left").join(impact(0), "sector", "left").join(impact(1), "sector", "left")
    cap = lambda c: F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)))
    return out.select("ticker", s("date"), F.col("sector").alias("monitor_theme"), r(cap("i0"), "global_positive_impact"), r(cap("i1"), "global_negative_impact"))
