"""AUD and FLT queries.  Row rules are SQL predicates, evaluated by one aggregate per table."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.clock import bar_grid, market_sessions, stride_offset
from tidemark.operators import audits as A
from tidemark.operators import crosssection as X
from tidemark.operators import dataset_audits as DA
from tidemark.operators import evaluation as V
from tidemark.operators import signals as S
from tidemark.plans.aggregates import PROFILE_SQL, profile
from tidemark.plans.crosssection import _CAND, candidates
from tidemark.plans.fmt import n, r, s, us
from tidemark.plans.joins import _MEMBER_JOIN, member_match
from tidemark.plans.registry import query
from tidemark.session import written

EX = ("evidence_x",)


def audit_sql(frm: str, rules: dict, unique: dict | None = None, pre: str = "", keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    parts = [f"SELECT {k}'{a}' AS \"check\", count(*) FILTER (WHERE {c}) AS failures, count(*) AS rows_checked FROM {frm}{g}" for a, c in rules.items()]
    parts += [f"SELECT {k}'{a}' AS \"check\", count(*) - count(DISTINCT ({', '.join(cols)})) AS failures, count(*) AS rows_checked FROM {frm}{g}" for a, cols in (unique or {}).items()]
    return f"{pre} SELECT *, CASE WHEN failures = 0 THEN 'passed' ELSE 'failed' END AS status FROM ({' UNION ALL '.join(parts)})"


def audit_query(name, frm, df, rules, unique=None, views=(), doc="", pre=""):
    def fn(v):
        return A.audit(df(v), rules, unique)

    fn.__doc__ = doc
    query(name, audit_sql(frm, rules, unique, pre), views)(fn)


BAR_RULES = {
    "timestamps": "timestamp IS NULL OR available_at IS NULL", "interval_order": "timestamp <= bar_start", "availability": "available_at < timestamp", "prices_positive": "open <= 0 OR high <= 0 OR low <= 0 OR close <= 0",
    "high_coherent": "high < greatest(open, close, low)", "low_coherent": "low > least(open, close, high)", "volume": "volume < 1", "minimum_price": "low < 1",
}
audit_query("aud_01", "bars_hour", lambda v: v.bars_hour, BAR_RULES, {"identity": ["ticker", "bar_start"]}, ("bars_hour",), "Bars: timestamps, order, identity, OHLCV coherence.")
EVENT_RULES = {"timestamps": "first_seen IS NULL", "availability_order": "feature_available_at < first_seen", "sentiment_range": "sentiment > 1 OR sentiment < -1", "sentiment_missing": "sentiment IS NULL", "relevance_negative": "relevance < 0"}
audit_query("aud_02", "news", lambda v: v.news, EVENT_RULES, {"identity": ["event_id"]}, ("news",), "Events: timestamps, availability order, identity.")


def _count(cond: str, scope: str = "true") -> str:
    return f"count(*) FILTER (WHERE {scope} AND coalesce({cond}, false))"


def report_sql(frm: str, checks: dict[str, tuple[str, str]], per_key: dict[str, tuple[str, str, str]], pre: str = "") -> str:
    """One SELECT per rule: failures and rows checked over ``frm``, or over a grouped form of it."""
    parts = [f"SELECT '{k}' AS \"check\", CAST({f} + 0 * count(*) AS BIGINT) AS failures, CAST({c} AS BIGINT) AS rows_checked FROM {frm}" for k, (f, c) in checks.items()]
    parts += [f"SELECT '{k}', CAST({f} AS BIGINT), CAST({c} AS BIGINT) FROM ({g})" for k, (f, c, g) in per_key.items()]
    return f"{pre} SELECT *, CASE WHEN failures = 0 THEN 'passed' ELSE 'failed' END AS status FROM ({' UNION ALL '.join(parts)})"


def _identity_sql(frm: str, keys: str) -> dict:
    return {"identity": ("coalesce(sum(k - 1), 0)", "coalesce(sum(k), 0)", f"SELECT count(*) AS k FROM {frm} GROUP BY {keys}")}


# Provenance columns of the canonical audits, some of them faulty.
_BARS_C = {"timeframe": "'1h'", "bar_end": "timestamp", "price_feed": "CASE WHEN sd % 7 = 0 THEN 'IEX' WHEN sd % 5 > 0 THEN 'SIP ' END",
           "availability_policy": "CASE WHEN sd % 11 = 0 THEN 'guessed' WHEN sd % 3 = 0 THEN 'observed' ELSE 'market_interval_close' END", "schema_version": "CASE WHEN sd % 13 <> 0 THEN 'v1' END"}
_SEED, _SHIFT = "(hour(bar_start) + dayofmonth(bar_start))", "(sd % 5 - 3)"
_AS = lambda cols: ", ".join(f"{x} AS {k}" for k, x in cols.items())
_BARS_C_SQL = {
    "schema": ("0", "count(*)"), "rows": ("CAST(count(*) = 0 AS INT)", "count(*)"), "timestamps": (_count("bar_start IS NULL OR bar_end IS NULL OR available_at IS NULL OR ingested_at IS NULL"), "count(*)"),
    "availability_order": (_count("bar_end <= bar_start OR available_at < bar_end OR (availability_policy = 'observed' AND available_at < ingested_at)"), "count(*)"),
    "ohlcv": (_count("open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL OR least(open, high, low, close) <= 0 OR volume < 0 OR high < greatest(open, close, low) OR low > least(open, close, high)"), "count(*)"),
    "price_feed": (_count("lower(trim(coalesce(price_feed, 'unknown'))) <> 'sip'"), "count(*)"), "availability_policy": (_count("availability_policy NOT IN ('observed', 'market_interval_close')"), "count(*)"),
    "schema_version": (_count("schema_version IS DISTINCT FROM 'v1'"), "count(*)")}


@query("aud_01c", report_sql("cb", _BARS_C_SQL, _identity_sql("cb", "ticker, timeframe, bar_start"), f"WITH cb AS (SELECT * EXCLUDE sd, {_AS(_BARS_C)}, available_at + to_seconds({_SHIFT}) AS ingested_at FROM (SELECT *, {_SEED} AS sd FROM bars_hour))"), ("bars_hour",))
def aud_01c(v):
    """Canonical bars: the nine rules, with feed, availability policy and version."""
    d = v.bars_hour.withColumn("sd", F.expr(_SEED))
    return DA.bars_audit(d.withColumns({**{k: F.expr(x) for k, x in _BARS_C.items()}, "ingested_at": F.expr(f"available_at + make_dt_interval(0, 0, 0, {_SHIFT})")}))


_EVENTS_C = {"published_at": "first_seen", "available_at": "first_seen", "provider_updated_at": "CASE WHEN k % 9 = 0 THEN feature_available_at END", "sentiment_scored_at": "CASE WHEN k % 2 = 1 THEN feature_available_at END",
             "availability_policy": "CASE WHEN k % 10 = 0 THEN 'backfill' ELSE 'observed' END", "schema_version": "CASE WHEN k % 17 = 0 THEN 'v0' ELSE 'v1' END"}
_EVENTS_C_SQL = {
    "schema": ("0", "count(*)"), "rows": ("CAST(count(*) = 0 AS INT)", "count(*)"), "timestamps": (_count("published_at IS NULL OR first_seen IS NULL OR available_at IS NULL OR feature_available_at IS NULL"), "count(*)"),
    "availability_order": (_count("available_at < published_at OR coalesce(available_at < provider_updated_at, false) OR (availability_policy = 'observed' AND available_at < first_seen) OR feature_available_at < available_at OR (sentiment IS NOT NULL AND sentiment_scored_at IS NULL) OR feature_available_at <> coalesce(sentiment_scored_at, available_at)"), "count(*)"),
    "observed_history": (_count("availability_policy <> 'observed'"), "count(*)"), "identity_present": (_count("event_id IS NULL OR trim(coalesce(ticker, '')) = '' OR trim(coalesce(source_family, '')) = ''"), "count(*)"),
    "schema_version": (_count("schema_version <> 'v1'"), "count(*)")}


@query("aud_02c", report_sql("ce", _EVENTS_C_SQL, _identity_sql("ce", "event_id"), f"WITH ce AS (SELECT *, {_AS(_EVENTS_C)} FROM news)"), ("news",))
def aud_02c(v):
    """Canonical events: order of times with the sentiment's, observed history, identity, version."""
    return DA.events_audit(v.news.withColumns({k: F.expr(x) for k, x in _EVENTS_C.items()}))


@query("aud_03", f"""WITH mc AS (SELECT d.decision_id, count(m.snapshot_id) AS k {_MEMBER_JOIN} GROUP BY 1),
 ov AS (SELECT a.ticker, a.effective_from, count(*) AS k FROM memberships a JOIN memberships b ON a.ticker = b.ticker AND a.effective_from >= b.effective_from AND (b.effective_to IS NULL OR a.effective_from < b.effective_to) GROUP BY 1, 2)
SELECT 'overlapping_windows' AS "check", count(*) FILTER (WHERE k > 1) AS failures, count(*) AS rows_checked FROM ov UNION ALL SELECT 'decision_uncovered', count(*) FILTER (WHERE k = 0), count(*) FROM mc
UNION ALL SELECT 'decision_ambiguous', count(*) FILTER (WHERE k > 1), count(*) FROM mc UNION ALL SELECT 'window_order', count(*) FILTER (WHERE effective_to <= effective_from), count(*) FROM memberships""", ("memberships", "decisions_cust"))
def aud_03(v):
    """Memberships: overlapping windows, window order, decision coverage exactly one."""
    from tidemark.operators.joins import interval_match

    m = v.memberships
    starts = m.select("ticker", F.col("effective_from").alias("decision_time"))
    over = interval_match(starts, m, ["ticker"], "decision_time", F.col("effective_from"), F.col("effective_to"), "snapshot_id", [])
    parts = [A.audit(over, {"overlapping_windows": "match_count > 1"}), A.audit(m, {"window_order": "effective_to <= effective_from"}),
             A.audit(member_match(v, v.decisions_cust), {"decision_uncovered": "match_count = 0", "decision_ambiguous": "match_count > 1"})]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.drop("status")


COLLECT_RULES = {"failed_or_partial": "status IN ('failed', 'partial')", "rows_without_observation": "status <> 'observed' AND row_count > 0", "observed_without_rows": "status = 'observed' AND row_count = 0", "coverage_after_completion": "requested_end > completed_at",
                 "status_known": "status NOT IN ('observed', 'observed_empty', 'partial', 'failed', 'disabled', 'not_collected')"}
audit_query("aud_04", "collections", lambda v: v.collections, COLLECT_RULES, {"identity": ["collection_id"]}, ("collections",), "Source collections: schema rules, failures, identity.")
audit_query("aud_05", "facts", lambda v: v.facts, {"value_missing": "value IS NULL", "metric_known": "metric NOT IN ('urgent', 'high', 'medium', 'low')", "availability": "available_at IS NULL"}, {"identity": ["fact_id"]}, ("facts",), "Fundamental facts: typed and unique.")

_DEC = """dj AS (SELECT d.ticker, d.decision_time, max(e.feature_available_at) AS latest_event_available_at, max(e.first_seen + INTERVAL 12 HOUR) AS slow_available_at FROM decisions_user d JOIN news e ON e.ticker = d.ticker AND e.feature_available_at <= d.decision_time GROUP BY 1, 2)"""
FUTURE = {"latest_event_available_at": "latest_event_available_at > decision_time", "slow_available_at": "slow_available_at > decision_time"}


@query("aud_06", audit_sql("dj", FUTURE, None, "WITH " + _DEC), ("decisions_user", "news"))
def aud_06(v):
    """No future features: availability columns later than the decision."""
    from tidemark.operators.joins import latest_row

    ev = v.news.withColumn("slow", F.col("first_seen") + F.expr("interval 12 hours"))
    d = latest_row(v.decisions_user.select("ticker", "decision_time"), ev, ["ticker"], "decision_time", "feature_available_at", ["slow"])
    late = ev.where("slow > feature_available_at").select("ticker", "feature_available_at", "slow")
    m = running_max(d.select("ticker", "decision_time", F.col("matched_at").alias("latest_event_available_at")), late)
    return A.audit(m.where("latest_event_available_at is not null"), FUTURE)


def running_max(decisions, rows):
    """Largest ``slow`` among rows known at the decision: running maximum within day blocks plus the carry of earlier days."""
    from tidemark.operators.ordered import as_of

    from pyspark.sql import Window as Wn

    from tidemark.operators.ordered import time_block

    pre = rows.groupBy("ticker", F.col("feature_available_at").alias("_t")).agg(F.max("slow").alias("slow")).withColumn("_b", time_block("_t", 86_400))
    day = pre.groupBy("ticker", "_b").agg(F.max("slow").alias("slow"))
    carry = day.withColumn("carry", F.max("slow").over(Wn.partitionBy("ticker").orderBy("_b").rowsBetween(Wn.unboundedPreceding, -1)))
    run = Wn.partitionBy("ticker", "_b").orderBy("_t").rowsBetween(Wn.unboundedPreceding, 0)
    known = pre.join(carry.select("ticker", "_b", "carry"), ["ticker", "_b"]).withColumn("slow_available_at", F.greatest(F.max("slow").over(run), "carry"))
    out = as_of(decisions, known, ["ticker"], "decision_time", "_t", {"_m": (None, ["slow_available_at"])})
    return out.withColumn("slow_available_at", F.col("_m.slow_available_at")).drop("_m")


@query("aud_07", """WITH one AS (SELECT * FROM collections QUALIFY row_number() OVER (PARTITION BY ticker, source_family, completed_at ORDER BY collection_id DESC) = 1),
 j AS (SELECT d.ticker, d.decision_time, c.status, c.requested_end, c.completed_at FROM decisions_user d ASOF LEFT JOIN (SELECT * FROM one WHERE source_family = 'click') c ON c.ticker = d.ticker AND d.decision_time >= c.completed_at)
SELECT 'not_successful' AS "check", count(*) FILTER (WHERE coalesce(status, 'not_collected') NOT IN ('observed', 'observed_empty')) AS failures, count(*) AS rows_checked FROM j
UNION ALL SELECT 'stale_coverage', count(*) FILTER (WHERE requested_end IS NULL OR d_age > 86400000000), count(*) FROM (SELECT *, epoch_us(decision_time) - epoch_us(requested_end) AS d_age FROM j)""", ("decisions_user", "collections"))
def aud_07(v):
    """Decision source coverage is successful and fresh."""
    from tidemark.operators.joins import source_status

    d = source_status(v.decisions_user.select("ticker", "decision_time"), v.collections, ["click"])
    age = F.unix_micros("decision_time") - F.unix_micros("source_coverage_end_click")
    return A.audit(d, {"not_successful": ~F.col("source_status_click").isin("observed", "observed_empty"),
                       "stale_coverage": F.col("source_coverage_end_click").isNull() | (age > 86_400_000_000)}).drop("status")


@query("aud_08", f"""SELECT 'bars' AS section, "check", status, failures, rows_checked FROM ({audit_sql('bars_hour', BAR_RULES)}) UNION ALL SELECT 'events', "check", status, failures, rows_checked FROM ({audit_sql('news', EVENT_RULES)})
UNION ALL SELECT 'fundamentals', 'all', 'not_run', 0, 0""", ("bars_hour", "news"))
def aud_08(v):
    """Composite audit with not_run markers."""
    return A.composite({"bars": A.audit(v.bars_hour, BAR_RULES), "events": A.audit(v.news, EVENT_RULES), "fundamentals": None})


_GAPS = "gp AS (SELECT *, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY ticker, session_date_et ORDER BY timestamp) AS gap FROM bars_hour)"
V3_BARS = {"timestamps": "timestamp IS NULL", "session_gaps": "gap > 3600000000", "ohlcv": "high < low OR open > high OR close > high", "positive_volume": "volume <= 0"}


def gapped(v):
    w = Window.partitionBy("ticker", "session_date_et").orderBy("timestamp")
    return v.bars_hour.withColumn("gap", F.unix_micros("timestamp") - F.unix_micros(F.lag("timestamp").over(w)))


audit_query("aud_09", "gp", gapped, V3_BARS, {"duplicates": ["ticker", "timestamp"]}, ("bars_hour",), "Bars: duplicates, within-session gaps, OHLCV.", "WITH " + _GAPS)
audit_query("aud_10", "news", lambda v: v.news, {"published_after_ingested": "first_seen > feature_available_at", "identity_missing": "event_id IS NULL"}, {"duplicates": ["ticker", "first_seen", "source_family"]}, ("news",), "Events: published before ingested, duplicates.")


@query("aud_11", f"""WITH m AS (SELECT d.decision_id, count(m.snapshot_id) AS k {_MEMBER_JOIN} GROUP BY 1) SELECT count(*) FILTER (WHERE k = 0) AS outside_membership, count(*) AS rows_checked FROM m""", ("memberships", "decisions_cust"))
def aud_11(v):
    """Decisions that lie inside no known membership."""
    return member_match(v, v.decisions_cust).agg(F.count_if(F.col("match_count") == 0).alias("outside_membership"), F.count(F.lit(1)).alias("rows_checked"))


audit_query("aud_12", "supp_dim", lambda v: v.supp_dim, {"sector_missing": "sector IS NULL OR sector = ''", "negative_cap": "market_cap < 0"}, {"one_row_per_ticker": ["ticker"]}, ("supp_dim",), "Benchmark mapping populated.")

DS = ("dataset",)
FEATURES = ("score", "downside", "liquidity")
DEVELOPMENT_UNTIL = "2024-01-25 00:00:00"


_INPUTS = ("one_minute_available_at", "spy_available_at", "qqq_available_at", "sector_available_at", "source_status_available_at_click", "source_status_available_at_view",
           "global_source_status_available_at_macro")
_FUTURE_SQL = " + ".join([_count("feature_available_at IS NULL OR feature_available_at > decision_time"), *[_count(f"{c} > decision_time") for c in _INPUTS]])
_N, _OK = "count(*)", "feature_eligible"


def _source_sql(name: str, prefix: str, scope: str) -> str:
    end, known = f"{prefix}source_coverage_end_{name}", f"{prefix}source_status_available_at_{name}"
    return _count(f"{prefix}source_status_{name} NOT IN ('observed', 'observed_empty') OR {end} IS NULL OR {known} IS NULL OR {end} > {known} OR {end} > decision_time OR epoch_us(decision_time) - epoch_us({end}) > 86400000000", scope)


_COMMON = {"schema": ("0", _N), "rows": ("CAST(count(*) = 0 AS INT)", _N), "timestamps": (_count("decision_time IS NULL") + " + " + _count("feature_available_at IS NULL"), _N), "no_future_features": (_FUTURE_SQL, _N),
           "price_feed": (_count("lower(price_feed) <> 'sip'", _OK), _count(_OK)), "adjustment": (_count("lower(adjustment) <> 'all'", _OK), _count(_OK)),
           "cross_section": (_count("NOT cross_section_eligible", _OK), _count(_OK)), "feature_names": ("0", "3"), "schema_version": (_count("feature_schema_version <> 'v1'"), _N)}
_EXACT = "(feature_eligible AND label_path_exact)"
_INTRADAY_SQL = _COMMON | {
    "benchmark_coverage": (_count("spy_available_at IS NULL OR qqq_available_at IS NULL OR sector_available_at IS NULL", _OK), _count(_OK)),
    "warmup": (_count("five_minute_bar_count < 20 OR one_minute_bar_count < 120 OR NOT five_minute_history_exact OR NOT one_minute_history_exact", _OK) + f" + CAST({_count(_OK)} = 0 AS INT)", _N),
    "exact_label_path": (_count("NOT label_path_exact", "feature_eligible AND label_window_expected"), _count("feature_eligible AND label_window_expected")),
    "label_order": (_count("entry_time IS NULL OR exit_time IS NULL OR label_available_at IS NULL OR label_window_end IS NULL OR entry_time < decision_time OR exit_time <= entry_time OR label_available_at < exit_time OR label_window_end < exit_time", "label_eligible"), _count("label_eligible")),
    "label_values": (_count("path_target_first_60m + path_stop_first_60m + path_timeout_60m <> 1 OR greatest(path_target_first_60m, path_stop_first_60m, path_timeout_60m) > 1", "label_eligible"), _count("label_eligible")),
    "label_costs": (_count("abs(path_realized_return_net_60m - (path_realized_return_gross_60m - 0.001::DOUBLE)) > 1e-12::DOUBLE + 1e-5::DOUBLE * abs(path_realized_return_gross_60m - 0.001::DOUBLE)", "label_eligible"), _count("label_eligible")),
    "label_benchmarks": (_count("future_excess_return_60m_vs_spy IS NULL OR future_excess_return_60m_vs_qqq IS NULL OR future_excess_return_60m_vs_sector IS NULL", _EXACT), _count(_EXACT)),
    "overlap_metadata": (_count("concurrent_label_count < 1 OR overlap_weight <= 0", "label_path_exact"), _count("label_path_exact")),
    "catalyst_timing": (_count("one_minute_available_at > decision_time", "catalyst_eligible"), _count("catalyst_eligible"))}


@query("aud_13", report_sql("dataset", _INTRADAY_SQL, _identity_sql("dataset", "ticker, decision_time") | {
    "group_sessions": (_count("k > 1"), _N, "SELECT count(DISTINCT session_date_et) AS k FROM dataset GROUP BY group_id")}), DS)
def aud_13(v):
    """Intraday dataset: the twenty rules."""
    return DA.intraday_audit(written(v.dataset), 60, FEATURES, min_one_minute_bars=120)


_SWING_SQL = _COMMON | {
    "benchmark_coverage": (_count("spy_available_at IS NULL OR qqq_available_at IS NULL OR sector_available_at IS NULL", "daily_bar_count >= 40"), _count("daily_bar_count >= 40")),
    "source_coverage": (_source_sql("click", "", _OK) + " + " + _source_sql("view", "", _OK), _count(_OK)), "global_source_coverage": (_source_sql("macro", "global_", _OK), _count(_OK)),
    "warmup": (f"CAST({_count(_OK)} = 0 AS INT)", _N), "exact_label_path": (_count("NOT label_path_exact", "feature_eligible AND label_window_expected"), _count("label_window_expected")),
    "label_order": (_count("entry_time <= decision_time OR exit_time <= entry_time OR label_available_at < exit_time", "label_eligible"), _count("label_eligible")),
    "label_values": (_count("target_5d IS NULL OR target_5d NOT IN (0, 1)", "label_eligible"), _count("label_eligible"))}


@query("aud_14", report_sql("dataset", _SWING_SQL, _identity_sql("dataset", "ticker, decision_time")), DS)
def aud_14(v):
    """Swing dataset: the seventeen rules."""
    return DA.swing_audit(written(v.dataset), 5, FEATURES, global_sources=["macro"])


_DATE = lambda c: f"CAST(({c} AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE)"
_TRAIN_SQL = {
    "schema": ("0", _N), "rows": ("CAST(count(*) = 0 AS INT)", _N), "timestamps": (_count("decision_time IS NULL OR feature_available_at IS NULL OR entry_time IS NULL OR exit_time IS NULL"), _N),
    "feature_availability": (_count("feature_available_at > decision_time"), _N), "entry_after_decision": (_count("entry_time <= decision_time"), _N), "exit_before_entry": (_count("exit_time < entry_time"), _N),
    **{f"session_of_{k}": (_count(f"{_DATE(c)} IS DISTINCT FROM session_date_et"), _N) for k, c in (("decision", "decision_time"), ("entry", "entry_time"), ("exit", "exit_time"))},
    "development_only": (_count(f"decision_time > TIMESTAMP '{DEVELOPMENT_UNTIL}'"), _N), "feature_schema": (_count("feature_schema_version <> 'v1'") + " + CAST(count(feature_schema_version) = 0 AS INT)", _N),
    **{f"one_label_{k}": (f"CAST(count(DISTINCT {c}) <> 1 AS INT)", _N) for k, c in (("schema", "label_schema_version"), ("config", "label_config_json"), ("hash", "label_config_hash"))},
    "label_hash": ("CAST(coalesce(sha256(min(label_config_json)) <> min(label_config_hash), true) AS INT)", _N), "label_config_object": ("CAST(coalesce(json_type(min(label_config_json)) <> 'OBJECT', true) AS INT)", _N),
    "price_feed": (_count("lower(trim(coalesce(price_feed, ''))) <> 'sip'"), _N), "universe_snapshot": (_count("trim(coalesce(universe_snapshot_id, '')) = ''"), _N),
    "overlap_weight": (_count("overlap_weight IS NULL OR overlap_weight <= 0 OR overlap_weight > 1"), _N), "binary_stop": (_count("stop_before_target NOT IN (0, 1)"), _N),
    "ranking_target": (_count("ranking_target IS NULL"), _N), "ranking_grade": (_count("ranking_grade < 0 OR ranking_grade % 1 <> 0"), _N), "feature_names": ("0", "3")}


@query("aud_15", report_sql("dataset", _TRAIN_SQL, _identity_sql("dataset", "group_id, ticker") | {
    "one_time_per_group": (_count("k <> 1"), _N, "SELECT count(DISTINCT decision_time) AS k FROM dataset GROUP BY group_id"),
    "group_size": (_count("NOT fits"), _N, "SELECT bool_and(coalesce(ranking_group_size = n, false)) AS fits FROM (SELECT group_id, ranking_group_size, count(*) OVER (PARTITION BY group_id) AS n FROM dataset) GROUP BY group_id")}), DS)
def aud_15(v):
    """Training frame: sessions, order of times, one label configuration, group sizes, weights, grades."""
    return DA.training_audit(written(v.dataset), DEVELOPMENT_UNTIL, FEATURES)


@query("aud_16", """WITH b AS (SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, count(DISTINCT date) AS sessions, max(date) AS last FROM bars_supp), u AS (SELECT count(*) FILTER (WHERE ticker NOT IN (SELECT ticker FROM bars_supp)) AS missing FROM supp_dim),
 k AS (SELECT count(*) AS c FROM bench_market)
SELECT 'minimum_tickers' AS "check", tickers AS observed, 50 AS required, CAST(tickers >= 50 AS BIGINT) AS passed FROM b UNION ALL SELECT 'minimum_sessions', sessions, 250, CAST(sessions >= 250 AS BIGINT) FROM b
UNION ALL SELECT 'members_without_bars', missing, 0, CAST(missing = 0 AS BIGINT) FROM u UNION ALL SELECT 'benchmark_sessions', k.c, b.sessions, CAST(k.c >= b.sessions AS BIGINT) FROM k, b""", ("bars_supp", "supp_dim", "bench_market"))
def aud_16(v):
    """Development readiness: size, members without bars, benchmark span against requirements."""
    b = v.bars_supp.agg(F.countDistinct("ticker").alias("tickers"), F.countDistinct("date").alias("sessions"))
    missing = v.supp_dim.join(v.bars_supp.select("ticker").distinct(), "ticker", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    bench = v.bench_market.agg(F.count(F.lit(1)).alias("bench"))
    one = b.join(F.broadcast(missing)).join(F.broadcast(bench))  # one-row aggregates
    row = lambda name, obs, req, ok: F.struct(F.lit(name).alias("check"), obs.cast("long").alias("observed"), req.cast("int").alias("required"), ok.cast("long").alias("passed"))
    c = F.col
    items = F.array(row("minimum_tickers", c("tickers"), F.lit(50), c("tickers") >= 50), row("minimum_sessions", c("sessions"), F.lit(250), c("sessions") >= 250),
                    row("members_without_bars", c("missing"), F.lit(0), c("missing") == 0), row("benchmark_sessions", c("bench"), c("sessions"), c("bench") >= c("sessions")))
    return one.select(F.inline(items)).withColumn("required", F.col("required").cast("long"))


@query("aud_17", """WITH raw AS (SELECT ticker, CAST(first_seen AS DATE) AS date, count(*) AS c FROM news WHERE relevance >= 0.1 GROUP BY 1, 2), ds AS (SELECT ticker, date, CAST(volume AS BIGINT) AS news_count FROM bars_user)
SELECT count(*) AS dates, count(*) FILTER (WHERE raw.c IS NULL) AS missing_dates, count(*) FILTER (WHERE raw.c <> ds.news_count) AS count_mismatches, CAST(sum(ds.news_count - coalesce(raw.c, 0)) AS BIGINT) AS row_difference FROM ds LEFT JOIN raw USING (ticker, date)""", ("news", "bars_user"))
def aud_17(v):
    """News/candle alignment: raw events per date against the dataset's counts."""
    raw = v.news.where("relevance >= 0.1").groupBy("ticker", F.to_date("first_seen").alias("date")).agg(F.count(F.lit(1)).alias("c"))
    j = v.bars_user.select("ticker", "date", F.col("volume").cast("long").alias("news_count")).join(raw, ["ticker", "date"], "left")
    return j.agg(F.count(F.lit(1)).alias("dates"), F.count_if(F.col("c").isNull()).alias("missing_dates"), F.count_if(F.col("c") != F.col("news_count")).alias("count_mismatches"),
                 F.sum(F.col("news_count") - F.coalesce("c", F.lit(0))).alias("row_difference"))


audit_query("aud_18", "evidence_x", lambda v: v.evidence, {"future_features": "decision_time > entry_time", "path_mismatch": "target = 1 AND ret < 0", "probability_missing": "score IS NULL"}, None, EX, "Prediction/dataset alignment.")

_DF = ("score", "downside", "ret", "sparse")
_pr = lambda w: PROFILE_SQL.replace("FROM p", f"FROM p WHERE {w}").replace("round(", "(").replace(", 6)", ")")


@query("aud_19", f"""WITH p AS (SELECT *, CASE WHEN liquidity >= 2 THEN liquidity END AS sparse FROM evidence_x), a AS ({_pr("session < DATE '2024-01-15'")}), b AS ({_pr("session >= DATE '2024-01-15' AND liquidity >= 3")}),
 j AS (SELECT feature, abs(b.mean - a.mean) / greatest(abs(coalesce(a.std, 0)), 1e-6) AS sh, abs(b.missing_rate - a.missing_rate) AS g FROM a JOIN b USING (feature))
SELECT feature, round(sh, 6) AS standardized_mean_shift, round(g, 6) AS missing_rate_delta, CASE WHEN sh >= 4 OR g >= 0.5 THEN 'severe' WHEN sh >= 2 OR g >= 0.2 THEN 'warning' ELSE 'stable' END AS status FROM j""", EX)
def aud_19(v):
    """Feature drift of a live slice against the training profile."""
    d = v.evidence.withColumn("sparse", F.when(F.col("liquidity") >= 2, F.col("liquidity")))
    ref = profile(d.where("session < date '2024-01-15'"), _DF)
    live = profile(d.where("session >= date '2024-01-15' and liquidity >= 3"), _DF)
    return A.drift(live, ref).select("feature", r("standardized_mean_shift"), r("missing_rate_delta"), "status")


@query("top_11", f"""WITH p AS (SELECT *, CASE WHEN liquidity >= 2 THEN liquidity END AS sparse FROM evidence_x), a AS ({_pr("session < DATE '2024-01-15'")}), b AS ({_pr("session >= DATE '2024-01-15' AND liquidity >= 3")})
SELECT feature, round(greatest(abs(b.mean - a.mean) / greatest(abs(coalesce(a.std, 0)), 1e-6), abs(b.missing_rate - a.missing_rate)), 6) AS severity FROM a JOIN b USING (feature) ORDER BY severity DESC, feature LIMIT 10""", EX)
def top_11(v):
    """Largest drift rows."""
    d = v.evidence.withColumn("sparse", F.when(F.col("liquidity") >= 2, F.col("liquidity")))
    out = A.drift(profile(d.where("session >= date '2024-01-15' and liquidity >= 3"), _DF), profile(d.where("session < date '2024-01-15'"), _DF))
    return out.select("feature", r(F.greatest("standardized_mean_shift", "missing_rate_delta"), "severity")).orderBy(F.desc("severity"), "feature").limit(10)


@query("aud_20", """WITH e AS (SELECT * FROM news WHERE relevance >= 0.3), c AS (SELECT count(DISTINCT d.ticker) AS t, count(DISTINCT e.ticker) AS h, count(*) AS k FROM decisions_user d LEFT JOIN (SELECT DISTINCT ticker FROM e) e USING (ticker))
SELECT c.k AS decision_rows, round(c.h::DOUBLE / c.t, 6) AS ticker_coverage, round((SELECT count(sentiment)::DOUBLE / count(*) FROM e), 6) AS sentiment_coverage, CAST(c.k >= 1000 AND c.h::DOUBLE / c.t >= 0.95 AND (SELECT count(sentiment)::DOUBLE / count(*) FROM e) >= 0.8 AS BIGINT) AS ready,
 CAST((SELECT min(first_seen) FROM e) <= TIMESTAMP '2024-01-01' + INTERVAL 24 HOUR AND (SELECT max(first_seen) FROM e) >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR AS BIGINT) AS boundaries_covered FROM c""", ("news", "decisions_user"))
def aud_20(v):
    """Overlay readiness: ticker coverage, sentiment coverage, row minimum, boundary gaps."""
    e = v.news.where("relevance >= 0.3")
    have = e.select("ticker").distinct().withColumn("hit", F.col("ticker"))
    c = v.decisions_user.join(have, "ticker", "left").agg(F.countDistinct("ticker").alias("t"), F.countDistinct("hit").alias("h"), F.count(F.lit(1)).alias("k"))
    q = e.agg((F.count("sentiment") / F.count(F.lit(1))).alias("sc"), F.min("first_seen").alias("f"), F.max("first_seen").alias("l"))
    j = c.join(F.broadcast(q))  # one-row aggregates
    cov = F.col("h") / F.col("t")
    bound = (F.col("f") <= F.lit("2024-01-02").cast("timestamp")) & (F.col("l") >= F.lit("2024-01-30").cast("timestamp"))
    return j.select(n("k", "decision_rows"), r(cov, "ticker_coverage"), r("sc", "sentiment_coverage"), n((F.col("k") >= 1000) & (cov >= 0.95) & (F.col("sc") >= 0.8), "ready"), n(bound, "boundaries_covered"))


@query("aud_21", """SELECT source, count(*) AS rows_in, count(*) FILTER (WHERE coalesce(title, '') = '') AS missing_required_rows_removed,
 count(*) FILTER (WHERE title <> '') - count(DISTINCT (lang, title)) FILTER (WHERE title <> '') AS duplicate_rows_removed FROM headlines GROUP BY 1""", ("headlines",))
def aud_21(v):
    """Verification report grouped by source file."""
    h = v.headlines
    bad = F.coalesce("title", F.lit("")) == ""
    base = h.groupBy("source").agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(bad).alias("missing_required_rows_removed"))
    d = h.where(~bad).groupBy("source", "lang", "title").agg(F.count(F.lit(1)).alias("c")).groupBy("source").agg(F.sum(F.col("c") - 1).alias("dup"))
    return base.join(d, "source", "left").select("source", "rows_in", "missing_required_rows_removed", F.coalesce("dup", F.lit(0)).alias("duplicate_rows_removed"))


_LIVE = "lv AS (SELECT * FROM dataset WHERE decision_time = (SELECT max(decision_time) FROM dataset) AND feature_eligible)"
_LIVE_COLUMNS = ("ticker", "group_id", "session_date_et", "decision_time", "feature_available_at", *_INPUTS, "five_minute_bar_count", "one_minute_bar_count", "five_minute_history_exact", "one_minute_history_exact", "feature_eligible", "cross_section_eligible",
                 "catalyst_eligible", "price_feed", "adjustment", "feature_schema_version", *FEATURES, *[f"{p}{c}_{k}" for c in ("source_status", "source_coverage_end") for p, k in (("", "click"), ("", "view"), ("global_", "macro"))], "label_window_end")
_LIVE_SQL = {k: _COMMON[k] for k in ("schema", "rows", "timestamps", "no_future_features")} | {
    "decision_group": ("greatest(0, count(DISTINCT group_id) - 1)", _N), "cutoff_contract": ("0", _N), "no_labels": ("1", str(len(_LIVE_COLUMNS))),
    "sources": (" + ".join(_source_sql(k, p, "true") for p, k in (("", "click"), ("", "view"), ("global_", "macro"))), _N), "price_feed": (_count("lower(price_feed) <> 'sip'"), _N), "adjustment": (_count("lower(adjustment) <> 'all'"), _N),
    "warmup": (" + ".join(_count(x) for x in ("five_minute_bar_count < 20", "one_minute_bar_count < 120", "NOT five_minute_history_exact", "NOT one_minute_history_exact")), _N),
    "cross_section": ("CAST(count(*) < 5 AS INT) + " + _count("NOT cross_section_eligible"), _N), "catalyst": (_count("NOT catalyst_eligible"), _N), "schema_version": (_count("feature_schema_version <> 'v1'"), _N)}


def live(v):
    """Newest decision group and its report; one label column is left in, so that its rule has something to find."""
    return DA.live_audit(written(v.dataset.select(*_LIVE_COLUMNS)), "intraday", FEATURES, min_one_minute_bars=120, global_sources=["macro"])


@query("aud_22", report_sql("lv", _LIVE_SQL, _identity_sql("lv", "ticker, decision_time"), f"WITH {_LIVE}"), DS)
def aud_22(v):
    """Live snapshot: the fifteen rules over the newest decision group."""
    return live(v)[1]


@query("aud_22w", f"WITH {_LIVE} " + " UNION ALL ".join(
    f"""SELECT '{kind}:{k}' AS source, CASE WHEN {bad} = 0 THEN epoch_us(min({p}source_coverage_end_{k})) END AS watermark, {bad} AS invalid_rows FROM lv"""
    for kind, p, k in (("ticker", "", "click"), ("ticker", "", "view"), ("global", "global_", "macro")) for bad in (_count(f"{p}source_coverage_end_{k} IS NULL OR {p}source_coverage_end_{k} > decision_time"),)), DS)
def aud_22w(v):
    """Source watermarks of the live snapshot: the earliest coverage end."""
    return DA.watermarks(live(v)[0]).select("source", us("watermark"), "invalid_rows")


@query("aud_22s", """WITH m AS (SELECT max(completed_at) AS now FROM collections), c AS (SELECT ticker, source_family, max(requested_end) FILTER (WHERE status IN ('observed', 'observed_empty')) AS cov, count(*) FILTER (WHERE status = 'failed') AS failed FROM collections GROUP BY 1, 2),
 s AS (SELECT source_family, min(cov) AS cov, count(*) FILTER (WHERE cov IS NULL) AS never, CAST(sum(failed) AS BIGINT) AS failed FROM c GROUP BY 1)
SELECT source_family, epoch_us(cov) AS watermark, failed AS failed_attempts, never AS tickers_without_coverage, CAST(cov IS NULL OR epoch_us(now) - epoch_us(cov) > 3600000000 AS BIGINT) AS stale FROM s, m""", ("collections",))
def aud_22s(v):
    """Watermark of each source's log: the earliest of its tickers' latest coverage ends, failures and staleness."""
    ok = F.col("status").isin("observed", "observed_empty")
    each = v.collections.groupBy("ticker", "source_family").agg(F.max(F.when(ok, F.col("requested_end"))).alias("cov"), F.count_if(F.col("status") == "failed").alias("failed"), F.max("completed_at").alias("last"))
    g = each.groupBy("source_family").agg(F.min("cov").alias("cov"), F.count_if(F.col("cov").isNull()).alias("tickers_without_coverage"), F.sum("failed").alias("failed_attempts"), F.max("last").alias("last"))
    now = F.max("last").over(Window.partitionBy(F.lit(0)))  # one row per source
    return g.select("source_family", us("cov", "watermark"), "failed_attempts", "tickers_without_coverage", n(F.col("cov").isNull() | (F.unix_micros(now) - F.unix_micros("cov") > 3_600_000_000), "stale"))


@query("aud_23", """WITH m AS (SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM evidence_x UNION ALL SELECT 'win_rate', avg(CAST(ret > 0 AS INT)) FROM evidence_x UNION ALL SELECT 'brier_score', avg((score - target) * (score - target)) FROM evidence_x UNION ALL SELECT 'sessions', count(DISTINCT session) FROM evidence_x),
 t AS (SELECT * FROM (VALUES ('rows', 'min', 100.0::DOUBLE), ('win_rate', 'min', 0.9::DOUBLE), ('brier_score', 'max', 0.1::DOUBLE), ('sessions', 'min', 20.0::DOUBLE), ('ndcg', 'min', 0.5::DOUBLE)) x(metric, kind, "limit"))
SELECT metric, kind, "limit", round(value, 6) AS value FROM t LEFT JOIN m USING (metric) WHERE value IS NULL OR (kind = 'min' AND value < "limit") OR (kind = 'max' AND value > "limit")""", EX)
def aud_23(v):
    """Promotion gates: metrics against thresholds, failing rows."""
    e = v.evidence
    one = e.agg(F.count(F.lit(1)).cast("double").alias("rows"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
                F.avg((F.col("score") - F.col("target")) * (F.col("score") - F.col("target"))).alias("brier_score"), F.countDistinct("session").cast("double").alias("sessions"))
    metrics = one.unpivot([], ["rows", "win_rate", "brier_score", "sessions"], "metric", "value")
    limits = v.spark.createDataFrame([("rows", "min", 100.0), ("win_rate", "min", 0.9), ("brier_score", "max", 0.1), ("sessions", "min", 20.0), ("ndcg", "min", 0.5)], "metric string, kind string, limit double")
    return V.gates(metrics, limits).select("metric", "kind", "limit", r("value"))


audit_query("aud_24", "evidence_x", lambda v: v.evidence, {"feature_after_decision": "session > decision_time", "entry_not_after_decision": "entry_time <= decision_time", "flag_disagrees_with_count": "(regime = 'risk_off') <> (liquidity < 2)"}, None, EX, "Decision identity and coverage rules.")
audit_query("aud_25", "memberships", lambda v: v.memberships, {"window_order": "effective_to <= effective_from", "known_after_start": "available_at > effective_from", "open_ended": "effective_to IS NULL"}, {"identity": ["ticker", "effective_from"]}, ("memberships",), "Contract rules as row predicates.")


@query("aud_26", """SELECT event_id AS trade_id, concat_ws(',', CASE WHEN k % 6 = 0 THEN 'evaluation_not_after_decision' END, CASE WHEN sentiment IS NULL THEN 'prediction_missing' END, CASE WHEN k % 4 = 1 THEN 'model_created_after_decision' END, CASE WHEN k % 9 = 2 THEN 'training_extends_past_decision' END) AS reasons FROM news""", ("news",))
def aud_26(v):
    """Replay validity reasons: evaluation order, prediction presence, model and training before the decision."""
    dec = F.col("first_seen")
    t = v.news.withColumns({
        "evaluation": dec + F.make_dt_interval(hours=F.when(F.col("k") % 6 == 0, -1).otherwise(2)), "created": dec + F.make_dt_interval(hours=F.when(F.col("k") % 4 == 1, 1).otherwise(-1)),
        "trained": dec + F.make_dt_interval(hours=F.when(F.col("k") % 9 == 2, 1).otherwise(-1))})
    reasons = F.array_compact(F.array(
        F.when(F.col("evaluation") <= dec, "evaluation_not_after_decision"), F.when(F.col("sentiment").isNull(), "prediction_missing"),
        F.when(F.col("created") > dec, "model_created_after_decision"), F.when(F.col("trained") > dec, "training_extends_past_decision")))
    return t.select(F.col("event_id").alias("trade_id"), F.array_join(reasons, ",").alias("reasons"))


# --- filters -----------------------------------------------------------------------------------------------------
@query("flt_01", "SELECT ticker, epoch_us(timestamp) AS timestamp FROM bars_hour WHERE minute_et BETWEEN 585 AND 895 AND ((minute_et - 570) // 30) % 2 = 1", ("bars_hour",))
def flt_01(v):
    """Decision grid: minute bounds and slot stride."""
    slot = F.floor((F.col("minute_et") - 570) / 30)
    return v.bars_hour.where(F.col("minute_et").between(585, 895) & (F.pmod(slot, F.lit(2)) == 1)).select("ticker", us("timestamp"))


@query("flt_02", """WITH b AS (SELECT *, row_number() OVER (PARTITION BY ticker, session_date_et ORDER BY timestamp) - 1 AS i, (datediff('day', DATE '0001-01-01', session_date_et) + 1) % 3 AS off FROM bars_hour WHERE minute_et BETWEEN 570 AND 959)
SELECT ticker, epoch_us(timestamp) AS timestamp FROM b WHERE i >= off AND (i - off) % 3 = 0""", ("bars_hour",))
def flt_02(v):
    """Stride with a per-session rotating offset."""
    w = Window.partitionBy("ticker", "session_date_et").orderBy("timestamp")
    d = v.bars_hour.where("minute_et between 570 and 959").withColumns({"i": F.row_number().over(w) - 1, "off": stride_offset("session_date_et", 3)})
    return d.where((F.col("i") >= F.col("off")) & (F.pmod(F.col("i") - F.col("off"), F.lit(3)) == 0)).select("ticker", us("timestamp"))


@query("flt_03", """SELECT scope, ticker, epoch_us(timestamp) AS timestamp FROM bars_hour JOIN (VALUES ('premarket', 240, 569), ('opening', 570, 689), ('regular', 570, 959)) s(scope, a, b) ON minute_et BETWEEN a AND b WHERE close > 100""", ("bars_hour",))
def flt_03(v):
    """Session scopes with a minimum score."""
    scopes = {"premarket": (240, 569), "opening": (570, 689), "regular": (570, 959)}
    hit = F.array_compact(F.array(*[F.when(F.col("minute_et").between(*b), k) for k, b in scopes.items()]))
    return v.bars_hour.where("close > 100").select(F.explode(hit).alias("scope"), "ticker", us("timestamp"))


_GRID = """days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS d), ses AS (SELECT d FROM days WHERE dayofweek(d) BETWEEN 1 AND 5),
 grid AS (SELECT d, unnest(generate_series(d + INTERVAL 14 HOUR, d + INTERVAL 20 HOUR, INTERVAL 1 HOUR)) AS g FROM ses)"""


@query("flt_04", f"""WITH {_GRID} SELECT b.ticker, CAST(grid.d AS VARCHAR) AS session, count(*) AS on_grid, 7 - count(*) AS missing FROM bars_hour b JOIN grid ON grid.g = b.bar_start GROUP BY 1, 2""", ("bars_hour",))
def flt_04(v):
    """Restrict bars to the calendar grid (14:00-20:00 UTC hours of weekdays) and count what each session lacks."""
    dates = v.t("events").select(F.to_date("ts").alias("d"))
    days = dates.agg(F.min("d").alias("a"), F.max("d").alias("z")).select(F.explode(F.sequence("a", "z")).alias("session")).where(~F.dayofweek("session").isin(1, 7))
    at = lambda h: F.col("session").cast("timestamp") + F.expr(f"interval {h} hours")
    grid = days.select("session", F.explode(F.sequence(at(14), at(20), F.expr("interval 1 hour"))).alias("bar_start"))
    return v.bars_hour.join(grid, "bar_start").groupBy("ticker", s("session")).agg(F.count(F.lit(1)).alias("on_grid")).withColumn("missing", 7 - F.col("on_grid"))


@query("flt_05", """WITH c AS (SELECT ticker, count(*) AS k, count(*) FILTER (WHERE target = 1) AS l FROM evidence_x GROUP BY 1) SELECT e.ticker, count(*) AS rows FROM evidence_x e JOIN c USING (ticker) WHERE c.k >= 20 AND c.l >= 8 GROUP BY 1""", EX)
def flt_05(v):
    """Ticker eligibility by history depth and label count."""
    ok = v.evidence.groupBy("ticker").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("target") == 1).alias("l")).where("k >= 20 and l >= 8").select("ticker")
    return v.evidence.join(ok, "ticker", "left_semi").groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))


@query("flt_06", """WITH g AS (SELECT group_id, count(*) FILTER (WHERE liquidity >= 2 AND downside < 1) AS k FROM evidence_x GROUP BY 1) SELECT ticker, group_id, CAST(liquidity >= 2 AND downside < 1 AND k >= 15 AS BIGINT) AS feature_eligible FROM evidence_x JOIN g USING (group_id)""", EX)
def flt_06(v):
    """Feature eligibility: row conditions and eligible cross-section size."""
    ok = (F.col("liquidity") >= 2) & (F.col("downside") < 1)
    g = v.evidence.groupBy("group_id").agg(F.count_if(ok).alias("k"))
    return v.evidence.join(g, "group_id").select("ticker", "group_id", n(ok & (F.col("k") >= 15), "feature_eligible"))


@query("flt_07", f"WITH {_CAND} SELECT ticker, round(price, 6) AS price, volume, round(chg, 6) AS change_pct FROM f")
def flt_07(v):
    """Candidate screen by price, volume and absolute change."""
    return candidates(v).select("ticker", r("price"), "volume", r("chg", "change_pct"))


@query("flt_08", "SELECT event_id FROM news WHERE first_seen <= TIMESTAMP '2024-01-20 12:00:00' AND first_seen >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 48 HOUR", ("news",))
def flt_08(v):
    """Events until an end time within a lookback."""
    end = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return v.news.where((F.col("first_seen") <= end) & (F.col("first_seen") >= end - F.expr("interval 48 hours"))).select("event_id")


@query("flt_09", "SELECT ticker, CAST(session AS VARCHAR) AS session FROM evidence_x WHERE CAST(score > 0.5 AS INT) + CAST(liquidity >= 2 AS INT) + CAST(downside < 0.9 AS INT) >= 2", EX)
def flt_09(v):
    """Setup-only rows by score threshold."""
    score = sum(c.cast("int") for c in (F.col("score") > 0.5, F.col("liquidity") >= 2, F.col("downside") < 0.9))
    return v.evidence.where(score >= 2).select("ticker", s("session"))


@query("flt_10", """SELECT ticker, epoch_us(max(decision_time)) AS decision_time FROM evidence_x WHERE decision_time <= TIMESTAMP '2024-01-20 01:00:00' AND exit_time <= TIMESTAMP '2024-01-20 02:00:00' AND user_id % 7 = 3 GROUP BY 1""", EX)
def flt_10(v):
    """Serving filter: available and decided by as_of, requested tickers only."""
    at = F.lit("2024-01-20 01:00:00").cast("timestamp")
    wanted = v.evidence.where("user_id % 7 = 3").select("ticker").distinct()
    d = v.evidence.where((F.col("decision_time") <= at) & (F.col("exit_time") <= at + F.expr("interval 1 hour"))).join(wanted, "ticker", "left_semi")
    return d.groupBy("ticker").agg(us(F.max("decision_time"), "decision_time"))


# Prefixes that only labels carry, and the feature families by prefix.
FORBIDDEN = ("target", "ret", "future_", "label_", "net_", "exit_", "entry_")
CATALYST = ("news_", "event_", "sentiment_", "source_count_", "reddit_")


def forbidden_columns(columns):
    return [c for c in columns if any(c == p or c.startswith(p) for p in FORBIDDEN)]


def feature_family(columns, family: str):
    cat = [c for c in columns if c.startswith(CATALYST)]
    return {"all": list(columns), "catalyst": cat, "technical": [c for c in columns if c not in cat]}[family]


@query("flt_11", "SELECT ticker, CAST(session AS VARCHAR) AS session, round(score, 6) AS score, round(downside, 6) AS downside, liquidity FROM evidence_x", EX)
def flt_11(v):
    """Live projection without any forbidden (label) column, decided from the schema."""
    keep = [c for c in ("ticker", "session", "score", "downside", "liquidity", "target", "ret") if c not in forbidden_columns(v.evidence.columns)]
    return v.evidence.select(*[{"session": s("session"), "score": r("score"), "downside": r("downside")}.get(c, F.col(c)) for c in keep])


@query("flt_12", """SELECT ticker, CAST(CAST(first_seen AS DATE) AS VARCHAR) AS date, count(*) AS news_count, round(avg(coalesce(sentiment, 0)), 6) AS sentiment_mean FROM news GROUP BY 1, 2""", ("news",))
def flt_12(v):
    """Feature-family projection by name prefix."""
    d = v.news.groupBy("ticker", F.to_date("first_seen").alias("date")).agg(
        F.count(F.lit(1)).alias("news_count"), r(F.avg(F.coalesce("sentiment", F.lit(0.0))), "sentiment_mean"), F.max("value").alias("close_max"))
    return d.select("ticker", s("date"), *feature_family([c for c in d.columns if c not in ("ticker", "date")], "catalyst"))


_FOLD = "CASE WHEN session < DATE '2024-01-11' THEN 1 WHEN session < DATE '2024-01-21' THEN 2 ELSE 3 END"
_cov = " UNION ALL ".join(f"SELECT '{f}' AS feature, {_FOLD} AS fold, avg(CASE WHEN {f} IS NOT NULL THEN 1 ELSE 0 END) AS rate FROM p GROUP BY ALL" for f in _DF)


@query("flt_13", f"WITH p AS (SELECT *, CASE WHEN liquidity >= 2 THEN liquidity END AS sparse FROM evidence_x), c AS ({_cov}) SELECT feature, round(min(rate), 6) AS minimum_rate, CAST(min(rate) >= 0.6 AS BIGINT) AS keep FROM c GROUP BY 1", EX)
def flt_13(v):
    """Feature coverage per fold; kept only when every fold reaches the rate."""
    fold = F.when(F.col("session") < F.lit("2024-01-11").cast("date"), 1).when(F.col("session") < F.lit("2024-01-21").cast("date"), 2).otherwise(3)
    d = v.evidence.withColumns({"sparse": F.when(F.col("liquidity") >= 2, F.col("liquidity")), "fold": fold})
    c = X.unpivot(d, ["fold"], _DF).groupBy("feature", "fold").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("rate"))
    return c.groupBy("feature").agg(r(F.min("rate"), "minimum_rate"), n(F.min("rate") >= 0.6, "keep"))


@query("flt_14", f"""WITH p AS (SELECT *, CASE WHEN liquidity >= 2 THEN liquidity END AS sparse FROM evidence_x WHERE session < DATE '2024-01-11') {' UNION ALL '.join(f"SELECT '{f}' AS feature, round(avg(CASE WHEN {f} IS NOT NULL THEN 1 ELSE 0 END), 6) AS observed_rate FROM p" for f in _DF)}""", EX)
def flt_14(v):
    """Non-null rate of each feature in the first training window."""
    d = v.evidence.where("session < date '2024-01-11'").withColumn("sparse", F.when(F.col("liquidity") >= 2, F.col("liquidity")))
    return X.unpivot(d, [], _DF).groupBy("feature").agg(r(F.avg(F.col("value").isNotNull().cast("double")), "observed_rate"))
