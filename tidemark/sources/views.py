"""Market-domain views of the driver tables, as DataFrames and as the SQL that defines them.

======================  ==========================================================
bars_supp               daily bars per supplier from lineitem (hundreds of bars each)
bars_hour               hourly bars per event type from events
bars_user               daily bars per user from events (wide cross-sections)
bench_market/_sector    mean bar per date, and per (region, date)
news                    canonical events per user with availability times
decisions_user          one decision per user bar, 30 s after the bar ends
collections             source-collection log per (user, event type)
facts / memberships     order history as fundamental facts and SCD-2 intervals
headlines               documents as news items (title = first line)
evidence                scored cross-section with forward outcome per (user, day)
attributed              evidence with eight forward outcomes and nine diagnostic dimensions
dataset                 evidence as a dataset with availability times, source states, labels and flags, some of them faulty
======================  ==========================================================
"""
from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import ieee_ratio
from tidemark.functions.clock import et_date, et_minute
from tidemark.session import written
from tidemark.sources.tables import table

ET = "America/New_York"


def bars(df: DataFrame, keys: list, price: str, volume, order: list[str]) -> DataFrame:
    """OHLCV roll-up: first/max/min/last/sum of a price, map-side combinable."""
    o = F.struct(*order)
    return df.groupBy(*keys).agg(
        F.min_by(price, o).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, o).alias("close"), volume.alias("volume"),
    )


class Views:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.dir = spark, directory

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def path(self, name: str) -> str:
        return f"{self.dir.rstrip('/')}/{name}.parquet"

    @cached_property
    def bars_supp(self) -> DataFrame:
        li = self.t("lineitem").select(
            F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), F.to_date("l_shipdate").alias("date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity",
            "l_orderkey", "l_linenumber", "l_extendedprice",
        )
        return bars(li, ["ticker", "date"], "price", F.sum("l_quantity"),
                    ["l_orderkey", "l_linenumber", "l_extendedprice"])

    @cached_property
    def supp_dim(self) -> DataFrame:
        return (
            self.t("supplier").join(self.t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"), F.col("r_name").alias("sector"),
                    F.col("n_name").alias("industry"), F.col("s_acctbal").alias("market_cap"))
        )

    @cached_property
    def bench_market(self) -> DataFrame:
        return self.bars_supp.groupBy("date").agg(
            F.avg("open").alias("b_open"), F.avg("close").alias("b_close"), F.sum("volume").alias("b_volume"))

    @cached_property
    def bench_sector(self) -> DataFrame:
        return self.bars_supp.join(self.supp_dim.select("ticker", "sector"), "ticker").groupBy("sector", "date").agg(
            F.avg("open").alias("s_open"), F.avg("close").alias("s_close"))

    @cached_property
    def bars_hour(self) -> DataFrame:
        ev = self.t("events").withColumns({
            "ticker": F.upper("event_type"), "bar_start": F.date_trunc("hour", "ts")})
        b = bars(ev, ["ticker", "bar_start"], "value", F.count(F.lit(1)).cast("double"), ["ts", "event_id"])
        end = F.col("bar_start") + F.expr("interval 1 hour")
        return b.withColumn("timestamp", end).withColumns({
            "session_date_et": et_date("timestamp"), "minute_et": et_minute("timestamp"),
            "available_at": F.col("timestamp") + F.expr("interval 30 seconds")})

    @cached_property
    def bars_user(self) -> DataFrame:
        ev = self.t("events").withColumns({
            "ticker": F.concat(F.lit("U"), F.col("user_id")), "date": F.to_date("ts")})
        return bars(ev, ["ticker", "date"], "value", F.count(F.lit(1)).cast("double"), ["ts", "event_id"])

    @cached_property
    def decisions_user(self) -> DataFrame:
        return self.bars_user.select(
            "ticker", "date", "close", "volume",
            (F.date_add("date", 1).cast("timestamp") + F.expr("interval 30 seconds")).alias("decision_time"))

    @cached_property
    def news(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        scored = F.when(k % 2 == 1, F.col("ts") + F.expr("interval 5 minutes"))
        return self.t("events").select(
            "event_id", F.concat(F.lit("U"), F.col("user_id")).alias("ticker"),
            F.col("event_type").alias("source_family"), F.col("ts").alias("first_seen"),
            k.alias("k"), "value", "props",
            F.when(k % 7 != 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("value") / 250 - 1))).alias("sentiment"),
            (k / F.lit(50.0)).alias("relevance"),
            F.greatest("ts", scored).alias("feature_available_at"),
        )

    @cached_property
    def collections(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), k % 5 + 1)
        return self.t("events").select(
            F.col("event_id").alias("collection_id"), F.concat(F.lit("U"), F.col("user_id")).alias("ticker"),
            F.col("event_type").alias("source_family"), F.col("ts").alias("completed_at"),
            (F.col("ts") - F.expr("interval 10 minutes")).alias("requested_end"),
            status.alias("status"), F.when(status == "observed", k + 1).otherwise(0).cast("long").alias("row_count"))

    @cached_property
    def facts(self) -> DataFrame:
        return self.t("orders").select(
            F.concat(F.lit("C"), F.col("o_custkey")).alias("ticker"),
            F.lower(F.substring("o_orderpriority", 3, 20)).alias("metric"), F.col("o_totalprice").alias("value"),
            F.col("o_orderdate").alias("available_at"), F.col("o_orderkey").alias("fact_id"))

    @cached_property
    def decisions_cust(self) -> DataFrame:
        return self.t("orders").select(
            F.col("o_orderkey").alias("decision_id"), F.concat(F.lit("C"), F.col("o_custkey")).alias("ticker"),
            (F.col("o_orderdate") + F.expr("interval 45 days")).alias("decision_time"))

    @cached_property
    def memberships(self) -> DataFrame:
        one = self.t("orders").groupBy(F.concat(F.lit("C"), F.col("o_custkey")).alias("ticker"),
                                       F.col("o_orderdate").alias("effective_from")).agg(
            F.max(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority")).alias("m"))
        w = Window.partitionBy("ticker").orderBy("effective_from")
        return one.select(
            "ticker", "effective_from", F.lead("effective_from").over(w).alias("effective_to"),
            F.when(F.col("m.o_orderkey") % 2 == 0, F.col("effective_from"))
            .otherwise(F.col("effective_from") + F.expr("interval 3 days")).alias("available_at"),
            F.col("m.o_orderkey").alias("snapshot_id"), F.col("m.o_orderstatus").alias("sector"),
            F.col("m.o_orderpriority").alias("liquidity_bucket"))

    @cached_property
    def headlines(self) -> DataFrame:
        lines = F.split("text", "\n", 2)
        return self.t("documents").select(
            "doc_id", "lang", "source", lines.getItem(0).alias("title"),
            F.when(F.size(lines) > 1, lines.getItem(1)).alias("summary"), "text",
            (F.lit("2024-01-01 00:00:00").cast("timestamp")
             + F.make_dt_interval(mins=(F.col("doc_id") * 7919 % 43200).cast("int"))).alias("published"))

    @cached_property
    def evidence(self) -> DataFrame:
        b = self.bars_user.alias("b")
        nxt = self.bars_user.select(F.col("ticker"), F.date_sub("date", 1).alias("date"),
                                    F.col("open").alias("n_open"), F.col("close").alias("n_close"))
        j = b.join(nxt, ["ticker", "date"])
        return j.select(
            "ticker", F.col("date").alias("session"), ieee_ratio("close", F.col("high") + F.col("open")).alias("score"),
            F.least(F.lit(1.0), F.col("low") / (F.col("close") + 1)).alias("downside"),
            (F.least(F.lit(0.2), F.greatest(F.lit(-0.2), (F.col("n_close") - F.col("n_open")) / 1000.0)) - 0.001).alias("ret"),
            F.when(F.col("n_close") > F.col("n_open"), 1).otherwise(0).cast("long").alias("target"),
            F.when(F.col("volume") >= 3, "risk_on").when(F.col("volume") >= 2, "neutral").otherwise("risk_off").alias("regime"),
            F.col("volume").alias("liquidity"),
        ).withColumns({
            "user_id": F.substring("ticker", 2, 20).cast("long"),
            "grade": F.greatest(F.lit(0), F.least(F.lit(4), F.floor((F.col("ret") + 0.201) / 0.4 * 5))).cast("long"),
        }).withColumns({
            "scope": F.when(F.col("user_id") % 5 == 0, "ticker_holdout").otherwise("walk_forward"),
            "slot": F.col("user_id") % 3,
        }).withColumn("group_id", F.concat_ws("/", F.col("session").cast("string"), F.col("slot").cast("string"))).withColumns({
            "decision_time": F.col("session").cast("timestamp") + F.make_dt_interval(hours=F.col("slot").cast("int"), secs=F.lit(30)),
        }).withColumns({
            "entry_time": F.col("decision_time") + F.expr("interval 5 minutes"),
            "exit_time": F.col("decision_time") + F.make_dt_interval(mins=(F.lit(35) + 60 * F.col("slot")).cast("int")),
        })

    @cached_property
    def attributed(self) -> DataFrame:
        from tidemark.operators import diagnostics as D
        from tidemark.operators.crosssection import rank_features
        from tidemark.operators.features import blocks
        from tidemark.operators.ordered import frame, own

        w = frame(["ticker"])
        b = own(blocks(self.bars_user, "date", back=0, ahead=5).withColumns({"_next": F.lead("open").over(w), **{f"_c{k}": F.lead("close", k).over(w) for k in HORIZONS.values()}}))
        net = {f"net_return_{h}": F.coalesce(F.least(F.lit(0.2), F.greatest(F.lit(-0.2), (F.col(f"_c{k}") - F.col("_next")) / 1000.0)) - 0.001, F.lit(0.0)) for h, k in HORIZONS.items()}
        e = written(self.evidence.join(b.select("ticker", F.col("date").alias("session"), *[c.alias(k) for k, c in net.items()]), ["ticker", "session"]))  # read three times
        market = e.groupBy("group_id").agg(*[F.avg(f"net_return_{h}").alias(f"_m_{h}") for h in HORIZONS])
        pct = rank_features(e, ["group_id"], "ticker", ["liquidity", "downside"]).select("group_id", "ticker", "pct_liquidity", "pct_downside")
        minute = et_minute("decision_time")
        return e.join(market, "group_id").join(pct, ["group_id", "ticker"]).withColumns({
            **{f"net_excess_{h}": F.col(f"net_return_{h}") - F.col(f"_m_{h}") for h in HORIZONS},
            "month": F.date_format("session", "yyyy-MM"), "fold_bucket": D.or_unknown(F.when(F.dayofmonth("session") > 7, F.floor((F.dayofmonth("session") - 1) / 7)), "-1"),
            "time_bucket": D.time_bucket(minute, {"evening": 1140, "late_evening": 1200, "night": 1260}, 1440),
            "market_regime": D.regime_name((F.col("downside") > 0.98).cast("int"), (F.col("regime") == "risk_off").cast("int"), (F.col("regime") == "risk_on").cast("int")),
            "sector": D.or_unknown(F.when(F.col("user_id") % 7 > 0, F.concat(F.lit("s"), F.col("user_id") % 7))), "market_cap_bucket": D.or_unknown(F.when(F.col("user_id") % 4 > 0, F.col("user_id") % 4)),
            "liquidity_bucket": F.when(F.col("liquidity") >= 3, "high").otherwise("low"), "liquidity_rank_quartile": D.rank_quartile(F.col("pct_liquidity")),
            "volatility_rank_quartile": D.rank_quartile(F.col("pct_downside")),
        }).drop(*[f"_m_{h}" for h in HORIZONS], "pct_liquidity", "pct_downside")

    @cached_property
    def dataset(self) -> DataFrame:
        from tidemark.operators.joins import source_status

        e = self.evidence
        size = e.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_rows"))
        d = source_status(e, self.collections, ["click", "view", "signup"]).join(size, "group_id")
        d = d.withColumns({f"global_{c.replace('signup', 'macro')}": F.col(c) for c in d.columns if c.endswith("_signup") and "observed" not in c})
        d = d.withColumns({"seed": F.expr("user_id * 31 + dayofmonth(session)"), "us": F.unix_micros("decision_time"), "decision_date_et": et_date("decision_time")})
        cols = {name: F.expr(_at(sql, "timestamp_micros(us + ({}) * 1000000)").replace("HASH(", "sha2(").replace("HASHED)", "256)")) for name, sql in DATASET.items()}
        return d.withColumns(cols).drop("seed", "us", "decision_date_et", "group_rows", "source_state_available_at", *[c for c in d.columns if c.endswith("_signup")], *[c for c in d.columns if "observed_rows" in c])


#: outcome horizons of the attributed view, in bars
HORIZONS = {"1b": 1, "2b": 2, "3b": 3, "5b": 5}
OUTCOMES = tuple(f"net_{kind}_{h}" for kind in ("excess", "return") for h in HORIZONS)


def _at(sql: str, form: str) -> str:
    """``AT[seconds]`` is the decision time moved by them."""
    return re.sub(r"AT\[(.*?)\]", lambda m: form.format(m.group(1)), sql)


# Columns of the dataset view over evidence.  ``seed`` spreads faults over users and days.
DATASET = {
    "session_date_et": "CASE WHEN seed % 97 = 0 THEN session ELSE decision_date_et END",
    "feature_available_at": "CASE WHEN seed % 89 = 0 THEN AT[60] WHEN seed % 149 <> 0 THEN AT[-30] END",
    "one_minute_available_at": "CASE WHEN seed % 83 <> 0 THEN AT[seed % 61 - 59] END",
    "spy_available_at": "CASE WHEN seed % 79 <> 0 THEN AT[-15] END",
    "qqq_available_at": "AT[CASE WHEN seed % 73 = 0 THEN 5 ELSE -5 END]",
    "sector_available_at": "CASE WHEN seed % 71 <> 0 THEN AT[-20] END",
    "label_available_at": "AT[2100 + 3600 * slot + CASE WHEN seed % 67 = 0 THEN -60 ELSE 60 END]",
    "label_window_end": "AT[2100 + 3600 * slot]",
    "price_feed": "CASE WHEN seed % 59 = 0 THEN 'IEX' ELSE 'SIP' END",
    "adjustment": "CASE WHEN seed % 53 = 0 THEN 'raw' ELSE 'all' END",
    "daily_bar_count": "CAST(liquidity * 20 AS BIGINT)",
    "five_minute_bar_count": "CAST(liquidity * 10 AS BIGINT)",
    "one_minute_bar_count": "CAST(liquidity * 40 AS BIGINT)",
    "five_minute_history_exact": "seed % 47 <> 0",
    "one_minute_history_exact": "seed % 43 <> 0",
    "feature_eligible": "liquidity >= 2",
    "cross_section_eligible": "group_rows >= 5",
    "catalyst_eligible": "user_id % 2 = 0",
    "label_window_expected": "slot < 2",
    "label_path_exact": "seed % 41 <> 0",
    "label_eligible": "liquidity >= 2 AND seed % 41 <> 0",
    "path_target_first_60m": "target",
    "path_stop_first_60m": "CASE WHEN target = 0 AND ret < -0.05 THEN 1 ELSE 0 END",
    "path_timeout_60m": "CASE WHEN target = 0 AND ret >= -0.05 OR seed % 37 = 0 THEN 1 ELSE 0 END",
    "path_realized_return_gross_60m": "ret + 0.001",
    "path_realized_return_net_60m": "CASE WHEN seed % 29 = 0 THEN ret + 0.0005 ELSE ret END",
    "future_excess_return_60m_vs_spy": "CASE WHEN seed % 101 <> 0 THEN ret END",
    "future_excess_return_60m_vs_qqq": "ret",
    "future_excess_return_60m_vs_sector": "CASE WHEN seed % 103 <> 0 THEN ret END",
    "target_5d": "CASE WHEN seed % 107 <> 0 THEN target END",
    "future_net_return_5d": "ret",
    "future_excess_return_5d_vs_spy": "ret",
    "future_excess_return_5d_vs_qqq": "ret",
    "future_excess_return_5d_vs_sector": "ret",
    "concurrent_label_count": "CAST(liquidity AS BIGINT)",
    "overlap_weight": "CASE WHEN seed % 109 = 0 THEN 0 ELSE 1 / liquidity END",
    "feature_schema_version": "CASE WHEN seed % 113 = 0 THEN 'v0' ELSE 'v1' END",
    "label_schema_version": "'labels_v1'",
    "label_config_json": "'{\"horizon\": 60}'",
    "label_config_hash": "HASH('{\"horizon\": 60}', HASHED)",
    "universe_snapshot_id": "CASE WHEN seed % 127 = 0 THEN '' ELSE 'u1' END",
    "ranking_group_size": "CASE WHEN seed % 131 = 0 THEN group_rows + 1 ELSE group_rows END",
    "stop_before_target": "CASE WHEN seed % 137 = 0 THEN 2 WHEN ret < 0 THEN 1 ELSE 0 END",
    "ranking_target": "CASE WHEN seed % 139 <> 0 THEN ret END",
    "ranking_grade": "CASE WHEN seed % 151 = 0 THEN 1.5 ELSE grade END",
}

# The collection statuses in their k % 5 order.
STATUSES = ("observed", "observed_empty", "partial", "failed", "disabled")

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_STATUS = f"(['observed','observed_empty','partial','failed','disabled'])[{_K} % 5 + 1]"



def _dataset_sql() -> str:
    families = ("click", "view", "signup")
    names = {"click": ("", "click"), "view": ("", "view"), "signup": ("global_", "macro")}
    joins = " ".join(f"ASOF LEFT JOIN (SELECT * FROM collections WHERE source_family = '{f}' QUALIFY row_number() OVER (PARTITION BY ticker, completed_at ORDER BY collection_id DESC) = 1) c_{f}"
                     f" ON c_{f}.ticker = e.ticker AND e.decision_time >= c_{f}.completed_at" for f in families)
    states = ", ".join(f"coalesce(c_{f}.status, 'not_collected') AS {p}source_status_{n}, c_{f}.completed_at AS {p}source_status_available_at_{n}, c_{f}.requested_end AS {p}source_coverage_end_{n}"
                       for f, (p, n) in names.items())
    cols = ", ".join(f"{_at(sql, 'make_timestamp(us + CAST({} AS BIGINT) * 1000000)').replace('HASH(', 'sha256(').replace(', HASHED)', ')')} AS {name}" for name, sql in DATASET.items())
    return f"""
        SELECT * EXCLUDE (seed, us, decision_date_et, group_rows), {cols} FROM (SELECT e.*, {states}, count(*) OVER (PARTITION BY e.group_id) AS group_rows,
          e.user_id * 31 + dayofmonth(e.session) AS seed, epoch_us(e.decision_time) AS us,
          CAST((e.decision_time AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS decision_date_et FROM evidence_x e {joins})"""


def _attributed_sql() -> str:
    net = ", ".join(f"coalesce(least(0.2::DOUBLE, greatest(-0.2::DOUBLE, (c{k} - nx) / 1000.0::DOUBLE)) - 0.001::DOUBLE, 0) AS net_return_{h}" for h, k in HORIZONS.items())
    excess = ", ".join(f"net_return_{h} - avg(net_return_{h}) OVER (PARTITION BY group_id) AS net_excess_{h}" for h in HORIZONS)
    pct = lambda c: f"(rank() OVER (PARTITION BY group_id ORDER BY {c}) + (count(*) OVER (PARTITION BY group_id, {c}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY group_id)"
    quarter = lambda c: f"CASE WHEN {c} <= 0.25 THEN 'q1_low' WHEN {c} <= 0.5 THEN 'q2' WHEN {c} <= 0.75 THEN 'q3' ELSE 'q4_high' END"
    minute = "(hour(et) * 60 + minute(et))"
    return f"""
        SELECT * EXCLUDE (pl, pd, et), strftime(session, '%Y-%m') AS month, CASE WHEN dayofmonth(session) > 7 THEN CAST((dayofmonth(session) - 1) // 7 AS VARCHAR) ELSE '-1' END AS fold_bucket,
          CASE WHEN {minute} >= 1260 THEN 'night' WHEN {minute} >= 1200 THEN 'late_evening' WHEN {minute} >= 1140 THEN 'evening' END AS time_bucket,
          CASE WHEN downside > 0.98 THEN 'high_volatility' WHEN regime IN ('risk_off', 'risk_on') THEN regime ELSE 'neutral' END AS market_regime,
          CASE WHEN user_id % 7 > 0 THEN 's' || (user_id % 7) ELSE 'unknown' END AS sector, CASE WHEN user_id % 4 > 0 THEN CAST(user_id % 4 AS VARCHAR) ELSE 'unknown' END AS market_cap_bucket,
          CASE WHEN liquidity >= 3 THEN 'high' ELSE 'low' END AS liquidity_bucket, {quarter('pl')} AS liquidity_rank_quartile, {quarter('pd')} AS volatility_rank_quartile
        FROM (SELECT *, {excess}, {pct('liquidity')} AS pl, {pct('downside')} AS pd, (decision_time AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS et
          FROM (SELECT e.*, {net} FROM evidence_x e JOIN (SELECT ticker, date, lead(open) OVER w AS nx, {', '.join(f'lead(close, {k}) OVER w AS c{k}' for k in HORIZONS.values())}
            FROM bars_user WINDOW w AS (PARTITION BY ticker ORDER BY date)) b ON b.ticker = e.ticker AND b.date = e.session))"""


#: view name -> (views it needs, SQL body)
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "bars_supp": ((), """
        SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date,
          arg_min(l_extendedprice/l_quantity, (l_orderkey, l_linenumber, l_extendedprice)) AS open,
          max(l_extendedprice/l_quantity) AS high, min(l_extendedprice/l_quantity) AS low,
          arg_max(l_extendedprice/l_quantity, (l_orderkey, l_linenumber, l_extendedprice)) AS close,
          sum(l_quantity) AS volume
        FROM lineitem GROUP BY 1, 2"""),
    "supp_dim": ((), """
        SELECT 'S' || s_suppkey AS ticker, r_name AS sector, n_name AS industry, s_acctbal AS market_cap
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "bench_market": (("bars_supp",), """
        SELECT date, avg(open) AS b_open, avg(close) AS b_close, sum(volume) AS b_volume FROM bars_supp GROUP BY 1"""),
    "bench_sector": (("bars_supp", "supp_dim"), """
        SELECT sector, date, avg(open) AS s_open, avg(close) AS s_close
        FROM bars_supp JOIN supp_dim USING (ticker) GROUP BY 1, 2"""),
    "bars_hour": ((), """
        SELECT *, CAST((timestamp AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS session_date_et,
          CAST(hour((timestamp AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') * 60
               + minute((timestamp AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS INT) AS minute_et,
          timestamp + INTERVAL 30 SECOND AS available_at
        FROM (SELECT upper(event_type) AS ticker, date_trunc('hour', ts) AS bar_start,
                arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
                arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume,
                date_trunc('hour', ts) + INTERVAL 1 HOUR AS timestamp
              FROM events GROUP BY 1, 2)"""),
    "bars_user": ((), """
        SELECT 'U' || user_id AS ticker, CAST(ts AS DATE) AS date, arg_min(value, (ts, event_id)) AS open,
          max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
          CAST(count(*) AS DOUBLE) AS volume
        FROM events GROUP BY 1, 2"""),
    "decisions_user": (("bars_user",), """
        SELECT ticker, date, close, volume,
          CAST(date + 1 AS TIMESTAMP) + INTERVAL 30 SECOND AS decision_time FROM bars_user"""),
    "news": ((), f"""
        SELECT event_id, 'U' || user_id AS ticker, event_type AS source_family, ts AS first_seen, {_K} AS k, value, props,
          CASE WHEN {_K} % 7 <> 0 THEN least(1.0::DOUBLE, greatest(-1.0::DOUBLE, value / 250 - 1)) END AS sentiment,
          {_K} / 50.0::DOUBLE AS relevance,
          CASE WHEN {_K} % 2 = 1 THEN ts + INTERVAL 5 MINUTE ELSE ts END AS feature_available_at
        FROM events"""),
    "collections": ((), f"""
        SELECT event_id AS collection_id, 'U' || user_id AS ticker, event_type AS source_family, ts AS completed_at,
          ts - INTERVAL 10 MINUTE AS requested_end, {_STATUS} AS status,
          CAST(CASE WHEN {_K} % 5 = 0 THEN {_K} + 1 ELSE 0 END AS BIGINT) AS row_count
        FROM events"""),
    "facts": ((), """
        SELECT 'C' || o_custkey AS ticker, lower(substr(o_orderpriority, 3, 20)) AS metric, o_totalprice AS value,
          o_orderdate AS available_at, o_orderkey AS fact_id FROM orders"""),
    "decisions_cust": ((), """
        SELECT o_orderkey AS decision_id, 'C' || o_custkey AS ticker, o_orderdate + INTERVAL 45 DAY AS decision_time
        FROM orders"""),
    "memberships": ((), """
        SELECT ticker, effective_from, lead(effective_from) OVER (PARTITION BY ticker ORDER BY effective_from) AS effective_to,
          CASE WHEN snapshot_id % 2 = 0 THEN effective_from ELSE effective_from + INTERVAL 3 DAY END AS available_at,
          snapshot_id, sector, liquidity_bucket
        FROM (SELECT 'C' || o_custkey AS ticker, o_orderdate AS effective_from, max(o_orderkey) AS snapshot_id,
                arg_max(o_orderstatus, o_orderkey) AS sector, arg_max(o_orderpriority, o_orderkey) AS liquidity_bucket
              FROM orders GROUP BY 1, 2)"""),
    "headlines": ((), """
        SELECT doc_id, lang, source, split_part(text, chr(10), 1) AS title,
          CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) END AS summary, text,
          TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id * 7919 % 43200 AS INT)) AS published
        FROM documents"""),
    "evidence": (("bars_user",), """
        SELECT b.ticker, b.date AS session, b.close / (b.high + b.open) AS score,
          least(1.0::DOUBLE, b.low / (b.close + 1)) AS downside,
          least(0.2::DOUBLE, greatest(-0.2::DOUBLE, (n.close - n.open) / 1000.0::DOUBLE)) - 0.001::DOUBLE AS ret,
          CAST(CASE WHEN n.close > n.open THEN 1 ELSE 0 END AS BIGINT) AS target,
          CASE WHEN b.volume >= 3 THEN 'risk_on' WHEN b.volume >= 2 THEN 'neutral' ELSE 'risk_off' END AS regime,
          b.volume AS liquidity
        FROM bars_user b JOIN bars_user n ON b.ticker = n.ticker AND n.date = b.date + 1"""),
    "evidence_x": (("evidence",), """
        SELECT *, session || '/' || slot AS group_id, decision_time + INTERVAL 5 MINUTE AS entry_time,
          decision_time + to_minutes(CAST(35 + 60 * slot AS INT)) AS exit_time
        FROM (SELECT *, CASE WHEN user_id % 5 = 0 THEN 'ticker_holdout' ELSE 'walk_forward' END AS scope, user_id % 3 AS slot,
            CAST(session AS TIMESTAMP) + to_hours(CAST(user_id % 3 AS INT)) + INTERVAL 30 SECOND AS decision_time
          FROM (SELECT *, CAST(substr(ticker, 2) AS BIGINT) AS user_id,
              CAST(greatest(0, least(4, floor((ret + 0.201) / 0.4::DOUBLE * 5))) AS BIGINT) AS grade FROM evidence))"""),
    "dataset": (("evidence_x", "collections"), _dataset_sql()),
    "attributed": (("evidence_x", "bars_user"), _attributed_sql()),
}
