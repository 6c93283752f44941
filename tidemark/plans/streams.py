"""STM queries: bounded replays of the streaming operators."""
from pyspark.sql import functions as F

from tidemark.functions.clock import et_date
from tidemark.plans.fmt import n, r, s, us
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.streaming import operators as S
from tidemark.streaming import replay as R
from tidemark.streaming import stateful as S2

_WM = lambda delay: f"(SELECT epoch_us(date_trunc('milliseconds', max(ts))) - {delay} FROM events)"


def events(v):
    return R.open_files(v.spark, v.dir, "events")


@query("stm_01", f"""SELECT event_type, epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS bar_start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume
FROM events GROUP BY 1, 2 HAVING epoch_us(time_bucket(INTERVAL 5 MINUTE, min(ts))) + 300000000 <= {_WM(30000000)}""")
def stm_01(v):
    """Tumbling bars with a finalisation delay; only finalised bars are emitted."""
    d = R.replay(S.tumbling_bars(events(v), "ts", "event_type", "value", "event_id", "5 minutes", "30 seconds"), "bars")
    return d.select("event_type", us("window.start", "bar_start"), "open", "high", "low", "close", "volume")


@query("stm_02", f"""WITH w AS (SELECT epoch_us(date_trunc('milliseconds', max(ts))) - 600000000 AS wm FROM events WHERE event_id % 50 <> 0)
SELECT event_type, epoch_us(date_trunc('hour', ts)) AS bar_start, count(*) AS events FROM events, w WHERE event_id % 50 <> 0 OR epoch_us(date_trunc('hour', ts)) + 3600000000 > wm GROUP BY 1, 2
HAVING epoch_us(date_trunc('hour', min(ts))) + 3600000000 <= greatest(max(wm), {_WM(600000000)})""")
def stm_02(v):
    """Late rows that arrive after finalisation are excluded: the late part is added and the query resumed."""
    src = scratch_path(v.spark, "late-src")
    ev = v.t("events")
    ev.where("event_id % 50 <> 0").write.parquet(src)
    stream = lambda: R.open_folder(v.spark, src, ev.schema).withWatermark("ts", "10 minutes").groupBy("event_type", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("events"))
    home = R.run_to_end(stream(), "late")
    ev.where("event_id % 50 = 0").write.mode("append").parquet(src)
    R.run_to_end(stream(), "late", home)
    return v.spark.read.parquet(f"{home}/out").select("event_type", us("window.start", "bar_start"), "events")


@query("stm_03", f"""WITH x AS (SELECT user_id, value, unnest(generate_series(time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 90 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts), INTERVAL 30 MINUTE)) AS ws FROM events)
SELECT user_id, epoch_us(ws) AS window_start, count(*) AS events, round(sum(value), 6) AS total FROM x GROUP BY 1, 2 HAVING epoch_us(ws) + 7200000000 <= {_WM(60000000)}""")
def stm_03(v):
    """Sliding two-hour event windows per key."""
    d = R.replay(S.sliding_counts(events(v), "ts", "user_id", F.col("value"), "2 hours", "30 minutes", "1 minute"), "sliding")
    return d.select("user_id", us("window.start", "window_start"), "events", r("total"))


@query("stm_04", "SELECT event_id FROM events")
def stm_04(v):
    """First-seen dedupe: every event delivered twice, kept once."""
    twice = events(v).select("ts", F.explode(F.array("event_id", "event_id")).alias("event_id"))
    return R.replay(S.first_seen(twice, "ts", "event_id", "1 hour"), "first-seen").select("event_id")


_WM_HOUR = "(SELECT epoch_us(date_trunc('milliseconds', max(ts))) - 7200000000 FROM events)"


def arriving(v, batches: int = 5):
    """Events in ``batches`` files, read one to a micro-batch: by time, but a row comes up to 50 minutes late (by its id)."""
    src, ev = scratch_path(v.spark, "arriving"), v.t("events")
    late = F.unix_micros("ts") + (F.col("event_id") % 6) * 600_000_000
    low, high = ev.agg(F.min(late), F.max(late)).first()
    part = F.least(F.lit(batches - 1), F.floor((late - low) * batches / (high - low + 1)))
    for i in range(batches):  # a file each, in order
        ev.where(part == i).coalesce(1).write.mode("append").parquet(src)
    return R.open_folder(v.spark, src, ev.schema, files_per_batch=1)


@query("stm_05", f"""WITH e AS (SELECT *, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS sd, CAST(user_id AS DOUBLE) + 1 AS vol FROM events),
 f AS (SELECT *, min(ts) OVER (PARTITION BY event_type, sd) AS first FROM e)
SELECT event_id, round(sum(value * vol) OVER w / sum(vol) OVER w, 6) AS session_vwap, max(CASE WHEN ts < first + INTERVAL 30 MINUTE THEN value END) OVER w AS opening_high,
 min(CASE WHEN ts < first + INTERVAL 30 MINUTE THEN value END) OVER w AS opening_low
FROM f WHERE epoch_us(ts) <= {_WM_HOUR} WINDOW w AS (PARTITION BY event_type, sd ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def stm_05(v):
    """Session VWAP and growing opening range, reset per New York session, over five micro-batches with late rows."""
    t = arriving(v).withColumns({"session": et_date("ts").cast("string"), "vol": F.col("user_id").cast("double") + 1}).select("event_type", "session", "ts", "value", "vol", "event_id")
    out = R.replay(S2.session_state(t, ["event_type", "session"], "ts", "event_id", "value", "vol", "2 hours"), "session")
    return out.select("event_id", r("session_vwap"), "opening_high", "opening_low")


@query("stm_06", f"""WITH r AS (SELECT user_id, ts, event_id, event_type, value FROM events WHERE event_id % 3 = 0), d AS (SELECT user_id, ts, event_id FROM events WHERE event_id % 3 <> 0 AND epoch_us(ts) <= {_WM_HOUR}),
 k AS (SELECT d.event_id, r.event_type AS source, arg_max(r.event_id, (r.ts, r.event_id)) AS known, epoch_us(max(r.ts)) AS known_at FROM d JOIN r ON d.user_id = r.user_id AND (r.ts, r.event_id) <= (d.ts, d.event_id) GROUP BY 1, 2)
SELECT event_id, source, CAST(known AS VARCHAR) AS known, known_at FROM k""")
def stm_06(v):
    """Latest known state per key and source at each decision, over five micro-batches with late rows."""
    u = arriving(v).select("user_id", "ts", "event_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(1).alias("side"), "event_type", F.col("event_id").cast("string").alias("fact"))
    out = R.replay(S2.known_state(u, "user_id", "ts", "event_id", "side", "event_type", "fact", "2 hours"), "state")
    return out.select("event_id", "source", "known", F.col("known_us").alias("known_at"))


@query("stm_07", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, epoch_us(min(ts)) AS burst_start, count(*) AS events FROM s GROUP BY user_id, sid HAVING epoch_us(max(ts)) + 1800000000 <= {_WM(60000000)}""")
def stm_07(v):
    """Activity bursts by session windows."""
    d = R.replay(S.bursts(events(v), "ts", "user_id", "30 minutes", "1 minute"), "bursts")
    return d.select("user_id", us("session_window.start", "burst_start"), "events")


@query("stm_08", f"""WITH g AS (SELECT *, date_trunc('day', ts) + INTERVAL 1 DAY AS decision FROM events), n AS (SELECT decision, event_type, event_id, value, ts FROM g QUALIFY row_number() OVER (PARTITION BY decision, event_type ORDER BY event_id DESC) = 1)
SELECT event_type AS ticker, epoch_us(decision) AS decision_time, event_id, value FROM n WHERE decision IN (SELECT decision FROM g GROUP BY 1 HAVING count(DISTINCT event_type) = 5)
 QUALIFY decision = max(decision) OVER ()""")
def stm_08(v):
    """Live snapshot publish: a day's rows are a decision group; the newest complete and fresh group is published, the newest row per ticker."""
    d = v.t("events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("x"))
    d = d.select((F.col("day") + F.expr("interval 1 day")).alias("decision_time"), "event_type", "x.event_id", "x.value")
    src = scratch_path(v.spark, "groups")
    for odd in (0, 1):  # half of each group comes one batch later
        d.where(F.hash("event_type") % 2 == odd if odd == 0 else F.hash("event_type") % 2 != 0).coalesce(1).write.mode("append").parquet(src)
    rows = R.open_folder(v.spark, src, d.schema, files_per_batch=1).withColumn("day", F.col("decision_time").cast("string"))
    out = R.replay(S2.complete_groups(rows, "day", "event_type", "decision_time", "event_id", 5, "60 days", "2 days"), "snapshot")
    newest = out.agg(F.max("at_us").alias("_newest"))
    return out.join(F.broadcast(newest)).where("at_us = _newest").select(F.col("event_type").alias("ticker"), F.col("at_us").alias("decision_time"), "event_id", "value")  # one-row aggregate


@query("stm_09", """SELECT d.event_id AS decision_id, l.event_id AS label_id FROM events d JOIN events l ON l.user_id = d.user_id AND l.ts >= d.ts AND l.ts <= d.ts + INTERVAL 2 HOUR WHERE d.event_type = 'click' AND l.event_type = 'purchase'""")
def stm_09(v):
    """Stream-stream interval join of decisions and label ends."""
    d = events(v).where("event_type = 'click'").select(F.col("event_id").alias("decision_id"), F.col("user_id").alias("d_user"), F.col("ts").alias("d_ts"))
    l = events(v).where("event_type = 'purchase'").select(F.col("event_id").alias("label_id"), F.col("user_id").alias("l_user"), F.col("ts").alias("l_ts"))  # noqa: E741
    return R.replay(S.interval_join(d, l, "d_ts", "l_ts", "d_user", "l_user", "2 HOURS", "1 hour"), "labels").select("decision_id", "label_id")


@query("stm_10", f"""WITH RECURSIVE o AS (SELECT user_id, event_id, ts, value AS c, value + user_id % 7 AS h, value - event_id % 5 AS l, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE epoch_us(ts) <= {_WM_HOUR}),
 y AS (SELECT user_id, event_id, i, c, c AS ema, NULL::DOUBLE AS up, NULL::DOUBLE AS down, h - l AS atr FROM o WHERE i = 1 UNION ALL
  SELECT o.user_id, o.event_id, o.i, o.c, y.ema + 2.0::DOUBLE / 13 * (o.c - y.ema), CASE WHEN y.up IS NULL THEN greatest(o.c - y.c, 0) ELSE y.up + 1.0::DOUBLE / 14 * (greatest(o.c - y.c, 0) - y.up) END,
   CASE WHEN y.down IS NULL THEN greatest(y.c - o.c, 0) ELSE y.down + 1.0::DOUBLE / 14 * (greatest(y.c - o.c, 0) - y.down) END, y.atr + 1.0::DOUBLE / 14 * (greatest(o.h - o.l, abs(o.h - y.c), abs(o.l - y.c)) - y.atr)
  FROM y JOIN o ON o.user_id = y.user_id AND o.i = y.i + 1)
SELECT event_id, round(ema, 6) AS ema, round(CASE WHEN up IS NULL THEN NULL WHEN down > 0 THEN 100 - 100 / (1 + up / down) WHEN up > 0 THEN 100 ELSE 50 END, 6) AS rsi, round(atr, 6) AS atr FROM y""")
def stm_10(v):
    """Exponential mean, strength index and true range carried per key, over five micro-batches with late rows."""
    b = arriving(v).select("user_id", "ts", "event_id", F.col("value").alias("c"), (F.col("value") + F.col("user_id") % 7).alias("h"), (F.col("value") - F.col("event_id") % 5).alias("l"))
    out = R.replay(S2.momentum_state(b, "user_id", "ts", "event_id", "h", "l", "c", "2 hours"), "momentum")
    return out.select("event_id", r("ema"), r("rsi"), r("atr"))
