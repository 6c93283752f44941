"""Point-in-time joins: as-of status, facts, intervals, benchmarks, reactions, trade pricing."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import DAY, as_of, running, time_block


def source_status(decisions: DataFrame, attempts: DataFrame, families: Sequence[str], width_s: int = DAY) -> DataFrame:
    """Latest completed collection attempt per family known at the decision.

    Expects decisions(ticker, decision_time) and attempts(ticker, source_family,
    completed_at, requested_end, status, row_count, collection_id).
    """
    parts = {
        f"_p{i}": (F.lower(F.trim("source_family")) == f, ["status", "row_count", "requested_end"])
        for i, f in enumerate(families)
    }
    out = as_of(decisions, attempts, ["ticker"], "decision_time", "completed_at", parts, ["collection_id"], width_s)
    cols: dict[str, Column] = {}
    for i, f in enumerate(families):
        p = F.col(f"_p{i}")
        cols[f"source_status_{f}"] = F.coalesce(p["status"], F.lit("not_collected"))
        cols[f"source_observed_rows_{f}"] = F.coalesce(p["row_count"], F.lit(0))
        cols[f"source_status_available_at_{f}"] = p["_at"]
        cols[f"source_coverage_end_{f}"] = p["requested_end"]
    out = out.withColumns(cols)
    known = [F.col(f"source_status_available_at_{f}") for f in families]
    state = F.greatest(*known) if len(known) > 1 else known[0]
    return out.withColumn("source_state_available_at", state).drop(*parts)


def fundamentals(decisions: DataFrame, facts: DataFrame, metrics: Sequence[str], width_s: int = 30 * DAY) -> DataFrame:
    """Latest filed value per metric known at the decision; a fact id counts once, at its last availability."""
    latest = facts.groupBy("fact_id").agg(
        F.max_by(F.struct(*[c for c in facts.columns if c != "fact_id"]), "available_at").alias("f")
    ).select("fact_id", "f.*")
    parts = {f"_p{i}": (F.lower(F.trim("metric")) == m, ["value"]) for i, m in enumerate(metrics)}
    out = as_of(decisions, latest, ["ticker"], "decision_time", "available_at", parts, ["fact_id"], width_s)
    cols = {}
    for i, m in enumerate(metrics):
        cols[f"fundamental_{_name(m)}"] = F.col(f"_p{i}")["value"]
        cols[f"fundamental_available_at_{_name(m)}"] = F.col(f"_p{i}")["_at"]
    return out.withColumns(cols).drop(*parts)


def _name(metric: str) -> str:
    return metric.replace(" ", "_")


def latest_row(
    decisions: DataFrame, rows: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
    columns: Sequence[str], tolerance_s: int | None = None, tie: Sequence[str] = (), width_s: int = DAY,
) -> DataFrame:
    """Latest right row at or before the decision, nulled when older than the tolerance."""
    out = as_of(decisions, rows, keys, left_ts, right_ts, {"_m": (None, columns)}, tie, width_s)
    fresh = F.lit(True)
    if tolerance_s is not None:
        fresh = (F.unix_micros(left_ts) - F.unix_micros(F.col("_m")["_at"])) <= tolerance_s * 1_000_000
    cols = {c: F.when(fresh, F.col("_m")[c]) for c in columns}
    return out.withColumns({**cols, "matched_at": F.when(fresh, F.col("_m")["_at"])}).drop("_m")


def interval_match(
    decisions: DataFrame, intervals: DataFrame, keys: Sequence[str], ts: str,
    start: Column, end: Column, ident: str, columns: Sequence[str], width_s: int = 30 * DAY,
) -> DataFrame:
    """Half-open interval join with an exact match count per decision.

    A sweep of +1/-1 marks along time gives the number of open intervals; when
    it is one, the running sum of open ids is that interval's id.  No pair of
    (decision, interval) is ever emitted, so many intervals per key stay cheap.
    ``ident`` must be a unique long.  Adds ``match_count`` and ``columns`` (null
    unless exactly one interval matched).
    """
    spans = intervals.select(*keys, ident, start.alias("_from"), end.alias("_to")).where(
        F.col("_to").isNull() | (F.col("_to") > F.col("_from")))
    edges = F.explode(F.array_compact(F.array(
        F.struct(F.col("_from").alias("_t"), F.lit(1).alias("_sign")),
        F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("_t"), F.lit(-1).alias("_sign"))))))
    marks = spans.where("_from is not null").select(*keys, ident, edges.alias("_e")).groupBy(*keys, F.col("_e._t").alias("_t")).agg(
        F.sum("_e._sign").cast("long").alias("_open"),
        F.sum(F.col(ident).cast("decimal(38,0)") * F.col("_e._sign")).alias("_ids")).withColumn("_side", F.lit(0))
    rows = decisions.withColumns({"_t": F.col(ts), "_side": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    swept = running(rows, keys, [F.col("_t"), F.col("_side")], time_block("_t", width_s),
                    {"match_count": F.col("_open"), "_idsum": F.col("_ids")}).where("_side = 1")
    swept = swept.withColumn("_ident", F.when(F.col("match_count") == 1, F.col("_idsum").cast("long")))
    meta = intervals.select(F.col(ident).alias("_ident"), *columns)
    return swept.join(meta, "_ident", "left").drop("_t", "_side", "_open", "_ids", "_idsum", "_ident").withColumn(
        "match_count", F.col("match_count").cast("long"))


def benchmark_path(labels: DataFrame, bench: DataFrame, keys: Sequence[str], entry: str, exit_: str, out: str,
                   ts: str = "date", open_: str = "open", close: str = "close") -> DataFrame:
    """Benchmark return from the open at the entry key to the close at the exit key (null if either is missing)."""
    first = bench.select(*keys, F.col(ts).alias(entry), F.col(open_).alias("_bo"))
    last = bench.select(*keys, F.col(ts).alias(exit_), F.col(close).alias("_bc"))
    joined = labels.join(first, [*keys, entry], "left").join(last, [*keys, exit_], "left")
    return joined.withColumn(out, F.when(F.col("_bo") > 0, F.col("_bc") / F.col("_bo") - 1)).drop("_bo", "_bc")


def forward_date(events: DataFrame, dates: DataFrame, candidate: str, date: str, out: str) -> DataFrame:
    """First listed date at or after the candidate; events with none are dropped.

    Both sides reduce to distinct dates (calendar-sized) before any window.
    """
    from pyspark.sql import Window

    wanted = events.select(F.col(candidate).alias("_d")).distinct().withColumn("_hit", F.lit(None).cast("date"))
    listed = dates.select(F.col(date).alias("_d")).distinct().withColumn("_hit", F.col("_d"))
    both = wanted.unionByName(listed).groupBy("_d").agg(F.max("_hit").alias("_hit"))
    after = Window.partitionBy(F.lit(0)).orderBy("_d").rowsBetween(0, Window.unboundedFollowing)
    lookup = both.select(F.col("_d").alias(candidate), F.first("_hit", ignorenulls=True).over(after).alias(out))
    return events.join(lookup, candidate).where(F.col(out).isNotNull())
