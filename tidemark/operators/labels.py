"""Forward path labels: barriers, exact paths, overlap, costs.

A label looks at most ``horizon`` bars ahead, so paths are arrays of at most
``horizon`` structs read from a ROWS frame; no series is ever collected whole.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import ratio
from tidemark.functions.clock import stride_offset
from tidemark.operators.features import blocks, guarded
from tidemark.operators.ordered import as_of, frame, greedy, own, time_block


def path_array(columns: dict[str, str]) -> Column:
    return F.struct(*[F.col(c).alias(a) for a, c in columns.items()])


def first_touch(path: Column, hit) -> Column:
    """1-based position of the first path element that satisfies ``hit``; 0 when none does."""
    return F.array_position(F.transform(path, hit), F.lit(True)).cast("int")


def barriers(path: Column, entry: Column, target: Column, stop: Column, horizon: Column, ambiguous: str = "stop") -> dict[str, Column]:
    """Which barrier is touched first along a path of h/l/c structs; equal bars follow the tie policy."""
    return decided(first_touch(path, lambda x: x["h"] >= target), first_touch(path, lambda x: x["l"] <= stop), horizon, ambiguous)


def decided(t0: Column, s0: Column, horizon: Column, ambiguous: str = "stop") -> dict[str, Column]:
    """:func:`barriers` from the places of the first touch of target and stop (0: none)."""
    none = horizon + 1
    t, s = F.when(t0 == 0, none).otherwise(t0), F.when(s0 == 0, none).otherwise(s0)
    tie = (t == s) & (t <= horizon)
    up = (t < s) | (tie if ambiguous == "target" else F.lit(False))
    down = (s < t) | (tie if ambiguous == "stop" else F.lit(False))
    return {
        "target_first": up, "stop_first": down, "ambiguous": tie,
        "outcome": F.when(up, "target_first").when(down, "stop_first").when(tie, "ambiguous").otherwise("timeout"),
        "outcome_bar": F.least(t, s, horizon),
    }


def forward_labels(df: DataFrame, horizon: int, atr_multiple: float = 0.5, target_atr: float = 1.0, stop_atr: float = 1.0) -> DataFrame:
    """Daily forward return, up label, threshold bucket and favourable-before-stop (bars with atr_14, atr_pct_14, return_1d)."""
    d = blocks(df, "date", back=20, ahead=horizon)
    w = frame(["ticker"])
    d = d.withColumns({
        "_entry": F.lead("open").over(w), "_exit": F.lead("close", horizon).over(w),
        "_std": guarded(F.stddev_samp("return_1d"), "return_1d", frame(["ticker"], -19, 0), 20),
        "_path": F.collect_list(path_array({"h": "high", "l": "low"})).over(frame(["ticker"], 1, horizon))})
    ret = ratio("_exit", "_entry") - 1
    edge = F.coalesce("atr_pct_14", "_std") * atr_multiple
    tail = F.col("_exit").isNull()
    e, a = F.col("_entry"), F.col("atr_14")
    t = first_touch(F.col("_path"), lambda x: x["h"] >= e + target_atr * a)
    s = first_touch(F.col("_path"), lambda x: x["l"] <= e - stop_atr * a)
    return own(d.withColumns({
        "entry_next_open": e, "future_return": ret, "target_up": F.when(~tail, (ret > 0).cast("int")),
        "target_bucket": F.when(~tail, F.when(ret > edge, 1).when(ret < -edge, -1).otherwise(0)),
        "favorable_before_stop": F.when(e.isNotNull() & (a > 0), ((t > 0) & ((s == 0) | (t < s))).cast("int")),
    })).drop("_entry", "_exit", "_std", "_path")


def session_labels(
    bars: DataFrame, horizons: Sequence[int], primary: int, bar_minutes: int, cost_bps: float = 10.0, target_atr: float = 1.5,
    stop_atr: float = 1.0, stride: int = 1, start: int = 570, end: int = 960, ambiguous: str = "stop",
) -> DataFrame:
    """Exact-horizon labels inside the regular session, one row per eligible decision bar.

    Bars: ticker, timestamp, session_date_et, minute_et, OHLC, atr_14.  The
    longest horizon must be contiguous in wall-clock time and end inside the
    session; rows that fail are dropped, never filled.
    """
    longest = max(horizons)
    sess = Window.partitionBy("ticker", "session_date_et").orderBy("timestamp")
    ahead = sess.rowsBetween(1, longest)
    regular = F.col("minute_et").between(start, end - 1)
    whole = Window.partitionBy("ticker", "session_date_et")
    d = bars.withColumns({
        "_idx": F.row_number().over(sess), "_reg": F.sum(regular.cast("int")).over(sess.rowsBetween(Window.unboundedPreceding, 0)),
        "_path": F.collect_list(F.struct(F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"),
                                         F.col("timestamp").alias("t"), F.col("minute_et").alias("m"))).over(ahead),
        "_last": F.max(F.when(regular, F.struct(F.col("timestamp").alias("t"), F.col("close").alias("c")))).over(whole)})
    p = F.col("_path")
    at = lambda k, f: F.element_at(p, k)[f]
    offset = stride_offset("session_date_et", stride) if stride > 1 else F.lit(0)
    on_grid = F.pmod(F.col("_reg") - 1 - offset, F.lit(stride)) == 0
    d = d.where(regular & (F.col("_reg") - 1 >= offset) & on_grid & (F.size(p) == longest))
    exact = (F.unix_micros(at(longest, "t")) - F.unix_micros("timestamp")) == longest * bar_minutes * 60_000_000
    d = d.where((at(longest, "m") < end) & exact & (at(1, "o") > 0) & (F.col("atr_14") > 0))
    e, cost = at(1, "o"), cost_bps / 10_000.0
    cols: dict[str, Column] = {"entry_price": e, "entry_time": at(1, "t"), "exit_time": at(primary, "t"), "session_close_time": F.col("_last")["t"],
                               "_entry_idx": F.col("_idx") + 1, "_exit_idx": F.col("_idx") + primary}
    for h in horizons:
        part = F.slice(p, 1, h)
        hi, lo = F.transform(part, lambda x: x["h"]), F.transform(part, lambda x: x["l"])
        m = h * bar_minutes
        cols |= {
            f"exit_time_{m}m": at(h, "t"), f"net_return_{m}m": at(h, "c") / e - 1 - cost, f"mfe_{m}m": F.array_max(hi) / e - 1, f"mae_{m}m": F.array_min(lo) / e - 1,
            f"bars_to_mfe_{m}m": F.array_position(hi, F.array_max(hi)), f"bars_to_mae_{m}m": F.array_position(lo, F.array_min(lo))}
    target, stop = e + target_atr * F.col("atr_14"), e - stop_atr * F.col("atr_14")
    b = barriers(F.slice(p, 1, primary), e, target, stop, F.lit(primary), ambiguous)
    realized = F.when(b["target_first"], target).when(b["stop_first"], stop).otherwise(at(primary, "c"))
    cols |= {
        "net_return_to_close": F.col("_last")["c"] / e - 1 - cost, "path_outcome": b["outcome"], "path_outcome_bar": b["outcome_bar"],
        "target_before_stop": b["target_first"].cast("int"), "stop_before_target": b["stop_first"].cast("int"),
        "path_timeout": (b["outcome"] == "timeout").cast("int"), "path_realized_return_net": realized / e - 1 - cost,
        "target_price": target, "stop_price": stop}
    return d.withColumns(cols).drop("_idx", "_reg", "_path", "_last")


def bar_overlap(labels: DataFrame, ident: str) -> DataFrame:
    """Maximum concurrency and mean 1/concurrency over each label's bars (bar indices, both ends inclusive)."""
    keys = ["ticker", "session_date_et"]
    spans = labels.select(*keys, ident, F.explode(F.sequence("_entry_idx", "_exit_idx")).alias("_bar"))
    active = spans.groupBy(*keys, "_bar").agg(F.count(F.lit(1)).alias("_n"))
    per = spans.join(active, [*keys, "_bar"]).groupBy(*keys, ident).agg(
        F.max("_n").alias("concurrent_label_count"), F.avg(1.0 / F.col("_n")).alias("overlap_weight"))
    return labels.join(per, [*keys, ident], "left")


def interval_overlap(labels: DataFrame, keys: Sequence[str], ident: str, start: str, end: str) -> DataFrame:
    """Labels overlapping in time: starts up to my end minus ends before my start; weight 1/n.

    ``keys`` are (ticker, session): the sweep is bounded by the session.
    """
    s, e = F.unix_micros(start), F.unix_micros(end)
    part = lambda t, side, a, b, who: labels.select(*keys, t.alias("_t"), F.lit(side).alias("_side"), F.lit(a).alias("_s"), F.lit(b).alias("_e"), who.alias(ident))
    nobody = F.lit(None).cast(labels.schema[ident].dataType)
    marks = part(s, 1, 1, 0, nobody).unionAll(part(e, 1, 0, 1, nobody)).unionAll(part(s, 0, 0, 0, F.col(ident))).unionAll(part(e, 2, 0, 0, F.col(ident)))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.withColumns({"_cs": F.sum("_s").over(w), "_ce": F.sum("_e").over(w)}).where(F.col(ident).isNotNull())
    per = seen.groupBy(*keys, ident).agg(
        (F.max(F.when(F.col("_side") == 2, F.col("_cs"))) - F.max(F.when(F.col("_side") == 0, F.col("_ce")))).alias("concurrent_label_count"))
    return labels.join(per, [*keys, ident], "left").withColumn("overlap_weight", 1.0 / F.greatest("concurrent_label_count", F.lit(1)))


def independent_events(labels: DataFrame, start: str, end: str, ident: str, gap: int = 0, strict: bool = True) -> DataFrame:
    """Greedy non-overlapping labels per (ticker, session); kept rows get ``ticker:session:n``."""
    kept = greedy(labels, ["ticker", "session_date_et"], start, end, ident, gap, strict)
    name = F.concat_ws(":", "ticker", F.col("session_date_et").cast("string"), F.col("event_no").cast("string"))
    return labels.join(kept.select("ticker", "session_date_et", ident, name.alias("independent_event_id")), ["ticker", "session_date_et", ident], "left")


def exact_paths(
    decisions: DataFrame, bars: DataFrame, horizon: int, step_minutes: int, target_atr: float = 1.0, stop_atr: float = 0.75, cost_bps: float = 10.0,
) -> DataFrame:
    """Labels from the first bar at or after the decision, over ``horizon`` contiguous bars of the same session.

    Decisions: decision_id, ticker, decision_time, session_date_et, atr.  Bars:
    ticker, bar_start, bar_end, available_at, session_date_et, OHLC.  The entry
    bar is a forward as-of; the path is an equi join on exploded bar starts.
    """
    flip = lambda c: F.timestamp_micros(-F.unix_micros(c))
    d = as_of(decisions.withColumn("_f", flip("decision_time")), bars.withColumn("_fb", flip("bar_start")), ["ticker"], "_f", "_fb",
              {"_e": (None, ["bar_start", "open"])}).drop("_f")
    step = F.expr(f"interval {step_minutes} minutes")
    legs = d.select("decision_id", "ticker", "session_date_et", F.col("_e.bar_start").alias("entry_time"), F.explode(
        F.arrays_zip(F.sequence(F.lit(1), F.lit(horizon)).alias("k"), F.sequence(F.col("_e.bar_start"), F.col("_e.bar_start") + step * (horizon - 1), step).alias("bar_start"))).alias("z"))
    legs = legs.select("decision_id", "ticker", "session_date_et", "entry_time", F.col("z.k").alias("k"), F.col("z.bar_start").alias("bar_start"))
    path = legs.join(bars.select("ticker", "session_date_et", "bar_start", "bar_end", "available_at", F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c")),
                     ["ticker", "session_date_et", "bar_start"])
    per = path.groupBy("decision_id").agg(F.sort_array(F.collect_list(F.struct("k", "h", "l", "c", "bar_end", "available_at"))).alias("_p"))  # at most horizon items
    d = d.join(per, "decision_id", "left")
    p, e, a = F.col("_p"), F.col("_e.open"), F.col("atr")
    ok = F.coalesce((F.size(p) == horizon) & (e > 0) & (a > 0), F.lit(False))
    target, stop = e + target_atr * a, e - stop_atr * a
    b = barriers(p, e, target, stop, F.lit(horizon))
    active = F.slice(p, 1, F.when(ok, b["outcome_bar"]).otherwise(1))
    out = F.element_at(p, F.when(ok, b["outcome_bar"]).otherwise(1))
    realized = F.when(b["target_first"], target).when(b["stop_first"], stop).otherwise(F.element_at(p, -1)["c"])
    when = lambda c: F.when(ok, c)
    return d.withColumns({
        "label_path_exact": ok, "entry_time": when(F.col("_e.bar_start")), "entry_price": when(e), "exit_time": when(out["bar_end"]),
        "label_available_at": when(out["available_at"]), "label_window_end": when(F.element_at(p, -1)["bar_end"]), "path_outcome": when(b["outcome"]),
        "path_outcome_bar": when(b["outcome_bar"]), "net_return": when(realized / e - 1 - cost_bps / 10_000.0),
        "path_mfe": when(F.array_max(F.transform(active, lambda x: x["h"])) / e - 1), "path_mae": when(F.array_min(F.transform(active, lambda x: x["l"])) / e - 1),
    }).drop("_e", "_p")


def exact_sessions(df: DataFrame, calendar: DataFrame, horizon: int, cost_bps: float = 10.0) -> DataFrame:
    """Swing labels by session shifts that must match calendar ordinals (``calendar``: date, ordinal)."""
    d = df.join(calendar, "date")
    d = blocks(d, "date", back=1, ahead=horizon)
    w = frame(["ticker"])
    ahead = frame(["ticker"], 1, horizon)
    d = d.withColumns({
        "entry_price": F.lead("open").over(w), "exit_price": F.lead("close", horizon).over(w), "_o1": F.lead("ordinal").over(w), "_oh": F.lead("ordinal", horizon).over(w),
        "entry_date": F.lead("date").over(w), "exit_date": F.lead("date", horizon).over(w), "_mx": F.max("high").over(ahead), "_mn": F.min("low").over(ahead)})
    exact = F.coalesce((F.col("_o1") == F.col("ordinal") + 1) & (F.col("_oh") == F.col("ordinal") + horizon), F.lit(False))
    gross = ratio("exit_price", "entry_price") - 1
    v = lambda c: F.when(exact, c)
    return own(d.withColumns({
        "label_path_exact": exact, "gross_return": v(gross), "net_return": v(gross - cost_bps / 10_000.0), "future_mfe": v(ratio("_mx", "entry_price") - 1),
        "future_mae": v(ratio("_mn", "entry_price") - 1), "target": v((gross - cost_bps / 10_000.0 > 0).cast("int"))})).drop("_o1", "_oh", "_mx", "_mn")


def entry_exit_labels(
    df: DataFrame, horizon: int = 5, target_atr: float = 1.5, stop_atr: float = 1.0, cost_bps: float = 10.0, ambiguous: str = "stop", ts: str = "date",
    session: str | None = None,
) -> DataFrame:
    """Entry/exit path labels: next-open entry, ATR barriers, per-side cost, tie policy stop/target/ignore.

    With ``session`` the path stops at the end of the entry bar's session.  The
    last ``horizon`` rows of a ticker are null.
    """
    d = blocks(df, ts, back=1, ahead=horizon)
    ahead = frame(["ticker"], 1, horizon)
    fields = {"o": "open", "h": "high", "l": "low", "c": "close"} | ({"s": session} if session else {})
    d = d.withColumns({"_raw": F.collect_list(path_array(fields)).over(ahead)})
    p = F.col("_raw") if not session else F.filter("_raw", lambda x: x["s"] == F.element_at("_raw", 1)["s"])
    tail = F.size("_raw") < horizon
    # every step's columns are used several times: they are computed once, as columns
    d = d.withColumn("_path", p)
    p, a = F.col("_path"), F.col("atr_14")
    d = d.withColumns({"_entry": F.try_element_at(p, F.lit(1))["o"], "_last": F.try_element_at(p, F.lit(-1))["c"], "_bars": F.size(p)})
    e, last, n = F.col("_entry"), F.col("_last"), F.col("_bars")
    ok = F.coalesce(~tail & (a > 0) & (e > 0), F.lit(False))
    rt = cost_bps / 10_000.0
    d = d.withColumns({"_target": e * (1 + rt) + target_atr * a, "_stop": e - stop_atr * a})
    target, stop = F.col("_target"), F.col("_stop")
    d = d.withColumns({"_t0": first_touch(p, lambda x: x["h"] >= target), "_s0": first_touch(p, lambda x: x["l"] <= stop)})
    b = decided(F.col("_t0"), F.col("_s0"), n, ambiguous)
    net = lambda x: x * (1 - rt / 2) / (e * (1 + rt / 2)) - 1
    timeout = b["outcome"] == "timeout"
    undecided = b["ambiguous"] if ambiguous == "ignore" else F.lit(False)
    realized = F.when(b["target_first"], target).when(b["stop_first"], stop).when(undecided, F.lit(None)).otherwise(last)
    outcome = F.when(b["ambiguous"], "ambiguous").otherwise(b["outcome"])
    v = lambda c: F.when(ok, c)
    return own(d.withColumns({
        "entry_price": v(e), "target_price": v(target), "stop_price": v(stop), "entry_exit_outcome": v(outcome), "bars_to_exit": v(b["outcome_bar"]),
        "max_favorable_excursion": v(F.array_max(F.transform(p, lambda x: x["h"])) / e - 1), "max_adverse_excursion": v(F.array_min(F.transform(p, lambda x: x["l"])) / e - 1),
        "net_horizon_return": v(net(last)), "net_realized_return": v(net(realized)), "target_entry_success": v(F.when(~undecided, b["target_first"].cast("int"))),
        "target_exit_risk": v(F.when(~undecided, b["stop_first"].cast("int"))), "target_timeout_positive": v((timeout & (net(last) > 0)).cast("int")),
        "target_net_positive": v((net(last) > 0).cast("int"))})).drop("_raw", "_path", "_entry", "_last", "_bars", "_target", "_stop", "_t0", "_s0")
