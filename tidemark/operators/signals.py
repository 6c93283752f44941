"""Row-level decision rules: overlay assessment, signals, readiness, regimes."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the decision rules.
SWING_STRONG, SWING_WATCH, SWING_LOW = 0.65, 0.55, 0.40
DOWN_VETO, ENTRY, ENTRY_MAX_DOWN = 0.55, 0.70, 0.35
WATCH, WATCH_MAX_DOWN, LOW, AVOID_DOWN = 0.55, 0.45, 0.40, 0.50
FULL_FEEDS = ("sip", "alpaca_sip", "consolidated", "cta_utp")
PARTIAL_FEEDS = ("iex",)
OVERLAY_ADJUST = {"confirmed": 0.04, "conflicting": -0.08, "veto": -0.20, "mixed": 0.0, "absent": 0.0}
CONFIRM_BONUS = {"bullish_breakout_confirmation": 0.08, "bullish_vwap_confirmation": 0.05, "constructive_above_vwap": 0.02, "bearish_pressure": -0.10}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), _c(x)))


def decision_label(rank, probability, confirmation) -> Column:
    rk, p, c = _c(rank), _c(probability), F.coalesce(_c(confirmation), F.lit("neutral"))
    bullish = c.isin("bullish_breakout_confirmation", "bullish_vwap_confirmation")
    return (
        F.when(c == "bearish_pressure", "avoid_entry_1m_bearish").when((rk <= 20) & bullish, "entry_watch_confirmed")
        .when((rk <= 50) & (bullish | (c == "constructive_above_vwap")), "watch_for_entry")
        .when((rk <= 20) & (p >= 0), "model_positive_wait_for_1m_confirmation").otherwise("neutral"))


def decision_rank_score(probability, confirmation, burst) -> Column:
    bonus = F.lit(0.0)
    for k, v in CONFIRM_BONUS.items():
        bonus = F.when(_c(confirmation) == k, v).otherwise(bonus)
    return F.coalesce(_c(probability), F.lit(0.0)) + bonus + F.coalesce(clip(_c(burst) - 1.0, 0, 3) * 0.01, F.lit(0.0))


def swing_signal(p) -> Column:
    p = _c(p)
    return (F.when(p.isNull(), "not_scored").when(p >= SWING_STRONG, "strong_bullish_watch").when(p >= SWING_WATCH, "bullish_watch")
            .when(p <= SWING_LOW, "low_probability").otherwise("neutral"))


def intraday_signal(opportunity, downside) -> Column:
    o, d = _c(opportunity), _c(downside)
    return (F.when(o.isNull() | d.isNull(), "not_scored").when(d >= DOWN_VETO, "avoid_entry_downside_risk")
            .when((o >= ENTRY) & (d <= ENTRY_MAX_DOWN), "entry_candidate").when((o >= WATCH) & (d <= WATCH_MAX_DOWN), "watch_for_confirmation")
            .when((o <= LOW) | (d > AVOID_DOWN), "avoid_entry").otherwise("neutral"))


def combined_readiness(swing_status, intraday_status) -> Column:
    """Worst of the present statuses; nothing present is invalid."""
    a, b = _c(swing_status), _c(intraday_status)
    has = lambda s: F.coalesce(a == s, F.lit(False)) | F.coalesce(b == s, F.lit(False))
    return F.when(a.isNull() & b.isNull(), "invalid").when(has("invalid"), "invalid").when(has("warn"), "warn").otherwise("valid")


def final_signal(swing_status, swing_p, intraday_status, opportunity, downside) -> Column:
    ss, sp, is_, o, d = map(_c, (swing_status, swing_p, intraday_status, opportunity, downside))
    o = F.when(is_.isNotNull(), o)
    d = F.when(is_.isNotNull(), d)
    sp = F.when(ss.isNotNull(), sp)
    supports = o.isNull() | F.coalesce((o >= WATCH) & (d.isNull() | (d <= WATCH_MAX_DOWN)), F.lit(False))
    return (
        F.when(ss.isNull() & is_.isNull(), "not_ready").when((ss != "valid") | (is_ != "valid"), "not_ready")
        .when((sp >= SWING_STRONG) & supports, "high_conviction_watch").when((sp >= SWING_WATCH) & supports, "watch_for_entry")
        .when((o >= SWING_STRONG) & (d.isNull() | (d <= SWING_LOW)) & sp.isNull(), "intraday_watch")
        .when((sp >= SWING_WATCH) & (o < 0.50), "swing_positive_wait_for_intraday").otherwise("neutral"))


def readiness(
    bars, has_price, feed, benchmark, context, model_status, missing_sources, mismatches, stale,
    valid_bars: int = 250, usable_bars: int = 60,
) -> dict[str, Column]:
    """Worst gate wins; every failing gate adds its code to ``reasons`` (daily: 250/60 bars, intraday: 130/30)."""
    bars, feed = _c(bars), F.lower(F.trim(F.coalesce(_c(feed), F.lit("unknown"))))
    gates: list[tuple[Column, int, str]] = [
        (~_c(has_price), 2, "no_price"), (bars < usable_bars, 2, "history_unusable"),
        ((bars >= usable_bars) & (bars < valid_bars), 1, "history_short"), (feed.isin("none", "unknown", ""), 1, "feed_unknown"),
        (feed.isin(*PARTIAL_FEEDS), 2, "feed_partial"),
        (~feed.isin("none", "unknown", "", *PARTIAL_FEEDS, *FULL_FEEDS), 1, "feed_unproven"),
        (~_c(benchmark), 1, "benchmark_missing"), (~_c(context), 1, "context_missing"),
        (F.lower(F.trim(_c(model_status))) != "promoted", 2, "model_not_promoted"), (_c(missing_sources) > 0, 2, "sources_missing"),
        (_c(mismatches) > 0, 2, "news_mismatch"), (_c(stale), 2, "stale_cache"),
    ]
    worst = F.greatest(*[F.when(g, sev).otherwise(0) for g, sev, _ in gates])
    return {
        "status": F.when(worst == 2, "invalid").when(worst == 1, "warn").otherwise("valid"),
        "reasons": F.array_compact(F.array(*[F.when(g, code) for g, _, code in gates])),
    }


def catalyst_assessment(
    events, sentiment, relevance, generic, diversity, material, veto, probability,
) -> dict[str, Column]:
    """Overlay status, direction, score and reasons for one decision row."""
    n, s, rel, p = _c(events), _c(sentiment), _c(relevance), _c(probability)
    absent = n <= 0
    weak = (rel < 0.5) | (F.least(F.lit(1.0), _c(generic) / F.nullif(n, F.lit(0))) >= 0.75)
    direction = F.when(s >= 0.15, "positive").when(s <= -0.15, "negative").otherwise("mixed")
    bull, bear = F.coalesce(p >= 0.55, F.lit(False)), F.coalesce(p <= 0.40, F.lit(False))
    neg, pos = direction == "negative", direction == "positive"
    status = (
        F.when(absent, "absent").when(weak, "mixed").when(neg & (s <= -0.35) & (rel >= 1.0) & (_c(veto) > 0), "veto")
        .when((bull & neg) | (bear & pos), "conflicting").when((bull & pos) | (bear & neg), "confirmed").otherwise("mixed"))
    score = clip(s * clip(rel, 0, 2) * F.least(F.lit(2.0), F.log1p(n)) * (1.0 + F.least(_c(diversity), F.lit(3)) * 0.15), -1, 1)
    solid = ~absent & ~weak
    return {
        "status": status, "direction": F.when(absent, "none").when(weak, "mixed").otherwise(direction),
        "score": F.when(solid, score).otherwise(0.0),
        "reasons": F.array_compact(F.array(
            F.when(absent, "no_recent_catalyst"), F.when(~absent & weak, "low_relevance_or_generic"), F.when(solid, F.concat(F.lit("status_"), status)),
            F.when(solid & (_c(diversity) >= 2), "multiple_sources"), F.when(solid & (_c(material) > 0), "material_events"))),
    }


def overlay_decision_score(probability, status) -> Column:
    adj = F.lit(0.0)
    for k, v in OVERLAY_ADJUST.items():
        adj = F.when(_c(status) == k, v).otherwise(adj)
    return clip(F.coalesce(_c(probability), F.lit(0.0)) + adj, 0, 1)


def market_regime(returns: Sequence, volume_pressure, intraday: bool) -> dict[str, Column]:
    """Regime from the mean of the context returns that are present."""
    cols = [_c(x) for x in returns]
    present = sum(c.isNotNull().cast("int") for c in cols)
    ctx = F.coalesce(sum(F.coalesce(c, F.lit(0.0)) for c in cols) / F.nullif(present, F.lit(0)), F.lit(0.0))
    edge, high = (0.0015, 0.004) if intraday else (0.02, 0.035)
    label = F.when(ctx >= edge, "risk_on").when(ctx <= -edge, "risk_off").otherwise("neutral")
    return {
        "benchmark_context_return": ctx, "market_regime_score": clip(ctx / edge, -3, 3), "market_regime": label,
        "market_regime_high_volatility": ((F.abs(ctx) >= high) | (F.coalesce(_c(volume_pressure), F.lit(0.0)) >= 1.5)).cast("int"),
    }


def overlay_rank(rank_pct, signal_2h, signal_1d, negative_material, global_events, global_sentiment, ticker_events,
                 weight: float = 0.15, penalty: float = 0.5, veto_sentiment: float = -0.60, veto_events: int = 3) -> dict[str, Column]:
    """Rank percentile adjusted by the overlay signal and vetoes, with status and eligibility."""
    sig = clip(0.65 * _c(signal_2h) + 0.35 * _c(signal_1d), -1, 1)
    tv = _c(negative_material) > 0
    gv = (_c(global_events) >= veto_events) & (_c(global_sentiment) <= veto_sentiment)
    return {
        "overlay_signal": sig, "ticker_veto": tv, "global_veto": gv, "overlay_eligible": ~(tv | gv),
        "overlay_score": _c(rank_pct) + weight * sig - penalty * tv.cast("double"),
        "overlay_status": F.when(gv, "global_veto").when(tv, "ticker_veto").when(sig >= 0.15, "confirmed").when(sig <= -0.15, "conflicting")
        .when(_c(ticker_events) > 0, "mixed").otherwise("absent"),
    }


def monitor_score(probability, net_impact, volume_z, events) -> Column:
    z = lambda x: clip(F.coalesce(_c(x), F.lit(0.0)), 0, 5)
    return F.coalesce(_c(probability), F.lit(0.0)) + 0.10 * _c(net_impact) + 0.02 * z(volume_z) + 0.01 * z(events)


def monitor_signal(probability, net_impact) -> Column:
    p, net = F.coalesce(_c(probability), F.lit(0.0)), F.coalesce(_c(net_impact), F.lit(0.0))
    return (F.when((p >= 0.55) & (net >= 0.15), "bullish_with_global_tailwind").when((p >= 0.55) & (net <= -0.15), "model_positive_but_global_headwind")
            .when(p >= 0.55, "bullish_watch").when(net <= -0.35, "global_downside_risk").when(F.abs(net) >= 0.20, "global_two_sided_watch").otherwise("neutral"))
