"""Event-window features: what was known in the last w before each decision."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import range_sums

# The canonical decision windows.
CANONICAL_WINDOWS = {"2h": 7_200, "1d": 86_400, "3d": 259_200}
LOW_RELEVANCE = 0.5
TONE = 0.15


def div0(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def event_features(
    decisions: DataFrame, events: DataFrame, families: Sequence[str],
    windows: Mapping[str, int] = CANONICAL_WINDOWS, keys: Sequence[str] = ("ticker",),
    ts: str = "decision_time", prefix: str = "",
) -> DataFrame:
    """Counts, relevance-weighted sentiment, coverage and per-family counts per window.

    Events: keys, feature_available_at, event_id, sentiment, relevance, source_family.
    An event id counts once, at its first availability.
    """
    keep = [*keys, "sentiment", "relevance", "source_family"]
    first = events.groupBy("event_id").agg(
        F.min_by(F.struct(*keep, "feature_available_at"), "feature_available_at").alias("e")
    ).select("e.*")
    rel = F.greatest(F.coalesce("relevance", F.lit(1.0)), F.lit(0.0))
    present = F.col("sentiment").isNotNull().cast("double")
    sums = {
        "_n": F.lit(1).cast("long"), "_ws": F.coalesce("sentiment", F.lit(0.0)) * rel, "_w": rel * present,
        "_p": present, "_r": rel, "_low": (rel < LOW_RELEVANCE).cast("double"),
        **{f"_f_{f}": (F.lower("source_family") == f).cast("long") for f in families},
    }
    out = range_sums(decisions, first, keys, ts, "feature_available_at", windows, sums, latest=["sentiment", "relevance"])
    cols: dict[str, Column] = {}
    for w in windows:
        c = lambda name, w=w: F.col(f"{name}_{w}")
        cols[f"{prefix}event_count_{w}"] = c("_n")
        cols[f"{prefix}sentiment_mean_{w}"] = div0(c("_ws"), c("_w"))
        cols[f"{prefix}sentiment_coverage_{w}"] = div0(c("_p"), c("_n"))
        cols[f"{prefix}event_relevance_mean_{w}"] = div0(c("_r"), c("_n"))
        cols[f"{prefix}low_relevance_event_fraction_{w}"] = div0(c("_low"), c("_n"))
        cols |= {f"{prefix}source_count_{f}_{w}": c(f"_f_{f}") for f in families}
    cols[f"{prefix}latest_event_available_at"] = F.col("latest")["_at"]
    return out.withColumns(cols).drop("latest", *[f"{n}_{w}" for n in sums for w in windows])


def catalyst_features(
    decisions: DataFrame, events: DataFrame, families: Sequence[str], windows: Mapping[str, int],
    keys: Sequence[str] = ("ticker",), ts: str = "decision_time",
) -> DataFrame:
    """Tone, attention and recency around each decision (unweighted means)."""
    s = F.coalesce("sentiment", F.lit(0.0))
    sums = {
        "news": F.lit(1).cast("long"), "_s": s, "_abs": F.abs(s), "_pos": (s > TONE).cast("double"),
        "_neg": (s < -TONE).cast("double"), "_rel": F.coalesce("relevance", F.lit(0.0)),
        **{f"_f_{f}": (F.col("source_family") == f).cast("long") for f in families},
    }
    prepared = events.withColumns({"sent": s, "rel": F.coalesce("relevance", F.lit(0.0))})
    out = range_sums(decisions, prepared, keys, ts, "feature_available_at", windows, sums, latest=["sent", "rel"])
    cols: dict[str, Column] = {}
    for w in windows:
        n = F.col(f"news_{w}")
        mean = lambda name, n=n, w=w: F.when(n > 0, F.col(f"{name}_{w}") / n)
        cols |= {
            f"news_count_{w}": n, f"sentiment_mean_{w}": mean("_s"), f"sentiment_abs_mean_{w}": mean("_abs"),
            f"positive_fraction_{w}": mean("_pos"), f"negative_fraction_{w}": mean("_neg"),
            f"relevance_mean_{w}": mean("_rel"), f"shock_score_{w}": shock(n, mean("_neg")),
            **{f"source_count_{f}_{w}": F.col(f"_f_{f}_{w}") for f in families},
        }
    cols["minutes_since_last_event"] = (F.unix_micros(ts) - F.unix_micros(F.col("latest")["_at"])) / 60_000_000
    cols["latest_sentiment"] = F.col("latest")["sent"]
    cols["latest_relevance"] = F.col("latest")["rel"]
    return out.withColumns(cols).drop("latest", *[f"{n}_{w}" for n in sums for w in windows])


def shock(count: Column, negative_fraction: Column) -> Column:
    return F.least(F.lit(1.0), F.least(count, F.lit(20)) / 20.0 + F.coalesce(negative_fraction, F.lit(0.0)))


def attention(count: Column, relevance: Column, volume_z: Column) -> Column:
    z = F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.coalesce(volume_z, F.lit(0.0))))
    return F.least(count, F.lit(10)) * (1 + F.coalesce(relevance, F.lit(0.0))) * (1 + z)


def overlay_features(
    decisions: DataFrame, events: DataFrame, families: Sequence[str], windows: Mapping[str, int],
    keys: Sequence[str] = ("ticker",), ts: str = "decision_time", prefix: str = "",
) -> DataFrame:
    """Overlay signal per window: sentiment x attention x source diversity x relevance, clipped to [-1, 1].

    Diversity is counted from per-family sums, so no set is collected.
    Events carry 0/1 columns ``material`` and ``negative_material``.
    """
    tone = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("sentiment", F.lit(0.0))))
    sums = {
        "_n": F.lit(1).cast("long"), "_ws": tone * F.col("relevance"), "_r": F.col("relevance"),
        "_m": F.col("material"), "_nm": F.col("negative_material"),
        **{f"_f_{f}": (F.col("source_family") == f).cast("long") for f in families},
    }
    out = range_sums(decisions, events, keys, ts, "feature_available_at", windows, sums, latest=["event_id"])
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    cols: dict[str, Column] = {}
    for w in windows:
        n = F.col(f"_n_{w}")
        tone_mean, rel = div0(F.col(f"_ws_{w}"), F.col(f"_r_{w}")), div0(F.col(f"_r_{w}"), n)
        diversity = sum((F.col(f"_f_{f}_{w}") >= 1).cast("long") for f in families)
        weight = unit(F.log1p(n) / F.log(F.lit(4.0))) * (0.75 + 0.25 * unit(diversity / 3.0)) * unit(rel / 1.75)
        cols |= {
            f"{prefix}event_count_{w}": n, f"{prefix}sentiment_mean_{w}": tone_mean, f"{prefix}relevance_mean_{w}": rel,
            f"{prefix}source_diversity_{w}": diversity, f"{prefix}material_count_{w}": F.col(f"_m_{w}"),
            f"{prefix}negative_material_count_{w}": F.col(f"_nm_{w}"),
            f"{prefix}signal_{w}": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), tone_mean * weight)),
        }
    cols[f"{prefix}latest_event_at"] = F.col("latest")["_at"]
    return out.withColumns(cols).drop("latest", *[f"{n}_{w}" for n in sums for w in windows])
