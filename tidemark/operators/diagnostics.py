"""Why a ranking fell short: selection against population and best k, per outcome and per stratum."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.crosssection import top_k
from tidemark.operators.evaluation import bootstrap

# Lower bounds (minute of the ET day) of the market's time buckets, the last one is its end.
TIME_BUCKETS = {"opening": 570, "late_morning": 630, "midday": 720, "afternoon": 840}
TIME_END = 960
ROUNDING = 1e-12  # a mean within it of zero is zero, whatever the order of summation
QUARTILES = ("q1_low", "q2", "q3", "q4_high")


def time_bucket(minute: Column, buckets: Mapping[str, int] = TIME_BUCKETS, end: int = TIME_END) -> Column:
    """Name of the bucket that holds the minute, lower bound included; null outside all."""
    out = F.lit(None).cast("string")
    for name, low in sorted(buckets.items(), key=lambda x: x[1]):
        out = F.when(minute >= low, name).otherwise(out)
    return F.when(minute < end, out)


def regime_name(high_volatility: Column, risk_off: Column, risk_on: Column) -> Column:
    """First flag above 0 in that order, else neutral; a null flag is 0."""
    on = lambda c: F.coalesce(c.cast("double"), F.lit(0.0)) > 0
    return F.when(on(high_volatility), "high_volatility").when(on(risk_off), "risk_off").when(on(risk_on), "risk_on").otherwise("neutral")


def rank_quartile(rank: Column) -> Column:
    """Quarter of a rank between 0 and 1, upper bound included; null without a rank."""
    return F.when(rank <= 0.25, QUARTILES[0]).when(rank <= 0.5, QUARTILES[1]).when(rank <= 0.75, QUARTILES[2]).when(rank.isNotNull() & ~F.isnan(rank), QUARTILES[3])


def or_unknown(c: Column, unknown: str = "unknown") -> Column:
    return F.coalesce(c.cast("string"), F.lit(unknown))


def mark_selected(df: DataFrame, group: Sequence[str], score: str, tie: str, k: int, out: str = "hit") -> DataFrame:
    """``out`` true on the ``k`` rows of a decision group with the highest score.  A group is one decision of all tickers."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), F.col(tie))
    return df.withColumn(out, F.row_number().over(w) <= k)


def attribution(df: DataFrame, outcomes: Sequence[str], scope: str = "scope", group: str = "group_id", session: str = "session", score: str = "score", tie: str = "ticker", k: int = 10,
                iterations: int = 1_000, seed: int = 42) -> DataFrame:
    """Per (scope, outcome): means over decision groups of the selected, of all and of the best ``k`` by outcome, their
    difference, the share of groups above 0, and session-block bootstrap intervals of selection and difference.

    Outcomes are unpivoted once, so every one of them takes part in the same shuffles.  A null outcome is left out of its
    means; a group counts for an outcome when all three means exist.  Only group means reach the bootstrap.
    """
    keys = [scope, "outcome"]
    marked = mark_selected(df, [scope, group], score, tie, k).select(scope, group, session, tie, "hit", *[F.col(o).cast("double").alias(o) for o in outcomes])
    long = marked.unpivot([scope, group, session, tie, "hit"], list(outcomes), "outcome", "value").where("value is not null")
    each = long.groupBy(*keys, group).agg(F.min(session).alias("_s"), F.avg("value").alias("population"), F.avg(F.when(F.col("hit"), F.col("value"))).alias("selected"))
    best = top_k(long.select(*keys, group, tie, "value"), [*keys, group], [F.desc("value"), F.col(tie)], k).groupBy(*keys, group).agg(F.avg("value").alias("oracle"))
    paired = each.join(best, [*keys, group]).where("selected is not null")
    blocks = paired.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("groups"), *[F.sum(c).alias(c) for c in ("selected", "population", "oracle")], F.count_if(F.col("selected") > ROUNDING).alias("positive"))
    mean = lambda c: F.sum(c) / F.sum("groups")
    out = blocks.groupBy(*keys).agg(
        F.sum("groups").alias("groups"), mean("selected").alias("selected_mean"), mean("population").alias("population_group_mean"), mean("oracle").alias("oracle_top_k_mean"),
        mean("positive").alias("selected_positive_group_rate")).withColumn("selection_delta", F.col("selected_mean") - F.col("population_group_mean"))
    draws = blocks.select(*keys, "_s", F.col("groups").cast("double").alias("_g"), F.col("selected").alias("selected_mean"), (F.col("selected") - F.col("population")).alias("selection_delta")).unpivot(
        [*keys, "_s", "_g"], ["selected_mean", "selection_delta"], "measure", "_v")
    ci = bootstrap(draws, [*keys, "measure"], "_s", "_v", "_g", iterations, seed)
    side = lambda m, b: F.max(F.when(F.col("measure") == m, F.col(b))).alias(f"{m}_{b}")
    return out.join(ci.groupBy(*keys).agg(*[side(m, b) for m in ("selected_mean", "selection_delta") for b in ("low", "high")]), keys)


def strata(df: DataFrame, dimensions: Sequence[str], outcomes: Sequence[str], primary: str, scope: str = "scope", group: str = "group_id", session: str = "session", score: str = "score",
           tie: str = "ticker", k: int = 10, minimum_rows: int = 100, minimum_sessions: int = 20) -> DataFrame:
    """Per (scope, dimension, value) with a selected row: rows, groups and sessions of the selected, rows of the population,
    means of every outcome in both (``selected_<outcome>``, ``population_<outcome>``, ``delta_<outcome>``), the share of
    selected rows with ``primary`` above 0, and whether rows and sessions are enough to go by.

    One scan: selection is a flag, dimensions are unpivoted, and each (dimension, value, session, group) is summed before
    values are, so distinct groups and sessions are counts of rows and a value that holds a third of all rows stays spread.
    Null values of a dimension are a stratum of their own only if the caller names them (``or_unknown``); else left out.
    """
    marked = mark_selected(df, [scope, group], score, tie, k)
    long = marked.select(scope, group, session, "hit", *[F.col(o).cast("double").alias(o) for o in outcomes], *[F.col(d).cast("string").alias(d) for d in dimensions]).unpivot(
        [scope, group, session, "hit", *outcomes], list(dimensions), "dimension", "value").where("value is not null")
    keys = [scope, "dimension", "value"]
    hit = F.col("hit")
    sums = [F.sum(F.when(hit, F.col(o))).alias(f"_s_{o}") for o in outcomes] + [F.count(F.when(hit, F.col(o))).alias(f"_k_{o}") for o in outcomes] + [
        F.sum(o).alias(f"_p_{o}") for o in outcomes] + [F.count(o).alias(f"_n_{o}") for o in outcomes]
    per_group = long.groupBy(*keys, session, group).agg(F.count_if(hit).alias("selected_rows"), F.count(F.lit(1)).alias("population_rows"), F.count_if(hit & (F.col(primary) > 0)).alias("_pos"), *sums)
    again = [F.sum(c).alias(c) for c in per_group.columns if c.startswith("_") or c.endswith("_rows")]
    per_session = per_group.groupBy(*keys, session).agg(F.count_if(F.col("selected_rows") > 0).alias("decision_groups"), *again)
    whole = per_session.groupBy(*keys).agg(F.sum("decision_groups").alias("decision_groups"), F.count_if(F.col("selected_rows") > 0).alias("sessions"), *again).where("selected_rows > 0")
    mean = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    out = whole.select("*", *[x for o in outcomes for x in (mean(f"_s_{o}", f"_k_{o}").alias(f"selected_{o}"), mean(f"_p_{o}", f"_n_{o}").alias(f"population_{o}"))],
                       (F.col("_pos") / F.col("selected_rows")).alias("selected_positive_rate"))
    out = out.withColumns({f"delta_{o}": F.col(f"selected_{o}") - F.col(f"population_{o}") for o in outcomes})
    out = out.withColumn("meets_minimum_evidence", (F.col("selected_rows") >= minimum_rows) & (F.col("sessions") >= minimum_sessions))
    return out.drop(*[c for c in whole.columns if c.startswith("_")])
