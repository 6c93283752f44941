"""Audits: every check counts violations; all row rules of a table are one aggregate."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audit(df: DataFrame, rules: Mapping[str, Column | str], unique: Mapping[str, Sequence[str]] | None = None,
          keys: Sequence[str] = ()) -> DataFrame:
    """Rows (check, status, failures, rows_checked) per key.

    ``rules`` are violation predicates (null counts as no violation); ``unique``
    names key column lists whose duplicates are violations.  Duplicates are
    found by a combinable count per key, not by a distinct set.
    """
    pred = {n: F.expr(c) if isinstance(c, str) else c for n, c in rules.items()}
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_checked"), *[F.count_if(c).alias(f"_f_{n}") for n, c in pred.items()])
    long = _rows(one, keys, list(pred)) if pred else None
    for n, cols in (unique or {}).items():
        copies = df.groupBy(*keys, *[c for c in cols if c not in keys]).agg(F.count(F.lit(1)).alias("_c"))
        dup = copies.groupBy(*keys).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("rows_checked"), F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias(f"_f_{n}"))
        part = _rows(dup, keys, [n])
        long = part if long is None else long.unionByName(part)
    return long


def _rows(one: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    items = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"_f_{n}").cast("long").alias("failures")) for n in names]))
    return one.select(*keys, "rows_checked", items.alias("_i")).select(
        *keys, F.col("_i.check").alias("check"), F.when(F.col("_i.failures") == 0, "passed").otherwise("failed").alias("status"),
        F.col("_i.failures").alias("failures"), F.col("rows_checked").cast("long").alias("rows_checked"))


def composite(parts: Mapping[str, DataFrame | None]) -> DataFrame:
    """Union of audits with the section name; an absent section is one ``not_run`` row."""
    ran = [df.select(F.lit(n).alias("section"), "check", "status", "failures", "rows_checked") for n, df in parts.items() if df is not None]
    out = ran[0]
    for df in ran[1:]:
        out = out.unionByName(df)
    for n, df in parts.items():
        if df is None:
            mark = ran[0].limit(0).sparkSession.range(1).select(
                F.lit(n).alias("section"), F.lit("all").alias("check"), F.lit("not_run").alias("status"), F.lit(0).cast("long").alias("failures"), F.lit(0).cast("long").alias("rows_checked"))
            out = out.unionByName(mark)
    return out


def passed(report: DataFrame) -> bool:
    """Single-row action: true when no check failed."""
    return report.where("failures > 0").limit(1).count() == 0


def drift(live: DataFrame, reference: DataFrame, warn: float = 2.0, severe: float = 4.0, missing_warn: float = 0.20, missing_severe: float = 0.50) -> DataFrame:
    """Standardised mean shift and missing-rate change per feature of two profiles, with a status."""
    j = reference.select("feature", F.col("mean").alias("_m"), F.col("std").alias("_s"), F.col("missing_rate").alias("_r")).join(
        live.select("feature", "mean", "missing_rate"), "feature")
    shift = F.abs(F.col("mean") - F.col("_m")) / F.greatest(F.abs(F.coalesce("_s", F.lit(0.0))), F.lit(1e-6))
    gap = F.abs(F.col("missing_rate") - F.col("_r"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    status = F.when((z(shift) >= severe) | (z(gap) >= missing_severe), "severe").when((z(shift) >= warn) | (z(gap) >= missing_warn), "warning").otherwise("stable")
    return j.select("feature", shift.alias("standardized_mean_shift"), gap.alias("missing_rate_delta"), status.alias("status"))
