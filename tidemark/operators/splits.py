"""Purged walk-forward folds, causal purging, calibration splits."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ident import identity_set_hash, row_identity


def walk_forward(frame: DataFrame, session: str, folds: int = 4, embargo: int = 1, min_train: int = 20) -> DataFrame:
    """(session, fold, role) of expanding-window folds; roles are train and test.

    Works on distinct sessions (calendar-sized); join it to rows on the session,
    so whole decision groups stay on one side.
    """
    s = frame.select(session).distinct()
    order = Window.partitionBy(F.lit(0)).orderBy(session)
    s = s.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    first = min_train + embargo
    size = F.greatest(F.lit(1), F.floor((F.col("_n") - first) / folds))
    d = s.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = F.lit(first) + F.col("fold") * size
    end = F.when(F.col("fold") == folds - 1, F.col("_n")).otherwise(F.least(start + size, F.col("_n")))
    role = F.when(F.col("_i") < start - embargo, "train").when((F.col("_i") >= start) & (F.col("_i") < end), "test")
    return d.withColumn("role", role).where("role is not null").select(session, F.col("fold").cast("int").alias("fold"), "role")


def date_folds(frame: DataFrame, session: str, folds: int = 5, embargo: int = 1) -> DataFrame:
    """Date-grouped variant: equal folds after an initial training block of one fold (at least two dates)."""
    s = frame.select(session).distinct()
    order = Window.partitionBy(F.lit(0)).orderBy(session)
    s = s.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / (folds + 1)))
    d = s.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = F.least(size, F.greatest(F.lit(1), F.floor(F.col("_n") / 3))) + F.col("fold") * size
    role = F.when(F.col("_i") < start - embargo, "train").when((F.col("_i") >= start) & (F.col("_i") < start + size), "test")
    return d.withColumn("role", role).where("role is not null").select(session, F.col("fold").cast("int").alias("fold"), "role")


def causal_rows(frame: DataFrame, plan: DataFrame, session: str, decision: str, label_available: str) -> DataFrame:
    """Rows with fold and role; training rows whose label matures at or after the first test decision are dropped."""
    d = frame.join(plan, session)
    first = d.where("role = 'test'").groupBy("fold").agg(F.min(decision).alias("_first_test"))
    d = d.join(F.broadcast(first), "fold")  # one row per fold
    return d.where((F.col("role") == "test") | (F.col(label_available) < F.col("_first_test"))).drop("_first_test")


def calibration_split(frame: DataFrame, session: str, fraction: float) -> DataFrame:
    """Session-disjoint halves: the first ``fraction`` of sessions fits, two at least, the rest, two at least, evaluates."""
    s = frame.select(session).distinct()
    order = Window.partitionBy(F.lit(0)).orderBy(session)
    s = s.withColumns({"_i": F.row_number().over(order), "_n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    part = F.when(F.col("_i") <= F.least(F.col("_n") - 2, F.greatest(F.lit(2), F.floor(F.col("_n") * fraction))), "calibrate").otherwise("evaluate")
    return frame.join(s.select(session, part.alias("part")), session)


def fold_evidence(rows: DataFrame, session: str, ident: Sequence[str]) -> DataFrame:
    """Counts, ranges and identity-set hash per (fold, role)."""
    d = rows.withColumn("_id", row_identity(ident))
    base = d.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.min(session).alias("first_session"), F.max(session).alias("last_session"))
    return base.join(identity_set_hash(d, ["fold", "role"], "_id"), ["fold", "role"])
