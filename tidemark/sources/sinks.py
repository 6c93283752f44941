"""Audited writes, verified loads, partitioned and incremental outputs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ident import fingerprint
from tidemark.operators.audits import passed


class AuditFailed(ValueError):
    pass


def manifest(df: DataFrame, artifact: str, available: str, production: bool) -> DataFrame:
    """One row: counts, availability span, column list and content fingerprint."""
    span = df.agg(F.min(available).alias("first_available_at"), F.max(available).alias("last_available_at"))
    return fingerprint(df).crossJoin(F.broadcast(span)).select(  # two one-row aggregates
        F.lit(artifact).alias("artifact_type"), F.lit(",".join(sorted(df.columns))).alias("columns"), F.lit(production).alias("production_ready"), "*")


def write_artifact(df: DataFrame, path: str, artifact: str, report: DataFrame, available: str, production: bool = False) -> None:
    """Write data and then its manifest, only when no check failed."""
    if not passed(report):
        raise AuditFailed(f"{artifact}: audit has failures")
    df.write.mode("errorifexists").parquet(f"{path}/data")
    stored = df.sparkSession.read.parquet(f"{path}/data")
    manifest(stored, artifact, available, production).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")


def load_artifact(spark: SparkSession, path: str, artifact: str, allow_research: bool = True) -> DataFrame:
    """Read an artifact whose manifest type, columns, row count and fingerprint match its data."""
    df = spark.read.parquet(f"{path}/data")
    m = spark.read.parquet(f"{path}/manifest").first()
    now = fingerprint(df).first()
    problems = [
        what for what, bad in (
            ("type", m.artifact_type != artifact), ("columns", m["columns"] != ",".join(sorted(df.columns))), ("rows", m.rows != now.rows),
            ("content", any(m[f"lane_{i}"] != now[f"lane_{i}"] for i in range(4))), ("research only", not (m.production_ready or allow_research))) if bad]
    if problems:
        raise AuditFailed(f"{path}: {', '.join(problems)} mismatch")
    return df


def write_partitioned(df: DataFrame, path: str, partition: str, spread: Sequence[str], mode: str = "errorifexists", rows_per_file: int = 5_000_000) -> None:
    """Partitioned write spread by (partition, keys); files are capped so a hot key splits."""
    df.repartition(partition, *spread).sortWithinPartitions(partition, *spread).write.option("maxRecordsPerFile", rows_per_file).partitionBy(partition).mode(mode).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Overwrite only the partitions present in ``df``; finished ones stay."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy(partition).mode("overwrite").parquet(path)


def missing_partitions(spark: SparkSession, df: DataFrame, path: str, partition: str) -> DataFrame:
    """Rows of partitions not written yet (resume)."""
    done = spark.read.parquet(path).select(F.col(partition).cast(df.schema[partition].dataType)).distinct()
    return df.join(done, partition, "left_anti")


def merge_manifest(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace those of the same keys; the rest is kept."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def export_ohlcv(bars: DataFrame, timeframe: str, source: str, feed: str, adjustment: str = "all") -> DataFrame:
    """Complete OHLCV rows with provenance columns."""
    return bars.dropna(subset=["open", "high", "low", "close", "volume"]).withColumns(
        {"timeframe": F.lit(timeframe), "source": F.lit(source), "price_feed": F.lit(feed), "adjustment": F.lit(adjustment)})
