"""Typed readers.  Zone-less parquet timestamps become UTC instants once, here."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def as_instants(df: DataFrame) -> DataFrame:
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in naive}) if naive else df


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return as_instants(spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet"))


def read_frame(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet or CSV by suffix; CSV takes an explicit schema (none means all strings)."""
    if path.rstrip("/").lower().endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.csv(path)
    return as_instants(spark.read.parquet(path))


def read_columns(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """Projected read: only the wanted columns that the file has reach the scan."""
    df = read_frame(spark, path)
    present = [c for c in wanted if c in df.columns]
    if not present:
        raise ValueError(f"{path} has none of the requested columns: {', '.join(wanted)}")
    return df.select(*present)


def read_window(spark: SparkSession, path: str, ts: str, start: str, end: str) -> DataFrame:
    """Rows with ``start <= ts <= end``; compares the stored type so the scan can skip row groups."""
    raw = spark.read.parquet(path)
    kind = raw.schema[ts].dataType.simpleString()
    return as_instants(raw.where(F.col(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind))))
