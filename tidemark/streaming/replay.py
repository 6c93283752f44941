"""Bounded replays: run a stream to the end of its input and read what it wrote."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import scratch_path
from tidemark.sources.tables import as_instants


def open_files(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Stream over one parquet table of a directory."""
    schema = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet").schema
    return as_instants(spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(directory))


def open_folder(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Stream over the files of a folder, oldest first, ``files_per_batch`` to a micro-batch (all that are there if not given)."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def run_to_end(stream: DataFrame, label: str, home: str | None = None) -> str:
    """Process everything available into parquet; the same ``home`` resumes from its checkpoint."""
    home = home or scratch_path(stream.sparkSession, label)
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{home}/out")
         .option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return home


def replay(stream: DataFrame, label: str) -> DataFrame:
    home = run_to_end(stream, label)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{home}/out")


def publish_batches(stream: DataFrame, label: str, write: Callable[[DataFrame, int, str], None]) -> str:
    """foreachBatch publish; ``write`` must be idempotent per batch id."""
    home = scratch_path(stream.sparkSession, label)
    q = (stream.writeStream.foreachBatch(lambda df, i: write(df, i, f"{home}/out"))
         .option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{home}/out"
