"""Helpers shared by the operators: text rules, written intermediate tables, numbers of blocks."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """A-Z only; every other character keeps its case."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z: bytes methods know ASCII only, which is the rule."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def crc_fold(id_col: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod, F.lit(-1)).cast("int")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write below the cluster's shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks_for(rows: int, rows_per_block: int) -> int:
    return max(1, math.ceil(rows / rows_per_block))


def unit(key: Column) -> Column:
    """A 64-bit hash as a number in [0, 1)."""
    return F.shiftrightunsigned(key, 11).cast("double") / F.lit(float(1 << 53))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, case ignored: callers' columns may carry any name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(columns) -> Column:
    """Orders rows that agree in their key by all their other values, so that reruns pick the same one."""
    return F.xxhash64(*[F.col(c).cast("string") for c in columns])
