"""Exact dedup by a tree merge of sorted digest runs."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import blocks_for, fresh, lower_ascii, row_hash, written

ENTRY = ("sha", "bytes", "check")


def _digests(text_col: str) -> dict:
    text = lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return {"sha": F.unhex(F.sha2(text, 256)), "bytes": F.octet_length(text), "check": F.xxhash64(text)}


def merged_runs(leaf: DataFrame, levels: int, fan_in: int, ranges: int, keep: str) -> DataFrame:
    """The sorted entries ``run, sha, bytes, check, best, n`` of all runs merged into one entry per text.

    In each round the runs of a block of ``fan_in`` meet, per digest range, in one sorted partition and merge into one
    run, keeping the best id and the summed count.  Entries merge only when all three digests agree.
    """
    best = F.max if keep == "largest" else F.min
    level = leaf.withColumn("part", F.pmod(F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long"), F.lit(ranges)))
    for _ in range(levels):
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in)).repartition("part", "run").sortWithinPartitions("part", "run", *ENTRY)
            .groupBy("part", "run", *ENTRY).agg(best("best").alias("best"), F.sum("n").alias("n"))
        )
    return level.select(*ENTRY, F.col("best").alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 8, run_rows: int = 2_000
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z.  Light rows (id and digests) are dealt by a hash of id and digest
    into runs of about ``run_rows``, so one text's copies spread over all runs.  A run is sorted and holds one entry per
    text, so a text has at most ``fan_in`` entries in any merge, however many copies there are.  Winners travel back the
    same way: to the run entries first, then to the rows of each run.  Texts are read once and never shuffled.

    Null text counts as empty.  Null ids lose to any other id; if a text has only null ids its ``keep_id`` is null.  Of
    rows with the same id and text exactly one has ``kept``.  An empty table gives an empty result.  Other columns of
    ``docs`` are not read.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    best = F.max if keep == "largest" else F.min
    rows = docs.count()
    levels, runs = 0, 1
    while runs * run_rows < rows:
        runs, levels = runs * fan_in, levels + 1
    light = docs.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in _digests(text_col).items()])
    light = written(light.withColumn("run", F.pmod(F.xxhash64("id", "sha"), F.lit(runs))), "dedup-rows")
    leaf = light.groupBy("run", *ENTRY).agg(best("id").alias("best"), F.count(F.lit(1)).alias("n"))
    top = merged_runs(leaf, levels, fan_in, blocks_for(rows, 50_000), keep)
    settled = leaf.select("run", *ENTRY).join(top, list(ENTRY))
    copies = Window.partitionBy("run", *ENTRY, "id").orderBy("id")
    return (
        light.join(settled, ["run", *ENTRY])
        .withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(copies) == 1))
        .select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were; of rows with the same id and text, one."""
    kid, sha, n = fresh(docs, "_kid", "_sha", "_n")
    kept = exact_dedup(docs, id_col, text_col, **options).where("kept").select(F.col(id_col).alias(kid), F.unhex("text_sha256").alias(sha))
    rows = docs.withColumn(sha, _digests(text_col)["sha"])
    same = Window.partitionBy(id_col, sha).orderBy(row_hash(docs.columns))
    return (
        rows.join(kept, F.col(id_col).eqNullSafe(F.col(kid)) & (rows[sha] == kept[sha]), "left_semi")
        .withColumn(n, F.row_number().over(same)).where(F.col(n) == 1).select(*docs.columns)
    )
