"""Mixing sources to target weights by weighted fair queueing."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, blocks_for, fresh, row_hash, unit

RESULT = ("size", "source_size", "target", "virtual_start", "virtual_finish", "copy", "taken")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size, target``: ``share`` of all sizes dealt by weight, none above ``cap`` times its source.

    Sources take the weights in turn, by code point, null last.  What a capped source cannot take is dealt again by
    weight among the rest: sorted by cap over weight, source k is capped while its ratio stays within the level that the
    rest of the budget gives to the rest of the weights, so running sums over the source table settle all rounds at once.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("_level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    per = per.withColumn("_open", F.col("_ratio") > F.col("_level")).withColumn("_at", F.row_number().over(order))
    level = F.min_by(F.when(F.col("_open"), F.col("_level")), F.when(F.col("_open"), F.col("_at"))).over(whole)
    return per.withColumn("target", F.when(F.col("_open"), level * F.col("_w")).otherwise(F.col("_cap"))).select("source", "source_size", "target")


def queued(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5, cap: float = 2.0, seed: int = 17, block_rows: int = 20_000,
) -> DataFrame:
    """One light row per document: ``id, source, row_key, nth, size, source_size, target, cum``; ``nth`` tells rows of a source
    with the same id and text apart.

    ``cum`` is the source's running size through the document, in the shuffled order of a seeded hash of id and text.
    The running sum of a source is cut along the hash into blocks of about ``block_rows`` rows: block totals first, then a
    window inside each block, so a source with a third of all rows spreads over as many tasks as it needs.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row_key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    blocks = blocks_for(docs.count(), block_rows)
    # a null source needs a key that joins
    rows = rows.withColumns({"_src": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")), "_shuffle": F.xxhash64(F.lit(seed), "id", "row_key")})
    rows = rows.withColumn("_block", F.floor(unit(F.col("_shuffle")) * blocks).cast("long"))
    sums = rows.groupBy("_src", "_block").agg(F.first("source").alias("source"), F.sum("size").alias("size"))
    offset = F.coalesce(F.sum("size").over(Window.partitionBy("_src").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    targets = source_targets(sums, weights, share, cap).withColumn("_src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    placed = sums.select("_src", "_block", offset.alias("_offset")).join(targets, "_src")
    order = Window.partitionBy("_src", "_block").orderBy("_shuffle", "id", "row_key")
    inside = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(placed, ["_src", "_block"])
        # equal rows share a block: its row number tells them apart
        .withColumns({"cum": F.col("_offset") + F.sum("size").over(inside), "nth": F.row_number().over(order)})
        .select("id", "source", "row_key", "nth", "size", "source_size", "target", "cum")
    )


def mixed(queue: DataFrame, cap: float = 2.0) -> DataFrame:
    """One row per document and pass, with its virtual times and the words the mix takes of it.

    Each source is a queue that is served again from its start, at most ``cap`` times.  Virtual finish time is the
    source's tokens through the document over its target.  The sources' targets sum to the total budget, so served side by
    side they use it up at virtual time 1: documents that finish by then are taken whole, the one then in service in
    each source gives the words served so far, later ones nothing.  Every source meets its target to the word.
    """
    passes = int(-(-cap // 1))
    start = F.col("cum") - F.col("size") + F.col("copy") * F.col("source_size")
    pace = F.when(F.col("target") > 0, F.col("target"))
    return (
        queue.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
        .withColumns({
            "virtual_start": start / pace, "virtual_finish": (start + F.col("size")) / pace,
            "taken": F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("target") + 1e-6).cast("long") - start)),
        })
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = False, ordered: bool = True, cap: float = 2.0, **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for every copy taken, in virtual finish order, its text cut at the budget (to its
    first words, joined by single spaces).

    ``whole`` keeps texts uncut: the document in service at the cut stays when at least half of it was served.
    ``ordered`` range-sorts the rows over all partitions.  Null text has size 0 and is not taken; null source is a source
    of its own, the last.  Rows with the same id and text are separate documents.  Result columns replace columns of the
    same name.
    """
    passed = [c for c in docs.columns if c.lower() not in RESULT or c in (id_col, text_col, source_col)]
    rid, key, nth = fresh(docs, "_id", "_key", "_nth")
    queue = queued(docs, id_col, text_col, source_col, cap=cap, **options)
    taken = mixed(queue, cap).where(F.col("taken") * 2 >= F.col("size") if whole else F.col("taken") > 0).where("size > 0")
    # same id and text: the n-th row of the queue belongs to the n-th row of docs
    same = Window.partitionBy("id", "row_key", "copy").orderBy("cum")
    taken = taken.select(F.col("id").alias(rid), F.col("row_key").alias(key), F.row_number().over(same).alias(nth), "size", "source_size", "target", "copy", "virtual_start", "virtual_finish", "taken")
    rows = docs.select(*passed).withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(id_col, key).orderBy(row_hash(passed))))
    out = rows.join(taken, F.col(id_col).eqNullSafe(F.col(rid)) & (rows[key] == taken[key]) & (rows[nth] == taken[nth])).drop(rid, key, nth)
    if not whole:
        cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.col("taken").cast("int")), " ")
        out = out.withColumn(text_col, F.when(F.col("taken") < F.col("size"), cut).otherwise(F.col(text_col)))
    return out.repartitionByRange("virtual_finish", id_col).sortWithinPartitions("virtual_finish", id_col) if ordered else out
