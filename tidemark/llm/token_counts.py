"""Exact length histogram of encoded documents, and what its suffix sums answer."""
from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: how byte-level BPE splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoded_lengths(docs: DataFrame, ranks_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``tokens``: the encoded length of the whole text; null text has 0 tokens.

    The vocabulary is read on the driver and sent to the tasks: its size is the vocabulary's, whatever the corpus.
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines()) if a}
        coder = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
        for texts in batches:
            yield pd.Series([len(coder.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    count = F.pandas_udf(lengths, "long")
    return docs.withColumn("tokens", count(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def length_histogram(lengths: DataFrame, width: int = 1024) -> DataFrame:
    """One row per encoded length that occurs, ascending: ``tokens, docs`` and, for a context limit of ``tokens``,

    ``docs_at_least`` / ``tokens_at_least`` (documents of that length or more, and their tokens), ``total`` (all tokens),
    ``truncated_total`` (tokens left when every document is cut to the limit), ``dropped_total`` (tokens left when longer
    documents are left out) and ``quantile`` (share of documents no longer than the limit).  Exact for every limit: between
    two lengths that occur ``truncated_total`` is linear, the slope being ``docs_at_least`` of the longer one.

    The histogram has one row per length, not per document; its suffix sums run inside blocks of ``width`` lengths,
    offset by the blocks above.  An empty table gives no rows.
    """
    hist = lengths.groupBy("tokens").agg(F.count(F.lit(1)).alias("docs")).withColumn("block", F.floor(F.col("tokens") / width))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = hist.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("tokens")).alias("t"))
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("total"),
    )
    suffix = Window.partitionBy("block").orderBy(F.col("tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(blocks, "block").withColumns({
        "docs_at_least": F.col("docs_above") + F.sum("docs").over(suffix),
        "tokens_at_least": F.col("tokens_above") + F.sum(F.col("docs") * F.col("tokens")).over(suffix),
    })
    longer = F.col("docs_at_least") - F.col("docs")
    return out.select(
        "tokens", "docs", "docs_at_least", "tokens_at_least", "total",
        (F.col("total") - F.col("tokens_at_least") + F.col("tokens") * F.col("docs_at_least")).alias("truncated_total"),
        (F.col("total") - F.col("tokens_at_least") + F.col("tokens") * F.col("docs")).alias("dropped_total"),
        ((F.col("all_docs") - longer) / F.col("all_docs")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, docs_over, truncated_total`` for any limits, exact, from the histogram alone."""
    h = histogram.select("tokens", "docs")
    asked = [F.struct(F.lit(int(x)).alias("limit"), F.sum(F.when(F.col("tokens") > x, F.col("docs")).otherwise(0)).alias("docs_over"),
                      F.sum(F.least(F.col("tokens"), F.lit(x)) * F.col("docs")).alias("truncated_total")) for x in limits]
    return h.agg(F.array(*asked).alias("a")).select(F.inline("a"))
