"""Ordered-data primitives that never hold one key in one task.

A window partitioned by ticker alone puts a hot ticker into one task.  These
primitives cut every key into blocks along its order (a time block, a value
block or a row-number block), summarise each block with a map-side combinable
aggregate, turn the summaries into *carry rows* (what the block needs to know
about everything before it) and evaluate the window inside (key, block).  The
results are exactly those of the un-split window.

Blocks are functions of the data, not of a sample or of partition numbers, so
a lost executor recomputes the same blocks.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def time_block(ts: Column | str, width_s: int) -> Column:
    micros = F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)
    return F.floor(micros / F.lit(width_s * 1_000_000)).cast("long")


def value_block(value: Column | str, per_efold: int = 16) -> Column:
    """Monotone block of a number: ``per_efold`` blocks per factor e from 1e-6 up.

    Needs no pass over the data, and has at most ~45 * per_efold * 2 values for
    any column below 1e13, which bounds the per-key summary table.  NaN sorts
    last, so it shares the block of infinity.
    """
    v = F.col(value) if isinstance(value, str) else value
    v = F.when(F.isnan(v.cast("double")), F.lit(float("inf"))).otherwise(v.cast("double"))
    return F.floor(F.signum(v) * F.log1p(F.abs(v) * 1e6) * per_efold).cast("long")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    block: Column,
    sums: Mapping[str, Column],
    totals: bool = False,
) -> DataFrame:
    """Inclusive running sums along ``order`` within ``keys``.

    ``order`` must be total and ``block`` monotone in it.  With ``totals`` the
    key's grand total is added as ``<name>_total``.
    """
    names = list(sums)
    d = df.withColumns({"_b": block, **{f"_v_{n}": c for n, c in sums.items()}})
    per_block = d.groupBy(*keys, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carry = per_block.select(
        *keys, "_b", F.lit(0).alias("_s"),
        *[F.sum(f"_v_{n}").over(before).alias(f"_v_{n}") for n in names],
        *([F.sum(f"_v_{n}").over(whole).alias(f"{n}_total") for n in names] if totals else []),
    )
    both = d.withColumn("_s", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    upto = Window.partitionBy(*keys, "_b").orderBy("_s", *order).rowsBetween(Window.unboundedPreceding, 0)
    cols = {n: F.coalesce(F.sum(f"_v_{n}").over(upto), F.lit(0)) for n in names}
    if totals:
        cols |= {f"{n}_total": F.first(f"{n}_total", ignorenulls=True).over(upto) for n in names}
    return both.withColumns(cols).where("_s = 1").drop("_s", "_b", *[f"_v_{n}" for n in names])


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, out: str = "_rn"
) -> DataFrame:
    """1-based row number along ``order`` within ``keys``."""
    return running(df, keys, order, block, {out: F.lit(1).cast("long")})


def row_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    block: Column,
    back: int = 0,
    ahead: int = 0,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Number rows and copy the ``back``/``ahead`` neighbours each block needs.

    Window over ``partitionBy(keys, "_blk").orderBy("_rn")`` with ROWS frames of
    at most ``back`` rows behind and ``ahead`` rows in front, then keep
    own rows (see :func:`own`).  Rows that carry ``_rn`` already keep that numbering,
    which saves a pass; it must cover all rows of the key.
    """
    size = rows_per_block or max(1024, 2 * back, 2 * ahead)
    numbered = df if "_rn" in df.columns else number_rows(df, keys, order, block)
    home = F.floor((F.col("_rn") - 1) / size).cast("long")
    pos = F.pmod(F.col("_rn") - 1, F.lit(size))
    copies = F.array_compact(
        F.array(
            home,
            F.when(pos >= size - back, home + 1) if back else F.lit(None).cast("long"),
            F.when((pos < ahead) & (home > 0), home - 1) if ahead else F.lit(None).cast("long"),
        )
    )
    return numbered.withColumn("_home", home).withColumn("_blk", F.explode(copies))


def frame(keys: Sequence[str], start: int | None = None, end: int | None = None):
    """Window over row blocks; no bounds gives the plain ordered window for lag/lead."""
    w = Window.partitionBy(*keys, "_blk").orderBy("_rn")
    return w if start is None else w.rowsBetween(start, end)


def own(df: DataFrame) -> DataFrame:
    return df.where("_blk = _home").drop("_blk", "_home")


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    parts: Mapping[str, tuple[Column | None, Sequence[str]]],
    tie: Sequence[str] = (),
    width_s: int = DAY,
    block: Callable[[str], Column] | None = None,
) -> DataFrame:
    """Backward inclusive as-of join: latest right row with ``right_ts <= left_ts``.

    ``parts`` maps an output struct column to (condition on right rows, right
    columns); several conditional latest rows (one per source family, metric,
    ...) cost one pass.  Each struct also holds the matched time as ``_at``.
    Right rows that share key and time are first reduced to the one with the
    greatest ``tie`` values.  ``block`` (a monotone block of a column) takes the
    place of time blocks where the order is not a time.
    """
    names = list(parts)
    block = block or (lambda c: time_block(c, width_s))
    prepared = right.where(F.col(right_ts).isNotNull()).select(
        *keys, F.col(right_ts).alias("_t"),
        F.struct(*tie).alias("_tie") if tie else F.lit(0).alias("_tie"),
        *[
            F.when(cond if cond is not None else F.lit(True), F.struct(*cols, F.col(right_ts).alias("_at"))).alias(n)
            for n, (cond, cols) in parts.items()
        ],
    )
    reduced = prepared.groupBy(*keys, "_t").agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_tie"))).alias(n) for n in names]
    )
    reduced = reduced.withColumn("_b", block("_t"))
    last_in_block = reduced.groupBy(*keys, "_b").agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_t"))).alias(n) for n in names],
        F.lit(0).alias("_need"),
    )
    tagged = left.withColumns({"_t": F.col(left_ts), "_b": block(left_ts), "_s": F.lit(1)})
    needed = tagged.select(*keys, "_b").distinct().withColumn("_need", F.lit(1))
    blocks = last_in_block.unionByName(needed, allowMissingColumns=True)
    # a needed block sorts before the block's own rows: only earlier blocks feed its carry
    before = Window.partitionBy(*keys).orderBy("_b", F.col("_need").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        blocks.select(*keys, "_b", "_need", *[F.last(n, ignorenulls=True).over(before).alias(n) for n in names])
        .where("_need = 1").drop("_need")
    )
    rows = (
        tagged.unionByName(reduced.withColumn("_s", F.lit(0)), allowMissingColumns=True)
        .unionByName(carry.withColumn("_s", F.lit(0)), allowMissingColumns=True)
    )
    upto = (
        Window.partitionBy(*keys, "_b").orderBy(F.col("_t").asc_nulls_first(), "_s")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumns({n: F.last(n, ignorenulls=True).over(upto) for n in names})
        .where("_s = 1").drop("_t", "_b", "_s")
    )


def range_sums(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    windows: Mapping[str, int],
    sums: Mapping[str, Column],
    latest: Sequence[str] = (),
    dense: bool | None = None,
) -> DataFrame:
    """Sums of right columns over the closed window ``[t - w, t]`` of every left row.

    Adds ``<sum>_<window>`` columns and, with ``latest``, a struct ``latest`` of
    those columns from the newest right row at or before ``t`` (any age).
    Right rows are pre-summed per (key, time); a row lands in its own block and
    the next one, the block being as wide as the widest window.  ``dense`` (the
    default without keys, where a window holds rows of the whole market) keeps
    the work linear in the rows of a window; with few rows sliding frames are
    faster.
    """
    if dense or (dense is None and not keys):
        return _dense_range_sums(left, right, keys, left_ts, right_ts, windows, sums, latest)
    width = max(windows.values())
    pre = right.where(F.col(right_ts).isNotNull()).groupBy(*keys, F.col(right_ts).alias("_t")).agg(
        *[F.sum(c).alias(f"_v_{n}") for n, c in sums.items()],
        *([F.max(F.struct(*latest, F.col(right_ts).alias("_at"))).alias("latest")] if latest else []),
    )
    pre = pre.withColumn("_b", time_block("_t", width))
    tagged = left.withColumns({"_t": F.col(left_ts), "_b": time_block(left_ts, width), "_s": F.lit(1)})
    copies = pre.withColumn("_b", F.explode(F.array("_b", F.col("_b") + 1))).withColumn("_s", F.lit(0))
    rows = tagged.unionByName(copies, allowMissingColumns=True)
    if latest:
        tail = pre.groupBy(*keys, "_b").agg(F.max_by("latest", "_t").alias("latest"), F.lit(0).alias("_need"))
        needed = tagged.select(*keys, "_b").distinct().withColumn("_need", F.lit(1))
        before = Window.partitionBy(*keys).orderBy("_b", F.col("_need").desc()).rowsBetween(
            Window.unboundedPreceding, -1
        )
        carry = (
            tail.unionByName(needed, allowMissingColumns=True)
            .select(*keys, "_b", "_need", F.last("latest", ignorenulls=True).over(before).alias("latest"))
            .where("_need = 1").drop("_need").withColumn("_s", F.lit(0))
        )
        rows = rows.unionByName(carry, allowMissingColumns=True)
    rows = rows.withColumn("_us", F.unix_micros("_t"))
    by_time = Window.partitionBy(*keys, "_b").orderBy(F.col("_us").asc_nulls_first())
    cols = {
        f"{n}_{wn}": F.coalesce(F.sum(f"_v_{n}").over(by_time.rangeBetween(-ws * 1_000_000, 0)), F.lit(0))
        for wn, ws in windows.items()
        for n in sums
    }
    if latest:
        cols["latest"] = F.last("latest", ignorenulls=True).over(
            by_time.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        )
    return rows.withColumns(cols).where("_s = 1").drop("_t", "_b", "_s", "_us", *[f"_v_{n}" for n in sums])


def _dense_range_sums(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    windows: Mapping[str, int],
    sums: Mapping[str, Column],
    latest: Sequence[str] = (),
) -> DataFrame:
    """:func:`range_sums` by running sums, for keys with many right rows in one window.

    A window ``w`` is cut into parts of ``w``: the sum is that of the part up to
    ``t`` and that of the rows of the part before from ``t - w`` on, which are
    moved by ``w`` and summed backwards; no frame is summed anew for each row.
    Windows that do not divide the widest one take a pass of their own.
    """
    width = max(windows.values())
    nested = {n: w for n, w in windows.items() if width % w == 0}
    if len(nested) < len(windows):
        out = _dense_range_sums(left, right, keys, left_ts, right_ts, nested, sums, latest)
        return _dense_range_sums(out, right, keys, left_ts, right_ts, {n: w for n, w in windows.items() if n not in nested}, sums)
    by_width = {w: [n for n in nested if nested[n] == w] for w in nested.values()}
    pre = right.where(F.col(right_ts).isNotNull()).groupBy(*keys, F.col(right_ts).alias("_t")).agg(
        *[F.sum(c).alias(f"_v_{n}") for n, c in sums.items()],
        *([F.max(F.struct(*latest, F.col(right_ts).alias("_at"))).alias("latest")] if latest else []),
    )
    pre = pre.withColumns({"_b": time_block("_t", width), "_us": F.unix_micros("_t")})
    tagged = left.withColumns({"_us": F.unix_micros(left_ts), "_b": time_block(left_ts, width), "_s": F.lit(1)})
    # _w is 0 for a row at its own time, else the window it is moved by
    moves = F.explode(F.array(F.lit(0).cast("long"), *[F.lit(w).cast("long") for w in by_width])).alias("_w")
    copies = pre.select(*pre.columns, moves).withColumns({
        "_us": F.col("_us") + F.col("_w") * 1_000_000, "_s": F.lit(0),
        **({"latest": F.when(F.col("_w") == 0, F.col("latest"))} if latest else {})}).withColumn(
        "_b", F.floor(F.col("_us") / F.lit(width * 1_000_000)).cast("long"))
    rows = tagged.unionByName(copies.drop("_t"), allowMissingColumns=True)
    if latest:
        tail = pre.groupBy(*keys, "_b").agg(F.max_by("latest", "_t").alias("latest"), F.lit(0).alias("_need"))
        needed = tagged.select(*keys, "_b").distinct().withColumn("_need", F.lit(1))
        before = Window.partitionBy(*keys).orderBy("_b", F.col("_need").desc()).rowsBetween(
            Window.unboundedPreceding, -1
        )
        carry = (
            tail.unionByName(needed, allowMissingColumns=True)
            .select(*keys, "_b", "_need", F.last("latest", ignorenulls=True).over(before).alias("latest"))
            .where("_need = 1").drop("_need").withColumn("_s", F.lit(0))
        )
        rows = rows.unionByName(carry, allowMissingColumns=True)
    upto, drop = (Window.unboundedPreceding, Window.currentRow), []
    if latest:
        by_time = Window.partitionBy(*keys, "_b").orderBy(F.col("_us").asc_nulls_first()).rangeBetween(*upto)
        rows = rows.withColumn("latest", F.last("latest", ignorenulls=True).over(by_time))
    rows = rows.withColumns({f"_c_{w}": F.floor(F.col("_us") / F.lit(w * 1_000_000)).cast("long") for w in by_width})
    for w, named in by_width.items():
        part = Window.partitionBy(*keys, "_b", f"_c_{w}")
        here = part.orderBy(F.col("_us").asc_nulls_first()).rangeBetween(*upto)
        back = part.orderBy(F.col("_us").desc_nulls_last()).rangeBetween(*upto)
        summed = {f"_h_{n}": F.sum(F.when(F.col("_w") == 0, F.col(f"_v_{n}"))).over(here) for n in sums}
        summed |= {f"_k_{n}": F.sum(F.when(F.col("_w") == w, F.col(f"_v_{n}"))).over(back) for n in sums}
        rows = rows.withColumns(summed).withColumns({
            f"{n}_{wn}": F.when(F.col("_s") == 1, F.coalesce(F.col(f"_h_{n}") + F.col(f"_k_{n}"), F.col(f"_h_{n}"), F.col(f"_k_{n}"), F.lit(0)))
            for wn in named for n in sums}).drop(*summed)
    return rows.where("_s = 1").drop("_b", "_s", "_us", "_w", *[f"_c_{w}" for w in by_width], *[f"_v_{n}" for n in sums])


EWM_BLOCK = 128


def _decayed(decay: float):
    return lambda acc, x: acc * F.lit(decay) + x


def ewm(
    df: DataFrame,
    keys: Sequence[str],
    series: Mapping[str, tuple[str, float, int]],
    rn: str = "_rn",
) -> DataFrame:
    """Exponentially weighted means ``y = a*x + (1-a)*y'`` started at the first value.

    ``series`` maps output -> (column, alpha, first row number with a value); the
    column must be null before that row and non-null from it on.  Inside blocks
    of 128 rows the recursion is a rescaled prefix sum; block tails decay by
    (1-a)**128 per block, so a carry needs only the few preceding tails whose
    weight exceeds 1e-18 -- exact to double precision, with no fold over a key.
    Blocks are shuffled in groups that overlap by those few blocks: one shuffle,
    no join, and a long key is spread over many tasks.
    """
    reach = {
        n: max(1, math.ceil(math.log(1e-18) / (EWM_BLOCK * math.log(1.0 - a)))) for n, (_, a, _) in series.items()
    }
    depth = max(reach.values())
    span = max(64, 8 * depth)
    d = df.withColumns({
        "_sub": F.floor((F.col(rn) - 1) / EWM_BLOCK).cast("long"),
        "_j": F.pmod(F.col(rn) - 1, F.lit(EWM_BLOCK)).cast("double"),
    })
    d = d.withColumn("_home", F.floor(F.col("_sub") / span).cast("long")).withColumn(
        "_sup", F.explode(F.array_compact(F.array(
            "_home", F.when(F.pmod("_sub", F.lit(span)) >= span - depth, F.col("_home") + 1))))).repartition(*keys, "_sup")  # for both windows
    inside = Window.partitionBy(*keys, "_sup", "_sub").orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for n, (col, alpha, first) in series.items():
        weight = F.when(F.col(rn) == first, F.lit(1.0)).when(F.col(rn) > first, F.lit(alpha))
        scaled = weight * F.col(col) * F.pow(F.lit(1.0 - alpha), -F.col("_j"))
        local[f"_l_{n}"] = F.coalesce(F.sum(scaled).over(inside), F.lit(0.0)) * F.pow(F.lit(1.0 - alpha), F.col("_j"))
    d = d.withColumns(local)
    over = Window.partitionBy(*keys, "_sup").orderBy("_sub")
    carry = {}
    for n, (_, a, _) in series.items():
        tails = F.collect_list(F.when(F.col("_j") == EWM_BLOCK - 1, F.col(f"_l_{n}"))).over(over.rangeBetween(-reach[n], -1))
        carry[f"_c_{n}"] = F.aggregate(tails, F.lit(0.0), _decayed((1.0 - a) ** EWM_BLOCK))
    d = d.withColumns(carry).where("_sup = _home")
    cols = {
        n: F.when(
            F.col(rn) >= first,
            F.col(f"_l_{n}") + F.col(f"_c_{n}") * F.pow(F.lit(1.0 - a), F.col("_j") + 1),
        )
        for n, (_, a, first) in series.items()
    }
    return d.withColumns(cols).drop(
        "_sub", "_j", "_home", "_sup", *[f"_l_{n}" for n in series], *[f"_c_{n}" for n in series])


def value_counts(
    df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column] | None = None
) -> DataFrame:
    """Per (keys, value): ``_eq`` ties, ``_le`` rows at or below, ``_n`` rows of the key.

    Each of ``sums`` adds ``x`` (sum over the ties), ``x_le`` (at or below) and ``x_n`` (whole key).
    """
    sums = sums or {}
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_eq"), *[F.sum(c).alias(n) for n, c in sums.items()])
    out = running(counts, keys, [F.col(value)], value_block(value),
                  {"_le": F.col("_eq"), **{f"{n}_le": F.col(n) for n in sums}}, totals=True)
    return out.withColumnsRenamed({"_le_total": "_n", **{f"{n}_le_total": f"{n}_n" for n in sums}})


def ranks(df: DataFrame, keys: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """Average-tie rank, tie count and group size of ``value`` within ``keys`` (null stays null).

    Adds ``<prefix>avg_rank``, ``<prefix>min_rank``, ``<prefix>ties``, ``<prefix>group_n``.
    """
    stats = value_counts(df, keys, value).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(value).alias("_k_value"),
        (F.col("_le") - (F.col("_eq") - 1) / 2.0).alias(f"{prefix}avg_rank"),
        (F.col("_le") - F.col("_eq") + 1).alias(f"{prefix}min_rank"),
        F.col("_eq").alias(f"{prefix}ties"), F.col("_n").alias(f"{prefix}group_n"),
    )
    on = F.col(value) == F.col("_k_value")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(stats, on, "left").drop("_k_value", *[f"_k_{k}" for k in keys])


def from_top(prefix: str = "") -> Column:
    """Rank from the highest value down, ties sharing the first place, of the columns of :func:`ranks`.

    Ranking the negated value would put NaN, the highest value of an SQL order, last: its negation is NaN again.
    """
    return F.col(f"{prefix}group_n") - F.col(f"{prefix}min_rank") - F.col(f"{prefix}ties") + 2


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key from running counts (no value list is built)."""
    c = value_counts(df, keys, value)
    first, last = F.col("_le") - F.col("_eq"), F.col("_le")
    aggs = []
    for n, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [
            F.max(F.when((first <= lo) & (lo < last), F.col(value))).alias(f"_lo_{n}"),
            F.max(F.when((first <= hi) & (hi < last), F.col(value))).alias(f"_hi_{n}"),
            F.max(pos - lo).alias(f"_fr_{n}"),
        ]
    g = c.groupBy(*keys).agg(*aggs)
    return g.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}")).alias(n)
            for n in probs
        ],
    )


def greedy(
    df: DataFrame, keys: Sequence[str], start: str, end: str, ident: str, gap: Column | int = 0, strict: bool = True
) -> DataFrame:
    """First-come non-overlapping intervals per key: keep a row if it starts after the last kept end + gap.

    The fold needs one key's intervals in one row, so ``keys`` must bound them by
    the calendar: (ticker, session) holds at most one interval per minute.
    ``start``/``end`` are comparable numbers.  Returns kept ``keys + ident + event_no``.
    """
    items = F.sort_array(F.collect_list(F.struct(F.col(start).alias("s"), F.col(ident).alias("i"), F.col(end).alias("e"))))
    gap = F.lit(gap)

    def step(acc, x):
        free = acc["last"].isNull() | ((x["s"] > acc["last"] + gap) if strict else (x["s"] >= acc["last"] + gap))
        return F.when(
            free, F.struct(x["e"].alias("last"), F.concat(acc["kept"], F.array(x["i"])).alias("kept"))
        ).otherwise(acc)

    ident_type = df.schema[ident].dataType.simpleString()
    end_type = df.schema[end].dataType.simpleString()
    zero = F.struct(
        F.lit(None).cast(end_type).alias("last"), F.array().cast(f"array<{ident_type}>").alias("kept")
    )
    folded = df.groupBy(*keys).agg(items.alias("_items")).select(
        *keys, F.aggregate("_items", zero, step)["kept"].alias("_kept")
    )
    return folded.select(*keys, F.posexplode("_kept").alias("_p", ident)).withColumn(
        "event_no", (F.col("_p") + 1).cast("long")
    ).drop("_p")
