"""Ordered state per key on a stream: rows wait in the state until the watermark has passed them, then run in event order.

A row that comes late but within the watermark's delay therefore meets exactly the state that the batch twin gives it, however the
input is cut into micro-batches.  All state is keyed, kept by the state store, and given up when a key has been silent for
``idle``: an event-time timeout clears it, so that state grows with live keys only.
"""
from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = 50_000  # rows that a bucket gathers before it returns them


class OrderedState:
    """``step(state, rows)`` gets rows of one key in order of (time, ident) and the state after all earlier ones, or ``None``, and returns
    (output rows, new state).  Rows are tuples: microseconds, ident, then the payload columns.

    One call serves a bucket of keys, since a call and its read and write of the state store cost far more than a key's few rows.
    ``held``: for each key its waiting rows, state, when it expires and its last row done."""

    def __init__(self, columns: Sequence[str], out: Sequence[str], step: Callable, idle_ms: int):
        self.columns, self.out, self.step, self.idle_ms = list(columns), list(out), step, idle_ms

    def __call__(self, bucket, frames: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        mark = store.getCurrentWatermarkMs()
        held = pickle.loads(store.get[0]) if store.exists else {}
        for frame in frames:
            for key, *row in zip(*(_plain(frame[c]) for c in ("key_text", *self.columns))):
                if row[0] // 1000 > mark:
                    one = held.setdefault(key, [[], None, 0, None])
                    one[0].append(tuple(row))
                    one[2] = max(one[2], row[0] // 1000 + self.idle_ms)
        made, due = [], None
        for key, one in list(held.items()):
            made += self._passed(one, mark)
            if not one[0] and one[2] <= mark:
                del held[key]
                continue
            wakes = min(r[0] for r in one[0]) // 1000 if one[0] else one[2]
            due = wakes if due is None else min(due, wakes)
            if len(made) >= OUTPUT:
                yield pd.DataFrame(made, columns=self.out)
                made = []
        if held:
            store.update((pickle.dumps(held),))
            store.setTimeoutTimestamp(due - 1)  # called once the watermark is beyond it, so at ``due``
        elif store.exists:
            store.remove()
        if made:
            yield pd.DataFrame(made, columns=self.out)

    def _passed(self, one: list, mark: int) -> list:
        """Output of the waiting rows of a key that the watermark has passed; ``one`` is brought up to date."""
        waiting, state, _, done = one
        ready = sorted((r for r in waiting if r[0] // 1000 <= mark), key=lambda r: r[:2])
        if not ready:
            return []
        made, start = [], 0
        for i in range(1, len(ready) + 1):  # runs without a silence of ``idle``; the row after one starts anew
            if i < len(ready) and ready[i][0] - ready[i - 1][0] <= self.idle_ms * 1000:
                continue
            fresh = done is None or ready[start][0] - done > self.idle_ms * 1000
            rows, state = self.step(None if fresh else state, ready[start:i])
            made, start, done = made + rows, i, ready[i - 1][0]
        one[0], one[1], one[3] = [r for r in waiting if r[0] // 1000 > mark], state, done
        return made


def _plain(column: pd.Series) -> list:
    return column.astype(object).where(column.notna(), None).tolist()


def ordered(
    rows: DataFrame, keys: Sequence[str], ts: str, ident: str, payload: Sequence[str], out_schema: str, step: Callable, delay: str, idle: str, buckets: int = 1024,
) -> DataFrame:
    """Stream of what ``step`` returns for the rows of every key in event order (see :class:`OrderedState`).

    Rows are final once the watermark, ``delay`` behind the newest row, has passed them; rows older than it are dropped.  A key
    silent for ``idle`` (an interval) beyond its last row starts anew.  Null keys form a key of their own; rows with a null time are dropped.
    The keys of one of ``buckets`` are held together while a micro-batch is at work on it: more keys than some thousands in each call for more.
    """
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # holds state outside the heap
    columns = ["at_us", ident, *payload]
    names = [part.split()[0].strip("`") for part in out_schema.split(",")]
    (idle_ms,) = spark.range(1).select(F.unix_millis(F.lit(0).cast("timestamp") + F.expr(f"interval {idle}"))).first()
    d = rows.where(F.col(ts).isNotNull()).withWatermark(ts, delay).withColumn("at_us", F.unix_micros(ts))
    text = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))
    return d.select(F.pmod(F.xxhash64(text), F.lit(buckets)).alias("bucket"), text.alias("key_text"), ts, *columns).groupBy("bucket").applyInPandasWithState(
        OrderedState(columns, names, step, idle_ms).__call__, out_schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout,
    )


def session_state(ticks: DataFrame, keys: Sequence[str], ts: str, ident: str, price: str, volume: str, delay: str, opening_minutes: int = 30, idle: str = "1 day") -> DataFrame:
    """``ident``, ``session_vwap``, ``opening_high``, ``opening_low`` (of the first ``opening_minutes`` after the session's first tick,
    growing until then) after each tick; ``keys`` hold the session, so every session starts anew."""
    span = opening_minutes * 60_000_000

    def step(state, rows):
        first, pv, vol, high, low = state or (rows[0][0], 0.0, 0.0, None, None)
        out = []
        for us, i, p, v in rows:
            if p is not None and v is not None:
                pv, vol = pv + p * v, vol + v
            if p is not None and us < first + span:
                high, low = p if high is None else max(high, p), p if low is None else min(low, p)
            out.append((i, pv / vol if vol else None, high, low))
        return out, (first, pv, vol, high, low)

    kind = ticks.schema[ident].dataType.simpleString()
    return ordered(ticks, keys, ts, ident, [price, volume],
                   f"{ident} {kind}, session_vwap double, opening_high double, opening_low double", step, delay, idle)


def known_state(union: DataFrame, key: str, ts: str, ident: str, side: str, source: str, value: str, delay: str, idle: str = "3650 days") -> DataFrame:
    """Latest value known from every source at each asking row: ``ident``, ``source``, ``known``, ``known_us`` (when that was).

    Rows with ``side`` 0 set the value of their source, rows with 1 ask and get a row for each source seen by then (none, none of it:
    no row).  Of rows with one time, setting rows come first by ``ident`` only; give them smaller idents, or earlier times.
    """

    def step(state, rows):
        known = dict(state or {})
        out = []
        for us, i, asks, src, v in rows:
            if asks:
                out.extend((i, s, x, at) for s, (x, at) in known.items())
            else:
                known[src] = (v, us)
        return out, known

    kind = union.schema[ident].dataType.simpleString()
    return ordered(union, [key], ts, ident, [side, source, value],
                   f"{ident} {kind}, source string, known string, known_us long", step, delay, idle)


def momentum_state(bars: DataFrame, key: str, ts: str, ident: str, high: str, low: str, close: str, delay: str, ema_span: int = 12, wilder: int = 14, idle: str = "3650 days") -> DataFrame:
    """``ident``, ``ema``, ``rsi``, ``atr`` after each bar: exponential mean of closes, Wilder's strength index and true range, from the first bar
    on (the index from the second).  No losses give 100, neither gains nor losses 50."""
    a, w = 2 / (ema_span + 1), 1 / wilder

    def step(state, rows):
        prev, ema, up, down, atr = state or (None,) * 5
        out = []
        for _, i, h, l, c in rows:  # noqa: E741
            if prev is None:
                ema, atr, rsi = c, h - l, None
            else:
                gain, loss = max(c - prev, 0.0), max(prev - c, 0.0)
                up, down = (gain, loss) if up is None else (up + w * (gain - up), down + w * (loss - down))
                ema, atr = ema + a * (c - ema), atr + w * (max(h - l, abs(h - prev), abs(l - prev)) - atr)
                rsi = 100 - 100 / (1 + up / down) if down > 0 else 100.0 if up > 0 else 50.0
            prev = c
            out.append((i, ema, rsi, atr))
        return out, (prev, ema, up, down, atr)

    kind = bars.schema[ident].dataType.simpleString()
    return ordered(bars, [key], ts, ident, [high, low, close],
                   f"{ident} {kind}, ema double, rsi double, atr double", step, delay, idle)


class GroupSnapshot(StatefulProcessor):
    """One decision group: rows by ticker in map state, emitted once, when the last expected ticker has come."""

    def __init__(self, row_schema: str, columns: Sequence[str], member: str, expected: int, fresh_ms: int):
        self.row_schema, self.columns, self.member, self.expected, self.fresh_ms = row_schema, list(columns), member, expected, fresh_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "member string", self.row_schema)
        self.state = handle.getValueState("state", "first long, published boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, published = self.state.get() if self.state.exists() else (None, False)
        mark = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for row in zip(*(_plain(frame[c]) for c in self.columns)):
                if row[0] // 1000 + self.fresh_ms <= mark:  # stale
                    continue
                if first is None:  # the group's deadline counts from its decision time
                    first = row[0]
                    self.handle.registerTimer(first // 1000 + self.fresh_ms)
                member = (str(row[self.columns.index(self.member)]),)
                held = self.rows.getValue(member) if self.rows.containsKey(member) else None
                if held is None or row[:2] > tuple(held[:2]):
                    self.rows.updateValue(member, row)
        if first is None:
            return
        if not published and sum(1 for _ in self.rows.keys()) >= self.expected:
            published = True
            yield pd.DataFrame([tuple(v) for v in self.rows.values()], columns=self.columns)
        self.state.update((first, published))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def complete_groups(rows: DataFrame, group: str, member: str, ts: str, ident: str, expected: int, delay: str, fresh: str) -> DataFrame:
    """Rows of a decision group, the newest of each member, published once, as soon as ``expected`` members have come.

    A group that is not complete when the watermark passes its decision time (``ts``, the same for all its rows) by ``fresh`` is stale: it is dropped, and rows that
    come later are too late for the watermark and never revive it.  Columns: ``at_us`` (decision time), ``ident`` and all others of ``rows``.
    """
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    columns = ["at_us", ident, *[c for c in rows.columns if c not in (ts, ident)]]
    schema = ", ".join(f"`{c}` {'long' if c == 'at_us' else kinds[c]}" for c in columns)
    (fresh_ms,) = spark.range(1).select(F.unix_millis(F.lit(0).cast("timestamp") + F.expr(f"interval {fresh}"))).first()
    d = rows.where(F.col(ts).isNotNull()).withWatermark(ts, delay).withColumn("at_us", F.unix_micros(ts)).withColumn("group_key", F.col(group))
    return d.select("group_key", ts, *columns).groupBy("group_key").transformWithStateInPandas(
        statefulProcessor=GroupSnapshot(schema, columns, member, expected, fresh_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime",
    )
