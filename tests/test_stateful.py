"""Ordered state over several micro-batches, one of them out of order, against plain Python over all rows."""
import datetime as dt
import random

import pandas as pd
import pytest

from tidemark.session import scratch_path
from tidemark.streaming import replay as R
from tidemark.streaming import stateful as S

T0 = dt.datetime(2024, 1, 2, 14, 30, tzinfo=dt.timezone.utc)


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def us(t):
    return int(t.timestamp()) * 1_000_000


def fed(spark, batches, schema):
    """A stream that reads one list of rows per micro-batch."""
    src = scratch_path(spark, "fed")
    frames = [spark.createDataFrame(rows, schema) for rows in batches]
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(src)
    return R.open_folder(spark, src, frames[0].schema, files_per_batch=1)


def ticks(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["A", "A", "B"]), at(i), i, round(rng.uniform(9, 11), 3), float(rng.randint(1, 5))) for i in range(n)]


def in_batches(rows, late=2):
    """Five batches by time; every ``late``-th row comes one batch after its time, the whole third batch is shuffled."""
    out, size = [[] for _ in range(6)], len(rows) // 5
    for k, row in enumerate(rows):
        b = min(k // size, 4)
        out[b + (k % late == 0 and k % size >= size - 3)].append(row)
    random.Random(1).shuffle(out[2])
    return [b for b in out if b]


TICK = "k string, ts timestamp, id long, p double, v double"


def test_session_state(spark):
    rows = ticks(3, 200)
    stream = S.session_state(fed(spark, in_batches(rows), TICK), ["k"], "ts", "id", "p", "v", "15 minutes", opening_minutes=30)
    got = sorted(tuple(r) for r in R.replay(stream, "session").collect())
    want, mark = [], at(199 - 15)
    for key in "AB":
        mine = [r for r in rows if r[0] == key]
        for k, (_, t, i, _, _) in enumerate(mine):
            seen = mine[:k + 1]
            opening = [r[3] for r in seen if r[1] < mine[0][1] + dt.timedelta(minutes=30)]
            if t <= mark:
                want.append((i, sum(r[3] * r[4] for r in seen) / sum(r[4] for r in seen), max(opening), min(opening)))
    assert len(got) == len(want) and all(g == pytest.approx(w) for g, w in zip(got, sorted(want)))


def test_momentum_state_and_expiry(spark):
    rows = [(k, t, i, p + 0.5, p - v / 10, p) for k, t, i, p, v in ticks(4, 200) if not 60 <= i < 140 or k == "B"]  # A falls silent
    schema = "k string, ts timestamp, id long, h double, l double, c double"
    got = {r["id"]: r for r in R.replay(S.momentum_state(fed(spark, in_batches(rows), schema), "k", "ts", "id", "h", "l", "c", "15 minutes", idle="40 minutes"), "momentum").collect()}
    checked = 0
    for key in "AB":
        prev = None
        for k, t, i, h, l, c in (r for r in rows if r[0] == key):  # noqa: E741
            if key == "A" and i >= 140 and prev is not None and prev[1] < 60:
                prev = None  # expired: starts anew
            if prev is None:
                ema, atr, up, down, rsi = c, h - l, None, None, None
            else:
                gain, loss = max(c - prev[0], 0), max(prev[0] - c, 0)
                up, down = (gain, loss) if up is None else (up * 13 / 14 + gain / 14, down * 13 / 14 + loss / 14)
                ema, atr = ema * 11 / 13 + c * 2 / 13, atr * 13 / 14 + max(h - l, abs(h - prev[0]), abs(l - prev[0])) / 14
                rsi = 100 - 100 / (1 + up / down) if down else 100
            prev = (c, i)
            if t <= at(199 - 15):
                r = got.pop(i)
                assert (r["ema"], r["atr"]) == pytest.approx((ema, atr)) and (r["rsi"] is None if rsi is None else r["rsi"] == pytest.approx(rsi))
                checked += 1
    assert checked > 100 and not got


def test_known_state(spark):
    rng = random.Random(8)
    rows = [(k, t, i, int(i % 3 == 0), rng.choice("xy"), str(i)) for k, t, i, _, _ in ticks(5, 200)]
    stream = S.known_state(fed(spark, in_batches(rows), "k string, ts timestamp, id long, side int, source string, value string"), "k", "ts", "id", "side", "source", "value", "15 minutes")
    got = sorted(tuple(r) for r in R.replay(stream, "known").collect())
    want = []
    for k, t, i, side, _, _ in rows:
        if side and t <= at(199 - 15):
            for source in "xy":
                past = [r for r in rows if r[0] == k and not r[3] and r[4] == source and r[1] <= t]
                want.extend([(i, source, past[-1][5], us(past[-1][1]))] if past else [])
    assert got == sorted(want)


def test_complete_groups(spark):
    schema = "g string, m string, ts timestamp, id long, x string"
    batches = [
        [("g1", "A", at(0), 1, "a"), ("g1", "B", at(0), 2, "b")],
        [("g2", "A", at(10), 4, "a"), ("g1", "A", at(0), 5, "newer"), ("g3", "A", at(20), 6, "a")],
        [("g1", "C", at(0), 7, "c"), ("g2", "B", at(10), 8, "b")],  # g1 complete
        [("g4", m, at(60), 10 + k, m) for k, m in enumerate("ABC")],  # at once; g2 and g3 become stale
        [("g2", "C", at(10), 20, "c"), ("g5", "A", at(90), 21, "a")],
    ]
    stream = S.complete_groups(fed(spark, batches, schema), "g", "m", "ts", "id", 3, "30 minutes", "15 minutes")
    got = sorted((r["g"], r["m"], r["x"]) for r in R.replay(stream, "groups").collect())
    assert got == [("g1", "A", "newer"), ("g1", "B", "b"), ("g1", "C", "c"), ("g4", "A", "A"), ("g4", "B", "B"), ("g4", "C", "C")]


class Store:
    """State of one bucket, kept by hand."""

    def __init__(self):
        self.mark, self.value, self.timeout = 0, None, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentWatermarkMs(self):
        return self.mark

    def update(self, value):
        self.value = value

    def setTimeoutTimestamp(self, ms):
        self.timeout = ms

    def remove(self):
        self.value = None


def test_one_call_serves_many_keys():
    store, calls = Store(), []

    def step(state, rows):
        calls.append(rows)
        return [(r[1], (state or 0) + k + 1) for k, r in enumerate(rows)], (state or 0) + len(rows)

    work = S.OrderedState(["at_us", "id"], ["id", "n"], step, 1000)
    frame = pd.DataFrame({"key_text": [f"k{i % 100}" for i in range(300)], "at_us": [(i // 100 + 1) * 100_000 for i in range(300)], "id": range(300)})
    assert list(work(None, iter([frame]), store)) == [] and store.timeout == 99  # all wait, in one value
    store.mark = 200
    (out,) = work(None, iter([]), store)
    assert sorted(map(tuple, out.values.tolist())) == [(i, i // 100 + 1) for i in range(200)] and store.timeout == 299
    late = pd.DataFrame({"key_text": ["k0", "k0"], "at_us": [200_000, 250_000], "id": [900, 901]})  # the first is too late
    assert list(work(None, iter([late]), store)) == [] and store.timeout == 249
    store.mark = 1250
    (out,) = work(None, iter([]), store)
    assert dict(out.values.tolist())[901] == 3 and dict(out.values.tolist())[200] == 4 and len(out) == 101
    assert store.timeout == 1299  # silence of ``idle``
    store.mark = 1300
    assert list(work(None, iter([]), store)) == [] and not store.exists
    assert len(calls) == 200
