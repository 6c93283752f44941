"""Greedy non-overlap against the plain fold, with islands longer than many blocks."""
import random

import pytest

from tidemark.operators.intervals import non_overlapping, successors


def fold(rows, gap, strict):
    kept, last = [], {}
    for key, s, i, e in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        end = last.get(key)
        if end is None or (s > end + gap if strict else s >= end + gap):
            last[key] = e
            kept.append((key, i))
    number = {}
    out = []
    for key, i in kept:
        number[key] = number.get(key, 0) + 1
        out.append((key, i, number[key]))
    return sorted(out, key=str)


def make(seed, n, keys, longest, spread):
    rng = random.Random(seed)
    return [(rng.choice(keys), s, i, s + rng.randrange(longest)) for i, s in enumerate(rng.randrange(spread) for _ in range(n))]


@pytest.mark.parametrize(("seed", "longest", "spread", "gap", "strict", "block"), [
    (1, 30, 3000, 0, True, 16), (2, 200, 3000, 0, True, 8), (3, 5, 900, 2, False, 32), (4, 1, 50, 4, False, 7), (5, 100_000, 3000, 0, True, 16),
])
def test_against_the_fold(spark, seed, longest, spread, gap, strict, block):
    rows = make(seed, 600, ["a", "a", "a", "b", None], longest, spread)
    frame = spark.createDataFrame(rows + [("a", None, 9001, 5), ("b", 5, 9002, None)], "k string, s long, id long, e long")
    got = non_overlapping(frame, ["k"], "s", "e", "id", gap, strict, width=100, block_rows=block)
    assert sorted(map(tuple, got.collect()), key=str) == fold(rows, gap, strict)


def test_without_keys_and_rows(spark):
    rows = make(9, 300, ["a"], 40, 2000)
    frame = spark.createDataFrame(rows, "k string, s long, id long, e long")
    got = non_overlapping(frame, [], "s", "e", "id", width=100, block_rows=16)
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, n) for _, i, n in fold(rows, 0, True))
    assert non_overlapping(frame.limit(0), ["k"], "s", "e", "id").count() == 0


def test_one_island_of_100_000(spark):
    n = 100_000
    frame = spark.range(n).selectExpr("'a' AS k", "id * 10 AS s", "id", "id * 10 + 25 + id % 3 AS e")  # all overlap their next two
    got = non_overlapping(frame, ["k"], "s", "e", "id", width=100_000, block_rows=512)
    assert sorted(tuple(r) for r in got.collect()) == sorted(fold([("a", 10 * i, i, 10 * i + 25 + i % 3) for i in range(n)], 0, True))
    kept = [r["id"] for r in got.orderBy("id").collect()]
    assert kept == list(range(0, n, 3))
    ahead = successors(frame, ["k"], "s", "e", "id", width=100_000)
    assert ahead.count() == n and ahead.where("_next <= _rn").isEmpty()
