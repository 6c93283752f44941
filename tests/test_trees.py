"""Trees of a level at a time against plain numpy, and gradients against a double loop."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import trees as T


def data(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 3)
    x[:, 3] = 1.0  # constant
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    w = rng.integers(1, 4, n) / 2
    rows = [(i, [float(v) for v in x[i]], int(y[i]), float(w[i])) for i in range(n)]
    return x, y, w, spark.createDataFrame(rows, "i long, x array<double>, y int, w double")


def plain(x, y, w, tree, depth, seed, k, node=0, level=0):
    """(feature, threshold) by node of one extremely randomised tree, grown by recursion."""
    d = x.shape[1]
    if level == depth or len(set(y)) < 2:
        return {}
    u = T.drawn(seed, tree, node, d)
    lo, hi = x.min(0), x.max(0)
    usable = np.flatnonzero(lo < hi)
    best = None
    for f in sorted(usable[np.argsort(u[d:][usable], kind="stable")][:k]):
        cut = lo[f] + u[f] * (hi[f] - lo[f])
        left = x[:, f] <= cut
        score = sum(sum(w[s & (y == c)].sum() ** 2 for c in (0, 1)) / w[s].sum() for s in (left, ~left))
        if best is None or score > best[0] + 1e-12:
            best = (score, f, cut, left)
    if best is None:
        return {}
    _, f, cut, left = best
    return {node: (f, cut)} | plain(x[left], y[left], w[left], tree, depth, seed, k, 2 * node + 1, level + 1) | plain(x[~left], y[~left], w[~left], tree, depth, seed, k, 2 * node + 2, level + 1)


def test_extra_trees(spark):
    x, y, w, frame = data(spark)
    made = T.extra_trees(frame.repartition(3), "x", "y", "w", trees=6, depth=3, seed=9)
    again = T.extra_trees(frame.orderBy(F.desc("i")).coalesce(1), "x", "y", "w", trees=6, depth=3, seed=9)
    assert (made.feature == again.feature).all() and (made.threshold == again.threshold).all() and (made.share == again.share).all()
    for tree in range(6):
        want = plain(x, y, w, tree, 3, 9, 2)
        got = {n: (f, made.threshold[tree, n]) for n, f in enumerate(made.feature[tree]) if f >= 0}
        assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n]) for n in want)
    p = made.predict(x)
    assert ((p > 0.5) == (y == 1)).mean() > 0.85 and 0 <= p.min() and p.max() <= 1
    assert T.extra_trees(frame.limit(0), "x", "y", "w", trees=2).predict(x[:3]).tolist() == [0, 0, 0]


def test_pair_gradients():
    rng = np.random.default_rng(4)
    s, y = rng.normal(size=12), rng.integers(0, 4, 12).astype(float)
    s[3] = s[7]
    order = sorted(range(12), key=lambda i: (-s[i], i))
    rank = {i: r for r, i in enumerate(order, 1)}
    ideal = sum((2 ** v - 1) / math.log2(r + 1) for r, v in enumerate(sorted(y, reverse=True), 1))
    g, h = [0.0] * 12, [0.0] * 12
    for i in range(12):
        for j in range(12):
            if y[i] > y[j]:
                change = abs(2 ** y[i] - 2 ** y[j]) * abs(1 / math.log2(1 + rank[i]) - 1 / math.log2(1 + rank[j])) / ideal
                p = 1 / (1 + math.exp(s[i] - s[j]))
                for a, sign in ((i, -1), (j, 1)):
                    g[a] += sign * change * p
                    h[a] += change * p * (1 - p)
    got = T.pair_gradients(s, y)
    assert got[0] == pytest.approx(g) and got[1] == pytest.approx(h)
    assert T.pair_gradients(s, np.zeros(12))[0].tolist() == [0] * 12


def ndcg(scores, grades, k=10):
    order = np.argsort(-scores, kind="stable")
    gain = lambda v: sum(x / math.log2(i + 2) for i, x in enumerate(v[:k]))
    return gain(grades[order]) / gain(np.sort(grades)[::-1])


def test_lambda_mart(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(40):
        level = rng.normal() * 5  # a group's level says nothing about order within it
        for i in range(15):
            a, b = rng.normal(), rng.normal()
            rows.append((g % 2, f"g{g}", i, [float(level + a), float(a - b), float(b)], int(np.clip(2 + a + 0.3 * rng.normal(), 0, 4)), 1.0))
    rows.append((0, "alone", 0, [0.0, 0.0, 0.0], 4, 1.0))
    frame = spark.createDataFrame(rows, "m int, g string, i int, x array<double>, y int, w double")
    made = T.lambda_mart(frame, "m", "g", "i", "x", "y", "w", rounds=12, step=0.3)
    again = T.lambda_mart(frame.orderBy(F.desc("i")).coalesce(1), "m", "g", "i", "x", "y", "w", rounds=12, step=0.3)
    for m in (0, 1):
        assert (made[m].feature == again[m].feature).all() and made[m].value == pytest.approx(again[m].value)
        values = []
        for g in {r[1] for r in rows if r[0] != m and r[1] != "alone"}:  # groups of the other model
            mine = [r for r in rows if r[1] == g]
            x, y = np.array([r[3] for r in mine]), np.array([r[4] for r in mine], float)
            values.append((ndcg(made[m].predict(x), y), ndcg(x[:, 0], y)))
        assert np.mean([v[0] for v in values]) > 0.85
    assert T.lambda_mart(frame.limit(0), "m", "g", "i", "x", "y", "w") == {}
