"""Ordered primitives against brute force, with one key holding most rows and heavy ties."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered as O


def skewed(rows=3000, seed=7):
    g = np.random.default_rng(seed)
    keys = np.where(g.random(rows) < 0.6, "HOT", g.choice(["A", "B", "C"], rows))
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(g.integers(0, 10 * 86_400, rows) // 600 * 600, unit="s")
    return pd.DataFrame({"k": keys, "ts": ts, "v": g.integers(0, 40, rows) / 4.0, "i": np.arange(rows)})


def test_as_of_matches_brute_force(spark):
    right, left = skewed(seed=1), skewed(800, seed=2)
    out = O.as_of(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "ts", "ts",
                  {"hit": (None, ["v"]), "big": (F.col("v") > 8, ["v"])}, ["i"], width_s=86_400)
    got = {r.i: (r.hit and r.hit.v, r.big and r.big.v) for r in out.collect()}
    ordered = right.sort_values(["ts", "i"])
    for row in left.itertuples():
        past = ordered[(ordered.k == row.k) & (ordered.ts <= row.ts)]
        big = past[past.v > 8]
        assert got[row.i] == (past.v.iloc[-1] if len(past) else None, big.v.iloc[-1] if len(big) else None)
    assert len(got) == len(left)


def test_range_sums_closed_on_both_ends(spark):
    right, left = skewed(seed=3), skewed(500, seed=4)
    out = O.range_sums(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "ts", "ts",
                       {"2h": 7_200, "1d": 86_400}, {"n": F.lit(1), "s": F.col("v")}, latest=["i"])
    got = {r.i: (r.n_2h, r.n_1d, r.s_1d, r.latest and r.latest._at) for r in out.collect()}
    for row in left.itertuples():
        past = right[(right.k == row.k) & (right.ts <= row.ts)]
        w2, d1 = past[past.ts >= row.ts - pd.Timedelta("2h")], past[past.ts >= row.ts - pd.Timedelta("1d")]
        n2, n1, s1, at = got[row.i]
        assert (n2, n1) == (len(w2), len(d1)) and s1 == pytest.approx(d1.v.sum())
        assert (at is None) == past.empty and (past.empty or pd.Timestamp(at) == past.ts.max())


def test_row_blocks_equal_the_plain_window(spark):
    pdf = skewed(seed=5)
    d = O.row_blocks(spark.createDataFrame(pdf), ["k"], [F.col("ts"), F.col("i")], O.time_block("ts", 86_400), back=5, ahead=3, rows_per_block=16)
    w = O.frame(["k"])
    d = O.own(d.withColumns({"m": F.avg("v").over(O.frame(["k"], -5, 0)), "nx": F.lead("v", 3).over(w)}))
    got = d.toPandas().sort_values(["k", "ts", "i"]).reset_index(drop=True)
    exp = pdf.sort_values(["k", "ts", "i"]).reset_index(drop=True)
    by = exp.groupby("k").v
    assert (got.i == exp.i).all() and (got._rn == by.cumcount() + 1).all()
    assert np.allclose(got.m, by.transform(lambda x: x.rolling(6, min_periods=1).mean()))
    assert np.allclose(got.nx, by.shift(-3), equal_nan=True)


def test_ranks_and_quantiles_with_ties(spark):
    pdf = skewed(seed=6)
    d = spark.createDataFrame(pdf)
    got = O.ranks(d, ["k"], "v").toPandas().sort_values("i")
    assert np.allclose(got.avg_rank, pdf.groupby("k").v.rank(method="average"))
    assert (got.group_n.to_numpy() == pdf.groupby("k").v.transform("size").to_numpy()).all()
    q = O.quantiles(d, ["k"], "v", {"a": 0.025, "b": 0.5, "c": 0.9}).toPandas().set_index("k")
    for name, p in (("a", 0.025), ("b", 0.5), ("c", 0.9)):
        assert np.allclose(q[name].sort_index(), pdf.groupby("k").v.quantile(p).sort_index())


def test_ewm_across_block_groups(spark):
    g = np.random.default_rng(0)
    pdf = pd.concat([pd.DataFrame({"k": "HOT", "_rn": np.arange(1, 20_001), "x": g.normal(100, 5, 20_000)}),
                     pd.DataFrame({"k": "A", "_rn": np.arange(1, 301), "x": g.normal(1, 5, 300)})])
    pdf["late"] = pdf.x.where(pdf._rn >= 13)
    out = O.ewm(spark.createDataFrame(pdf), ["k"], {"f": ("x", 1 / 3, 1), "s": ("x", 2 / 51, 1), "l": ("late", 0.2, 13)}).toPandas().sort_values(["k", "_rn"])
    for k, part in out.groupby("k"):
        x = pdf[pdf.k == k].x
        assert np.allclose(part.f, x.ewm(alpha=1 / 3, adjust=False).mean(), rtol=1e-12)
        assert np.allclose(part.s, x.ewm(span=50, adjust=False).mean(), rtol=1e-12)
        assert np.allclose(part.l, pdf[pdf.k == k].late.ewm(alpha=0.2, adjust=False).mean(), rtol=1e-9, atol=1e-9, equal_nan=True)


def test_greedy_matches_a_loop(spark):
    g = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": g.choice(["A", "B"], 200), "s": g.integers(0, 400, 200)}).drop_duplicates()
    pdf["e"], pdf["i"] = pdf.s + 7, np.arange(len(pdf))
    got = {(r.k, r.i) for r in O.greedy(spark.createDataFrame(pdf), ["k"], "s", "e", "i", 2).collect()}
    want = set()
    for k, part in pdf.sort_values(["s", "i"]).groupby("k"):
        last = None
        for r in part.itertuples():
            if last is None or r.s > last + 2:
                want.add((k, r.i))
                last = r.e
    assert got == want


def test_range_sums_of_many_rows_in_one_window(spark):
    """A row a second for a day, one decision a minute: a frame summed anew for each row takes minutes here."""
    n, at = 86_400, pd.Timestamp("2024-01-01").value // 1000
    right = spark.range(n).select(F.timestamp_micros(F.lit(at) + F.col("id") * 1_000_000).alias("ts"), (F.col("id") % 7).alias("v"))
    left = spark.range(0, n, 60).select("id", F.timestamp_micros(F.lit(at) + F.col("id") * 1_000_000).alias("ts"))
    out = O.range_sums(left, right, [], "ts", "ts", {"6h": 21_600, "7m": 420, "7h": 25_200}, {"n": F.lit(1), "s": F.col("v")})
    total = np.concatenate([[0], np.cumsum(np.arange(n) % 7)])
    for r in out.collect():
        for name, w in (("6h", 21_600), ("7m", 420), ("7h", 25_200)):
            first = max(0, r.id - w)
            assert (r[f"n_{name}"], r[f"s_{name}"]) == (r.id - first + 1, total[r.id + 1] - total[first])
