"""Failure attribution against a plain pandas computation, dimensions by hand, a hot stratum."""
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import diagnostics as D


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 400
    d = pd.DataFrame({"ticker": [f"T{i % 20:02d}" for i in range(n)], "g": [i // 20 for i in range(n)], "score": rng.integers(0, 8, n) / 8.0, "a": rng.integers(-50, 50, n) / 100.0, "b": rng.integers(-50, 50, n) / 100.0,
                      "sector": np.where(rng.random(n) < 0.8, "hot", "cold"), "cap": rng.integers(0, 3, n).astype(str)})
    d["group_id"] = "g" + d["g"].astype(str)
    d["scope"] = np.where(d["g"] % 2 == 0, "walk_forward", "ticker_holdout")
    d["session"] = pd.to_datetime("2024-01-01") + pd.to_timedelta(d["g"] // 4, unit="D")
    d.loc[[3, 50, 51], "b"] = np.nan
    return d.drop(columns="g")


def chosen(d, k):
    return d.sort_values(["score", "ticker"], ascending=[False, True]).groupby(["scope", "group_id"]).head(k)


def test_attribution_equals_pandas(spark, frame):
    k, draws = 5, 50
    got = {(r.scope, r.outcome): r for r in D.attribution(spark.createDataFrame(frame).withColumn("b", F.when(~F.isnan("b"), F.col("b"))), ["a", "b"], k=k, iterations=draws, seed=9).collect()}
    assert len(got) == 4
    for (scope, o), row in got.items():
        d = frame[frame["scope"] == scope]
        pop = d.groupby("group_id")[o].mean()
        sel = chosen(d, k).groupby("group_id")[o].mean()
        best = d.sort_values([o, "ticker"], ascending=[False, True]).dropna(subset=[o]).groupby("group_id").head(k).groupby("group_id")[o].mean()
        pair = pd.concat([d.groupby("group_id")["session"].first(), pop.rename("p"), sel.rename("s"), best.rename("o")], axis=1).dropna()
        assert row.groups == len(pair) and row.selected_mean == pytest.approx(pair["s"].mean()) and row.oracle_top_k_mean == pytest.approx(pair["o"].mean())
        assert row.selection_delta == pytest.approx((pair["s"] - pair["p"]).mean()) and row.selected_positive_group_rate == pytest.approx((pair["s"] > 1e-12).mean())
        block = pair.assign(d=pair["s"] - pair["p"]).groupby("session").agg(t=("d", "sum"), c=("d", "size")).sort_index()
        pick = lambda i, p: int(hashlib.md5(f"9:{i}:{p}".encode()).hexdigest()[:8], 16) % len(block)
        sums = [block.iloc[[pick(i, p) for p in range(len(block))]].sum() for i in range(draws)]
        low, high = np.quantile([x["t"] / x["c"] for x in sums], [0.025, 0.975])
        assert row.selection_delta_low == pytest.approx(low) and row.selection_delta_high == pytest.approx(high)


def test_strata_equal_pandas(spark, frame):
    k = 5
    d = spark.createDataFrame(frame).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    got = {(r.scope, r.dimension, r.value): r for r in D.strata(d.repartition(7), ["sector", "cap"], ["a", "b"], "a", k=k, minimum_rows=20, minimum_sessions=2).collect()}
    want = 0
    for scope, pop in frame.groupby("scope"):
        sel = chosen(pop, k)
        for dim in ("sector", "cap"):
            for value, s in sel.groupby(dim):
                want += 1
                row, p = got[(scope, dim, value)], pop[pop[dim] == value]
                assert (row.selected_rows, row.population_rows, row.decision_groups, row.sessions) == (len(s), len(p), s["group_id"].nunique(), s["session"].nunique())
                for o in ("a", "b"):
                    assert row[f"selected_{o}"] == pytest.approx(s[o].mean()) and row[f"delta_{o}"] == pytest.approx(s[o].mean() - p[o].mean())
                assert row.selected_positive_rate == pytest.approx((s["a"] > 0).mean())
                assert row.meets_minimum_evidence == (len(s) >= 20 and s["session"].nunique() >= 2)
    assert len(got) == want


def test_dimensions(spark):
    d = spark.createDataFrame([(569, None, 0.0, None), (570, 1, 0.25, "x"), (719, 0, 0.5001, None), (959, 0, 1.0, "y"), (960, 0, None, "z")], "m int, hv int, rk double, s string")
    rows = d.select(D.time_bucket(F.col("m")).alias("t"), D.regime_name(F.col("hv"), F.lit(0), F.lit(2)).alias("r"), D.rank_quartile(F.col("rk")).alias("q"), D.or_unknown(F.col("s")).alias("s")).collect()
    assert [r.t for r in rows] == [None, "opening", "late_morning", "afternoon", None]
    assert [r.r for r in rows] == ["risk_on", "high_volatility", "risk_on", "risk_on", "risk_on"]
    assert [r.q for r in rows] == ["q1_low", "q1_low", "q3", "q4_high", None] and [r.s for r in rows] == ["unknown", "x", "unknown", "y", "z"]


def test_empty_tables(spark, frame):
    none = spark.createDataFrame(frame).limit(0)
    assert D.attribution(none, ["a"]).count() == 0 and D.strata(none, ["cap"], ["a"], "a").count() == 0
