"""Fold loop: who is scored how often, and that no label of a scored row reaches its model."""
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as M

FEATURES = ("a", "b")


def rows(spark):
    rng, out = random.Random(6), []
    for fold in (0, 1):
        for role in ("train", "test"):
            for g in range(6):
                for t in range(10):
                    a, b = rng.gauss(0, 1), rng.gauss(0, 1)
                    out.append((fold, role, f"{fold}{role}{g}", f"T{t}", t < 3, a, None if t == 5 else b, int(a + rng.gauss(0, 0.5) > 0), rng.randint(0, 4), rng.choice([0.5, 1.0]), rng.gauss(0, 1)))
    return spark.createDataFrame(out, "fold int, role string, g string, t string, held boolean, a double, b double, y int, grade int, w double, ret double")


def scores(df, kind, target, **options):
    out = M.out_of_fold(df, FEATURES, kind, target, (0, 1), "w", "held", "g", "t", **options)
    got = {}
    for r in out.collect():
        key = (r["audit_scope"], r["fold"], r["g"], r["t"])
        assert key not in got
        got[key] = r["probability_up"]
    return got


@pytest.mark.parametrize(("kind", "target", "options"), [("logistic", "y", {"iterations": 20}), ("trees", "y", {"trees": 5, "depth": 3}), ("ranker", "grade", {"rounds": 4})])
def test_fold_loop(spark, kind, target, options):
    df = rows(spark)
    got = scores(df, kind, target, **options)
    assert len(got) == 2 * 60 + 2 * 18 and sum(k[0] == "ticker_holdout" for k in got) == 36
    test_label = F.when(F.col("role") == "test", 1 - F.col("y")).otherwise(F.col("y")) if target == "y" else F.when(F.col("role") == "test", 4 - F.col("grade")).otherwise(F.col("grade"))
    assert scores(df.withColumn(target, test_label), kind, target, **options) == pytest.approx(got)
    held_label = F.when(F.col("held"), 1 - F.col("y")).otherwise(F.col("y")) if target == "y" else F.when(F.col("held"), 4 - F.col("grade")).otherwise(F.col("grade"))
    moved = scores(df.withColumn(target, held_label), kind, target, **options)
    assert {k: v for k, v in moved.items() if k[0] == "ticker_holdout"} == pytest.approx({k: v for k, v in got.items() if k[0] == "ticker_holdout"})
    assert moved != pytest.approx(got)  # the other model did see them


def test_ranking_metrics(spark):
    df = spark.createDataFrame(
        [("s", "g1", "a", 0.9, 1, 0.1), ("s", "g1", "b", 0.5, 3, -0.2), ("s", "g1", "c", 0.5, 0, 0.4), ("s", "g2", "a", 0.1, 1, 0.3), ("s", "g2", "b", None, 1, 0.3), ("t", "g3", "a", 0.3, 0, 1.0)],
        "scope string, g string, t string, p double, grade int, ret double")
    got = {r["scope"]: r for r in M.ranking_metrics(df, ["scope"], "g", "t", "p", "grade", "ret", 2).collect()}
    ideal, mine = 3 + 1 / 1.584962500721156, 1 + 1.5 / 1.584962500721156
    assert (got["s"]["rows"], got["s"]["tickers"], got["s"]["ranking_groups"]) == (5, 3, 1)
    assert got["s"]["mean_ndcg_at_k"] == pytest.approx(mine / ideal) and got["s"]["mean_top_k_excess_return"] == pytest.approx(-0.05) and got["s"]["mean_top_k_positive_rate"] == 0.5
    assert got["t"]["ranking_groups"] is None and got["t"]["rows"] == 1
