"""Boosted classifiers on sums of equal rows: against a plain form over rows, and the fold loop."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_models import rows, scores
from tidemark.operators import boosting as B


def plain(binned, y, w, rounds, step, depth):
    """Margins of rows (rows x features), grown by recursion over the rows themselves."""
    sign, out = 2 * y - 1, np.zeros(len(y))

    def leafed(at, target, left):
        value = (w[at] * target[at]).sum() / w[at].sum()
        best = (1e-9 * w[at].sum(), None)
        for f in range(binned.shape[1]) if left else ():
            for b in range(binned[:, f].max()):
                parts = [s for s in (at & (binned[:, f] <= b), at & (binned[:, f] > b))]
                if not all(p.any() for p in parts):
                    continue
                gain = sum((w[p] * target[p]).sum() ** 2 / w[p].sum() for p in parts) - (w[at] * target[at]).sum() ** 2 / w[at].sum()
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, parts)
        if best[1] is None:
            return np.where(at, value, 0)
        return sum(leafed(p, target, left - 1) for p in best[1])

    for k in range(rounds):
        target = sign.astype(float) if k == 0 else 4 * sign / (1 + np.exp(2 * sign * out))
        out = out + (1.0 if k == 0 else step) * leafed(np.ones(len(y), bool), target, depth)
    return out


def test_sums_of_equal_rows_give_the_same_trees():
    rng = np.random.default_rng(5)
    binned = np.stack([rng.integers(0, 4, 300), rng.integers(0, 3, 300)], 1)
    y, w = (binned[:, 0] + rng.normal(size=300) > 1.5).astype(int), rng.uniform(0.5, 2, 300)
    cell = np.ravel_multi_index(binned.T, (4, 3))
    got = B.margins(np.bincount(cell, w * (1 - y), 12), np.bincount(cell, w * y, 12), (4, 3), 6, 0.3, 3)
    assert got[cell] == pytest.approx(plain(binned, y, w, 6, 0.3, 3))
    assert B.margins(np.zeros(4), np.zeros(4), (2, 2), 3, 0.3, 2).tolist() == [0] * 4


def test_fold_loop_of_boosted_models(spark):
    df = rows(spark)
    got = scores(df, "boosted", "y", rounds=20)
    assert len(got) == 2 * 60 + 2 * 18 and all(0 < p < 1 for p in got.values())
    odd = df.withColumn("b", F.when(F.col("b").isNull(), float("nan")).otherwise(F.col("b")))
    assert scores(odd, "boosted", "y", rounds=20) == pytest.approx(got)
    test_label = F.when(F.col("role") == "test", 1 - F.col("y")).otherwise(F.col("y"))
    assert scores(df.withColumn("y", test_label), "boosted", "y", rounds=20) == got
    label = {(r["fold"], r["g"], r["t"]): r["y"] for r in df.where("role = 'test'").collect()}
    assert np.mean([(p >= 0.5) == label[k[1:]] for k, p in got.items()]) > 0.7


def test_jobs_do_not_grow_with_the_rounds(spark):
    df, tracker = rows(spark), spark.sparkContext.statusTracker()
    counts = []
    for rounds in (2, 150):
        group = f"boosted-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        scores(df, "boosted", "y", rounds=rounds)
        counts.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1] < 40
