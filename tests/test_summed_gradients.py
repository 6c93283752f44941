"""Gradients of large groups: equal to those by pairs, in memory that does not grow with the pairs."""
import tracemalloc

import numpy as np
import pytest

from tidemark.operators import trees as T


@pytest.mark.parametrize(("n", "different", "spread"), [(300, 300, 0.3), (900, 40, 2.0), (1500, 1500, 8.0), (400, 1, 1.0), (2, 2, 60.0)])
def test_sums_equal_pairs(monkeypatch, n, different, spread):
    rng = np.random.default_rng(n)
    s = rng.choice(rng.normal(size=different) * spread, n)
    for y in (rng.integers(0, 5, n).astype(float), rng.choice([0.0, 2.5], n), np.zeros(n)):
        got = T.summed_gradients(s, y)
        monkeypatch.setattr(T, "PAIRS", n)
        want = T.pair_gradients(s, y)
        assert got[0] == pytest.approx(want[0], rel=1e-9, abs=1e-12) and got[1] == pytest.approx(want[1], rel=1e-9, abs=1e-12)


def test_memory_of_a_large_group():
    rng = np.random.default_rng(1)
    s, y = rng.normal(size=20_000), rng.integers(0, 5, 20_000).astype(float)
    tracemalloc.start()
    g, h = T.pair_gradients(s, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and abs(g.sum()) < 1e-6 and (h >= 0).all()
