"""Long frames put together from short ones, ties of the volume z-score, and what the plans of the daily features cost."""
import numpy as np
import pandas as pd

from tidemark.operators import features as W
from tidemark.operators import labels as L
from tidemark.plans import load
from tests.test_queries import SF


def bars(spark, series):
    rows = [pd.DataFrame({"ticker": k, "date": pd.date_range("2020-01-01", periods=len(c)).date, "open": c, "high": c + 1.0, "low": c - 1.0, "close": c, "volume": v}) for k, (c, v) in series.items()]
    return spark.createDataFrame(pd.concat(rows))


def test_long_frames_match_pandas(spark):
    g = np.random.default_rng(5)
    series = {k: (g.normal(100, 20, n), g.integers(1, 60, n).astype(float)) for k, n in (("LONG", 1500), ("SHORT", 30), ("ONE", 1))}
    got = W.daily_windows(bars(spark, series)).toPandas().sort_values(["ticker", "date"])
    for k, part in got.groupby("ticker"):
        c, v = pd.Series(series[k][0]), pd.Series(series[k][1])
        ret = c.pct_change()
        want = {**{f"sma_{n}": c.rolling(n).mean() for n in (20, 50, 200)}, **{f"realized_vol_{n}d": ret.rolling(n).std() for n in (10, 20, 60)},
                "high_252": c.rolling(252, 20).max(), "low_252": c.rolling(252, 20).min(), "recent_high_20": (c + 1).rolling(20, 5).max(), "recent_low_20": (c - 1).rolling(20, 5).min(),
                "prior_high_20": (c + 1).rolling(20, 5).max().shift(), "prior_low_20": (c - 1).rolling(20, 5).min().shift(), "volume_z20": (v - v.rolling(20).mean()) / v.rolling(20).std()}
        for name, x in want.items():
            assert np.allclose(part[name].astype(float), x, rtol=1e-9, atol=1e-9, equal_nan=True), (k, name)


def test_mean_of_a_mean(spark):
    x = np.random.default_rng(6).normal(100, 20, 700)
    got = W.exponential(W.daily_windows(bars(spark, {"A": (x, x)}))).toPandas().sort_values("date")
    mean = lambda s, n: pd.Series(s).ewm(span=n, adjust=False).mean()
    macd = mean(x, 12) - mean(x, 26)
    assert np.allclose(got.macd, macd, atol=1e-9) and np.allclose(got.macd_signal, mean(macd, 9), atol=1e-9)


def test_tie_of_the_z_score_counts(spark):
    """The last volume is half a deviation above the mean, exactly; as a quotient of doubles it can come out below."""
    ties = [[43, 24, 20, 47, 12, 39, 81, 19, 36, 68, 9, 39, 12, 43, 45, 25, 4, 15, 17, 42], [76, 44, 25, 44, 19, 28, 38, 19, 28, 40, 46, 34, 27, 18, 41, 32, 13, 26, 41, 41], [49, 48, 48, 22, 9, 41, 30, 34, 33, 4, 46, 41, 21, 28, 50, 20, 32, 65, 27, 42]]
    d = W.daily_windows(bars(spark, {f"T{i}": (np.arange(1.0, 21.0), np.array(v, float)) for i, v in enumerate(ties)}))
    at = d.where("_rn = 20").select("volume_z20", W.z_reaches("volume_z20", "volume", "volume_sum_20", "volume_squares_20", 20, 0.5).alias("reached")).collect()
    assert len(at) == 3 and all(r.reached and abs(r.volume_z20 - 0.5) < 1e-9 for r in at)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_frame_is_summed_anew_over_many_rows(spark):
    queries, _ = load()
    for name in ("win_03", "win_04", "win_05"):
        text = plan(queries[name](spark, SF))
        assert not any(f"RowFrame, -{k}," in text for k in (251, 199, 59, 49)), name


def test_exponential_means_are_shuffled_once(spark):
    d = W.daily_windows(bars(spark, {"A": (np.arange(1.0, 30.0), np.arange(1.0, 30.0))}))
    exchanges = lambda df: plan(df).count("Exchange hashpartitioning")
    assert exchanges(W.exponential(d).select("macd_histogram", "ema_20")) <= exchanges(d.select("close")) + 1


def test_first_touches_are_looked_for_once(spark):
    d = bars(spark, {"A": (np.arange(1.0, 30.0), np.arange(1.0, 30.0))}).selectExpr("*", "1.0D AS atr_14")
    out = L.entry_exit_labels(d).select("entry_exit_outcome", "bars_to_exit", "net_realized_return", "target_net_positive", "target_entry_success")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_position") == 2
    assert out.where("entry_exit_outcome IS NULL").count() == 5
