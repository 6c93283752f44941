"""Hand-computed paths, no-look-ahead invariance, tamper detection."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.clock import et_date, et_minute
from tidemark.operators import features as W
from tidemark.operators import joins as J
from tidemark.operators import labels as L
from tidemark.operators.audits import audit
from tidemark.sources import sinks as K


def five_minute_bars(spark, steps, atr=1.0, n=7):
    start = pd.Timestamp("2026-07-08 14:30:00")
    rows = [(t, start + pd.Timedelta(minutes=5 * i), 100.0 + s * i, 100.0 + s * i + 1, 100.0 + s * i - 1, 100.0 + s * i, 1000.0, atr)
            for t, s in steps.items() for i in range(n)]
    d = spark.createDataFrame(pd.DataFrame(rows, columns="ticker timestamp open high low close volume atr_14".split()))
    return d.withColumns({"session_date_et": et_date("timestamp"), "minute_et": et_minute("timestamp")})


def test_label_arithmetic(spark):
    d = L.session_labels(five_minute_bars(spark, {"AAA": 2.0, "CCC": -1.0}), (1, 2), 2, 5, cost_bps=10, target_atr=1, stop_atr=1)
    rows = {(r.ticker, r.timestamp.minute): r for r in d.collect()}
    a = rows[("AAA", 30)]  # entry 102, closes 102 and 104
    assert a.net_return_10m == pytest.approx(104 / 102 - 1 - 0.001)
    assert a.path_outcome == "stop_first" and a.path_outcome_bar == 1  # 103 and 101 touched in one bar: the stop wins
    assert a.bars_to_mfe_10m == 2 and len([k for k in rows if k[0] == "AAA"]) == 5
    up = L.session_labels(five_minute_bars(spark, {"AAA": 2.0}), (1, 2), 2, 5, target_atr=1, stop_atr=1, ambiguous="target").first()
    assert up.path_outcome == "target_first" and up.path_realized_return_net == pytest.approx(103 / 102 - 1 - 0.001)


def test_gap_drops_the_horizon(spark):
    bars = five_minute_bars(spark, {"AAA": 2.0}).where(F.minute("timestamp") != 40)
    left = {r.timestamp.minute for r in L.session_labels(bars, (1, 2), 2, 5).collect()}
    assert 30 not in left and 35 not in left and 45 in left


def test_future_rows_cannot_change_past_features(spark):
    bars = five_minute_bars(spark, {"AAA": 2.0, "BBB": 1.0}, n=30)
    cut = "2026-07-08 15:30:00"
    cols = ["ticker", "timestamp", "session_vwap", "opening_range_high", "return_3bar", "volatility_6bar"]
    full = W.session_windows(bars).where(F.col("timestamp") <= cut).select(*cols)
    short = W.session_windows(bars.where(F.col("timestamp") <= cut)).select(*cols)
    assert full.exceptAll(short).isEmpty() and short.exceptAll(full).isEmpty()


def test_exact_membership_counts(spark):
    ts = pd.Timestamp
    m = spark.createDataFrame(pd.DataFrame({"ticker": ["A", "A", "A"], "f": [ts("2024-01-01"), ts("2024-02-01"), ts("2024-01-20")],
                                            "t": [ts("2024-02-01"), ts("2024-03-01"), ts("2024-01-25")], "id": [10, 20, 30], "sector": ["x", "y", "z"]}))
    d = spark.createDataFrame(pd.DataFrame({"ticker": "A", "at": [ts("2023-12-31"), ts("2024-01-01"), ts("2024-01-22"), ts("2024-02-01"), ts("2024-03-01")]}))
    out = J.interval_match(d, m, ["ticker"], "at", F.col("f"), F.col("t"), "id", ["sector"]).orderBy("at").collect()
    assert [(r.match_count, r.sector) for r in out] == [(0, None), (1, "x"), (2, None), (1, "y"), (0, None)]


def test_tampered_artifact_is_refused(spark, tmp_path):
    d = spark.createDataFrame(pd.DataFrame({"ticker": ["A", "B"], "x": [1.0, 2.0], "at": pd.to_datetime(["2024-01-01", "2024-01-02"])}))
    path = str(tmp_path / "a")
    K.write_artifact(d, path, "bars", audit(d, {"neg": "x < 0"}, {"id": ["ticker"]}), "at", production=True)
    assert K.load_artifact(spark, path, "bars").count() == 2
    d.withColumn("x", F.col("x") + 1).write.mode("overwrite").parquet(f"{path}/data")
    with pytest.raises(K.AuditFailed, match="content"):
        K.load_artifact(spark, path, "bars")
    with pytest.raises(K.AuditFailed):
        K.write_artifact(d, str(tmp_path / "b"), "bars", audit(d, {"small": "x < 2"}), "at")
