"""The composed dataset: equal to its SQL, bars built from line items once, forward returns from the features' own blocks."""
import duckdb
import numpy as np
import pandas as pd

from tests.test_long_frames import bars
from tests.test_queries import SF
from tests.test_score_edges import same_as_sql
from tidemark.operators import features as W
from tidemark.plans import labels, load
from tidemark.sources.tables import TABLES


def test_equals_its_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert len(same_as_sql(spark, SF, con, "pit_03")) > 1000


def test_line_items_are_read_for_one_set_of_bars(spark, monkeypatch):
    made = []
    monkeypatch.setattr(labels, "written", lambda df, label, keep=labels.written: made.append(df) or keep(df, label))
    out = load()[0]["pit_03"](spark, SF)
    assert len(made) == 1 and "lineitem" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert made[0]._jdf.queryExecution().optimizedPlan().toString().count("l_extendedprice#") > 0
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()  # no unpivoted copy of the rows


def test_forward_return_over_block_borders(spark):
    x = np.random.default_rng(3).uniform(1, 2, 1400)
    got = W.daily_windows(bars(spark, {"A": (x, x)}), horizon=5).toPandas().sort_values("date")
    close, entry = pd.Series(got["close"].to_numpy()), pd.Series(got["open"].to_numpy())
    want = close.shift(-5) / entry.shift(-1) - 1
    assert got["future_return"].isna().sum() == 5 and np.allclose(got["future_return"].astype(float), want, equal_nan=True)
