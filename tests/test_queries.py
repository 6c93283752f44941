"""A spread of registered queries against their SQL on the smallest tables (the driver checks all of them)."""
import math
import os

import pytest

from tidemark.plans import load
from tidemark.sources.tables import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PICK = (
    "flagship", "jon_01", "jon_06", "jon_28", "evt_02", "evt_07", "win_04", "win_10", "win_15", "rnk_03", "rnk_09", "rnk_11", "top_02", "set_05", "lbl_03", "lbl_09", "lbl_11", "agg_12",
    "aud_03", "evl_01", "evl_08", "spl_03", "nrm_03", "tim_04", "str_07", "hsh_02", "src_13", "src_20", "snk_04", "pit_01", "trd_01", "udf_01", "stm_02", "stm_06",
)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", PICK)
def test_query_matches_sql(spark, duck, name):
    queries, oracles = load()
    df = queries[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    cur = duck.execute(oracles[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols
    assert got == want


def test_every_query_is_registered_once():
    queries, oracles = load()
    assert len(queries) > 300 and set(oracles) <= set(queries)
