"""Queries on odd rows, against their SQL: zero prices, decisions before any known event, letters without a one-letter upper case."""
import pytest

from tests.test_queries import SF, norm
from tidemark.plans import load
from tidemark.sources.tables import TABLES

SCORED = ("agg_08", "agg_14", "agg_22", "agg_24", "aud_18", "aud_23", "evl_01", "evl_02", "evl_03", "evl_05")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The smallest tables with zero values, one late odd event and sharp s beside ticker words."""
    duckdb = pytest.importorskip("duckdb")
    d, con = str(tmp_path_factory.mktemp("odd")), duckdb.connect()
    change = {
        "events": """select * replace (case when user_id % 3 = 0 and extract(day from ts) % 2 = 0 then 0.0 else value end as value) from events
                     union all select 10000000, timestamp '2024-01-05 23:58:00', 777777, 'view', 1.5, '{"k": 8}'
                     union all select 10000001, timestamp '2024-01-04 23:58:00', 888888, 'view', 1.5, '{"k": 7}'""",
        "documents": "select * replace (case when doc_id % 3 = 0 then 'a EN\u00dfx DIE\u00dfx b' when doc_id % 3 = 1 then 'the\ufb01 D\u0131E$on\u00df' else text end as text) from documents",
    }
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for t in TABLES:
        con.execute(f"copy ({change.get(t, f'select * from {t}')}) to '{d}/{t}.parquet' (format parquet)")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return d, con


@pytest.mark.parametrize("name", (*SCORED, "evt_04", "evt_10", "str_03"))
def test_odd_rows_match_sql(spark, odd, name):
    d, con = odd
    queries, oracles = load()
    df = queries[name](spark, d)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    cur = con.execute(oracles[name])
    names = [c[0] for c in cur.description]
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
