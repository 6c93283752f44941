"""Scores that are no number (0 / 0), that are ties of a rounding, and a sharp s beside a ticker: queries against their SQL."""
import pytest

from tests.test_odd_inputs import odd  # noqa: F401
from tests.test_queries import norm
from tidemark.operators import models as M
from tidemark.plans import load


def same_as_sql(spark, d, con, name):
    queries, oracles = load()
    df = queries[name](spark, d)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    cur = con.execute(oracles[name])
    names = [c[0] for c in cur.description]
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    return got


def test_highest_score_nan_is_ranked_first(spark, odd):  # noqa: F811
    same_as_sql(spark, *odd, "rnk_07")


def test_risk_adjusted_nan_is_ranked_first(spark, odd):  # noqa: F811
    same_as_sql(spark, *odd, "rnk_12")


def test_prediction_table_ranks_nan_first(spark, odd):  # noqa: F811
    same_as_sql(spark, *odd, "mth_09")


def test_missing_reaction_makes_the_interaction_zero(spark, odd):  # noqa: F811
    same_as_sql(spark, *odd, "mth_01")


def test_sharp_s_is_two_letters(spark, odd):  # noqa: F811
    same_as_sql(spark, *odd, "str_02")


@pytest.fixture(scope="module")
def scores(tmp_path_factory):
    """Bars of three events whose score is 0.505, 0.285, ... less one digit's rounding, and bars of zeros."""
    duckdb = pytest.importorskip("duckdb")
    ties = [(o, h, c) for c in range(1, 120) for h in range(c, 125) for o in range(1, h + 1)
            if 200 * c % (h + o) == 0 and 200 * c // (h + o) % 2 and c / 100 / (h / 100 + o / 100) < 200 * c // (h + o) / 200]
    assert len(ties) >= 50
    d, con = str(tmp_path_factory.mktemp("scores")), duckdb.connect()
    rows, k = [], 0
    for user in range(30):
        for day in range(1, 31):
            o, h, c = (0, 0, 0) if (user + day) % 29 == 0 else ties[(user * 37 + day * 11) % len(ties)]
            for second, value in enumerate((o, h, c)):
                rows.append(f"({k}, timestamp '2024-01-{day:02} 10:00:0{second}', {user}, 'view', {value / 100}::double, '{{\"k\": 8}}')")
                k += 1
    con.execute(f"create table e as select * from (values {', '.join(rows)}) t(event_id, ts, user_id, event_type, value, props)")
    con.execute(f"copy (select event_id::bigint as event_id, ts, user_id::bigint as user_id, event_type, value, props from e) to '{d}/events.parquet' (format parquet)")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{d}/events.parquet'")
    return d, con


def test_isotonic_by_fold_on_ties_and_nan(spark, scores):
    same_as_sql(spark, *scores, "mlt_06")


def test_isotonic_on_ties_and_nan(spark, scores):
    got = same_as_sql(spark, *scores, "mlt_07i")
    assert any("NaN" in row for row in got)


def test_sigmoid_keeps_rows_without_a_score(spark, scores):
    d, con = scores
    out = load()[0]["mlt_07"](spark, d).collect()
    assert len(out) == len(load()[0]["mlt_07i"](spark, d).collect()) > 100
    assert {r["calibrated"] is None for r in out if r["probability"] != r["probability"]} == {True}
    assert all(0 < r["calibrated"] < 1 for r in out if r["probability"] == r["probability"])


def test_sigmoid_is_fit_on_finite_scores(spark):
    rows = [(x / 40, int(x % 3 > x / 40 * 2)) for x in range(40)]
    one = M.sigmoid(spark.createDataFrame(rows, "p double, y long"), "p", "y").stages[1]
    other = M.sigmoid(spark.createDataFrame([*rows, (float("nan"), 1), (float("inf"), 0), (None, 1), (0.5, None)], "p double, y long"), "p", "y").stages[1]
    assert one.intercept == pytest.approx(other.intercept) and one.coefficients[0] == pytest.approx(other.coefficients[0])
