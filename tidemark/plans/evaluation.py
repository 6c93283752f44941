"""EVL queries over the evidence view."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import crosssection as X
from tidemark.operators import diagnostics as D
from tidemark.operators import evaluation as V
from tidemark.plans.crosssection import ASEL, _NDCG, PHASE, QCUT, SEL, SWING_PHASE, phase_trades, quantile_trades, selected, swing_trades
from tidemark.plans.fmt import n, r, s, us
from tidemark.plans.registry import query
from tidemark.session import written
from tidemark.sources.views import OUTCOMES

EX = ("evidence_x",)
_bin = lambda op: " + ".join(f"CAST(score {op} {i * 0.1!r}e0 AS INT)" for i in range(1, 10))


def _ece(op: str, name: str) -> str:
    return (f"(SELECT scope, sum(c * abs(t - m)) / sum(c) AS {name} FROM (SELECT scope, {_bin(op)} AS b, count(*) AS c, avg(target) AS t, avg(score) AS m "
            "FROM evidence_x GROUP BY 1, 2) GROUP BY 1)")


@query("evl_01", f"""WITH c AS (SELECT scope, score, count(*) AS eq, sum(target) AS pos FROM evidence_x GROUP BY 1, 2),
 d AS (SELECT *, sum(eq) OVER w AS le, sum(pos) OVER w AS ple, sum(eq) OVER t AS k, sum(pos) OVER t AS p FROM c
   WINDOW w AS (PARTITION BY scope ORDER BY score), t AS (PARTITION BY scope)),
 cu AS (SELECT scope, (sum(pos * (le - (eq - 1) / 2.0::DOUBLE)) - max(p) * (max(p) + 1) / 2.0::DOUBLE) / (max(p)::DOUBLE * (max(k) - max(p))) AS auc,
   sum(pos::DOUBLE * (p - ple + pos) / (k - le + eq)) / max(p) AS ap FROM d GROUP BY 1),
 b AS (SELECT scope, count(*) AS rows, avg(CAST((score >= 0.5) = (target = 1) AS INT)) AS acc, coalesce(sum(target) FILTER (WHERE score >= 0.5)::DOUBLE / nullif(count(*) FILTER (WHERE score >= 0.5), 0), 0) AS prec,
   sum(target) FILTER (WHERE score >= 0.5)::DOUBLE / sum(target) AS rec, 2 * sum(target) FILTER (WHERE score >= 0.5)::DOUBLE / (count(*) FILTER (WHERE score >= 0.5) + sum(target)) AS f1,
   avg((score - target) * (score - target)) AS brier, avg(-(target * ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, score))) + (1 - target) * ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, score))))) AS ll,
   avg(target) AS base, quantile_cont(score, 0.9) AS cut FROM evidence_x GROUP BY 1),
 tp AS (SELECT e.scope, avg(target) AS tr FROM evidence_x e JOIN b ON b.scope = e.scope WHERE score >= b.cut GROUP BY 1)
SELECT b.scope, rows, round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision, round(acc, 6) AS accuracy, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1,
 round(brier, 6) AS brier_score, round(ll, 6) AS log_loss, round(base, 6) AS base_positive_rate, round(tr, 6) AS top_decile_positive_rate, round(tr / base, 6) AS top_decile_lift,
 round(x.ece, 6) AS expected_calibration_error FROM b JOIN cu USING (scope) JOIN tp USING (scope) JOIN {_ece('>=', 'ece')} x USING (scope)""", EX)
def evl_01(v):
    """Classification metrics per scope."""
    out = V.classification(v.evidence, ["scope"], "target", "score")
    return out.select("scope", "rows", *[r(c) for c in out.columns if c not in ("scope", "rows")])


@query("evl_02", f"""SELECT scope, round(a.l, 6) AS ece_left_closed, round(b.r, 6) AS ece_right_closed FROM {_ece('>=', 'l')} a JOIN {_ece('>', 'r')} b USING (scope)""", EX)
def evl_02(v):
    """Expected calibration error with both edge conventions."""
    a = V.calibration_error(v.evidence, ["scope"], "target", "score")
    b = V.calibration_error(v.evidence, ["scope"], "target", "score", right_closed=True).withColumnRenamed("expected_calibration_error", "rc")
    return a.join(b, "scope").select("scope", r("expected_calibration_error", "ece_left_closed"), r("rc", "ece_right_closed"))


@query("evl_03", """SELECT scope, round(avg((score - target) * (score - target)), 6) AS brier_before, round(avg((0.5 * score + 0.25 - target) * (0.5 * score + 0.25 - target)), 6) AS brier_after,
 round(avg(-(target * ln(0.5 * score + 0.25) + (1 - target) * ln(0.75 - 0.5 * score))), 6) AS log_loss_after FROM evidence_x GROUP BY 1""", EX)
def evl_03(v):
    """Brier and log loss before and after a calibration map."""
    d = v.evidence.withColumn("q", 0.5 * F.col("score") + 0.25)
    sq = lambda p: F.avg((F.col(p) - F.col("target")) * (F.col(p) - F.col("target")))
    y = F.col("target")
    return d.groupBy("scope").agg(r(sq("score"), "brier_before"), r(sq("q"), "brier_after"),
                                  r(F.avg(-(y * F.log("q") + (1 - y) * F.log(1 - F.col("q")))), "log_loss_after"))


def _econ_sql(keys: str, trades: str, group: str = "group_id", extra: str = "") -> str:
    k = ", ".join(keys.split())
    on = f"USING ({k})"
    return f"""bs AS (SELECT {k}, count(ret) AS selected_trades, count(DISTINCT {group}) AS selected_decision_groups, avg(ret) AS m{extra}, avg(CAST(ret > 0 AS INT)) AS wr,
   sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) AS ga, -sum(CASE WHEN ret < 0 THEN ret ELSE 0 END) AS lo FROM {trades} GROUP BY ALL),
 pg AS (SELECT {k}, session, {group}, avg(ret) AS g FROM {trades} GROUP BY ALL), ps AS (SELECT {k}, session, sum(g) AS sr FROM pg GROUP BY ALL),
 eq AS (SELECT *, product(1 + sr) OVER (PARTITION BY {k} ORDER BY session ROWS UNBOUNDED PRECEDING) AS e FROM ps),
 dd AS (SELECT *, e / max(e) OVER (PARTITION BY {k} ORDER BY session ROWS UNBOUNDED PRECEDING) - 1 AS d FROM eq),
 ss AS (SELECT {k}, arg_max(e, session) - 1 AS cum, abs(min(d)) AS mdd, avg(CAST(sr < 0 AS INT)) AS neg, count(*) AS sessions FROM dd GROUP BY ALL),
 ec AS (SELECT {k}, selected_trades, selected_decision_groups, m AS avg_trade_return, wr AS win_rate, CASE WHEN lo > 0 THEN ga / lo WHEN ga > 0 THEN ga / 1e-12 END AS profit_factor, cum AS cumulative_return,
   mdd AS max_drawdown, neg AS negative_session_rate, sessions, cum / nullif(mdd, 0) AS return_drawdown_ratio{', ex AS avg_excess_return' if extra else ''} FROM bs JOIN ss {on})"""


_EC_OUT = ", ".join(f"round({c}, 6) AS {c}" for c in ("avg_trade_return", "win_rate", "profit_factor", "cumulative_return", "max_drawdown", "negative_session_rate", "return_drawdown_ratio"))
ECON = ("avg_trade_return", "win_rate", "profit_factor", "cumulative_return", "max_drawdown", "negative_session_rate", "return_drawdown_ratio")


def econ_out(df, *keys):
    return df.select(*keys, "selected_trades", "selected_decision_groups", "sessions", *[r(c) for c in ECON])


@query("evl_04", f"WITH {SEL}, {_econ_sql('scope', 'sel')} SELECT scope, selected_trades, selected_decision_groups, sessions, {_EC_OUT} FROM ec", EX)
def evl_04(v):
    """Trade economics of the top-k selection per scope (compounded)."""
    return econ_out(V.economics(selected(v), ["scope"], "session", "group_id", "ret"), "scope")


@query("evl_04b", f"""WITH {QCUT}, p AS (SELECT session, avg(ret) AS pr FROM tq GROUP BY 1), c AS (SELECT *, sum(pr) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING) AS e FROM p),
 d AS (SELECT *, e - max(e) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING) AS dd FROM c),
 t AS (SELECT count(*) AS n, avg(ret) AS m, median(ret) AS md, avg(CAST(ret > 0 AS INT)) AS wr, avg(target) AS hr FROM tq)
SELECT (SELECT n FROM t) AS selected_trades, round((SELECT n FROM t)::DOUBLE / (SELECT count(*) FROM evidence_x), 6) AS selected_fraction, round((SELECT m FROM t), 6) AS avg_trade_return,
 round((SELECT md FROM t), 6) AS median_trade_return, round((SELECT wr FROM t), 6) AS win_rate, round((SELECT hr FROM t), 6) AS target_hit_rate, round(sum(pr), 6) AS cumulative_period_return,
 round(abs(min(dd)), 6) AS max_drawdown, round(min(pr), 6) AS worst_period_return, count(*) AS periods FROM d""", EX)
def evl_04b(v):
    """Profit summary of a quantile selection with additive drawdown."""
    from tidemark.operators.ordered import quantiles

    tq = quantile_trades(v)
    p = tq.groupBy("session").agg(F.avg("ret").alias("session_return"))
    e = V.equity(p, [], "session", additive=True)
    t = tq.agg(F.count(F.lit(1)).alias("selected_trades"), F.avg("ret").alias("avg_trade_return"),
               F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.avg("target").alias("target_hit_rate"))
    med = quantiles(tq, [], "ret", {"median_trade_return": 0.5})
    scored = v.evidence.agg(F.count(F.lit(1)).alias("scored"))
    d = e.agg(F.sum("session_return").alias("cumulative_period_return"), F.abs(F.min("drawdown")).alias("max_drawdown"),
              F.min("session_return").alias("worst_period_return"), F.count(F.lit(1)).alias("periods"))
    one = d.join(F.broadcast(t)).join(F.broadcast(med)).join(F.broadcast(scored))  # single-row aggregates
    return one.select("selected_trades", r(F.col("selected_trades") / F.col("scored"), "selected_fraction"), r("avg_trade_return"), r("median_trade_return"), r("win_rate"),
                      r("target_hit_rate"), r("cumulative_period_return"), r("max_drawdown"), r("worst_period_return"), "periods")


@query("evl_05", f"WITH {SEL}, pg AS (SELECT scope, session, group_id, avg(ret) AS g FROM sel GROUP BY ALL) SELECT scope, CAST(session AS VARCHAR) AS session, round(sum(g), 6) AS session_return FROM pg GROUP BY ALL", EX)
def evl_05(v):
    """Portfolio returns: mean per group, summed per session."""
    return V.period_returns(selected(v), ["scope"], "session", "group_id", "ret").select("scope", s("session"), r("session_return"))


@query("evl_06", f"WITH {SEL}, {_econ_sql('scope', 'sel')} SELECT scope, CAST(session AS VARCHAR) AS session, round(e, 6) AS equity, round(d, 6) AS drawdown, round((SELECT profit_factor FROM ec WHERE ec.scope = dd.scope), 6) AS profit_factor FROM dd", EX)
def evl_06(v):
    """Equity curve, drawdown and profit factor."""
    sel = selected(v)
    e = V.equity(V.period_returns(sel, ["scope"], "session", "group_id", "ret"), ["scope"], "session")
    pf = sel.groupBy("scope").agg(V.profit_factor("ret").alias("profit_factor"))
    return e.join(pf, "scope").select("scope", s("session"), r("equity"), r("drawdown"), r("profit_factor"))


@query("evl_07", f"""WITH {SWING_PHASE}, {_econ_sql('phase', 'st', 'session')} SELECT min(selected_trades) AS selected_trades, round(min(avg_trade_return), 6) AS avg_trade_return, round(min(win_rate), 6) AS win_rate,
 round(min(profit_factor), 6) AS profit_factor, round(min(cumulative_return), 6) AS cumulative_return, round(max(max_drawdown), 6) AS max_drawdown, round(max(negative_session_rate), 6) AS negative_session_rate FROM ec""", EX)
def evl_07(v):
    """Worst case over phases: minimum of the goods, maximum of the bads."""
    e = V.economics(swing_trades(v).withColumn("g", F.col("session")), ["phase"], "session", "g", "ret")
    names = ("selected_trades", "avg_trade_return", "win_rate", "profit_factor", "cumulative_return", "max_drawdown", "negative_session_rate")
    c = V.conservative(e, names)
    return c.select("selected_trades", *[r(x) for x in names[1:]])


def boot_sql(blocks: str, it: int, seed: int) -> str:
    """blocks: CTE with (session, t, c)."""
    return f"""bl AS (SELECT *, row_number() OVER (ORDER BY session) - 1 AS pos, count(*) OVER () AS n FROM {blocks}),
 dr AS (SELECT i, CAST('0x' || substr(md5('{seed}:' || i || ':' || pos), 1, 8) AS BIGINT) % n AS pick FROM bl, range({it}) z(i)),
 sa AS (SELECT i, sum(t) / nullif(sum(c), 0) AS v FROM dr JOIN bl ON bl.pos = dr.pick GROUP BY 1),
 ci AS (SELECT quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM sa), pt AS (SELECT sum(t) / sum(c) AS point FROM bl)"""


@query("evl_08", f"""WITH {SEL}, b0 AS (SELECT session, sum(ret) AS t, count(ret)::DOUBLE AS c FROM sel GROUP BY 1), {boot_sql('b0', 1000, 42)}
SELECT round(point, 6) AS point, round(low, 6) AS low, round(high, 6) AS high FROM pt, ci""", EX)
def evl_08(v):
    """Session-block bootstrap interval of the mean trade return."""
    b = selected(v).groupBy("session").agg(F.sum("ret").alias("t"), F.count("ret").cast("double").alias("c"))
    return V.bootstrap(b, [], "session", "t", "c", 1000, 42).select(r("point"), r("low"), r("high"))


@query("evl_09", f"""WITH RECURSIVE {_NDCG}, nn AS (SELECT avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END) AS m, count(*) AS k FROM nd WHERE rows >= 2),
 cand AS (SELECT * FROM evidence_x WHERE downside <= 0.9 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, ticker) <= 10),
 g AS (SELECT group_id, min(entry_time) AS en, max(exit_time) AS ex, row_number() OVER (ORDER BY min(entry_time), group_id) AS i FROM cand GROUP BY 1),
 walk AS (SELECT i, group_id, ex AS last, 1 AS kept FROM g WHERE i = 1 UNION ALL
   SELECT g.i, g.group_id, CASE WHEN g.en > walk.last THEN g.ex ELSE walk.last END, CASE WHEN g.en > walk.last THEN 1 ELSE 0 END FROM walk JOIN g ON g.i = walk.i + 1),
 tr AS (SELECT 'all' AS scope_all, c.* FROM cand c WHERE group_id IN (SELECT group_id FROM walk WHERE kept = 1)), {_econ_sql('scope_all', 'tr')}
SELECT (SELECT k FROM nn) AS ranking_groups, round((SELECT m FROM nn), 6) AS mean_ndcg, selected_trades, selected_decision_groups, sessions, round(avg_trade_return, 6) AS avg_trade_return,
 round(win_rate, 6) AS win_rate, round(profit_factor, 6) AS profit_factor, round(max_drawdown, 6) AS max_drawdown, round(negative_session_rate, 6) AS negative_session_rate FROM ec""", EX)
def evl_09(v):
    """Ranking economics: NDCG, downside cap, top k, non-overlapping groups, economics."""
    e = v.evidence
    nd = V.ndcg(e, ["group_id"], "score", "grade", 10).where("rows >= 2").agg(F.count(F.lit(1)).alias("ranking_groups"), F.avg("ndcg").alias("mean_ndcg"))
    cand = written(X.top_k(e.where("downside <= 0.9"), ["group_id"], [F.desc("score"), F.col("ticker")], 10))  # at most ten rows a group, read twice
    kept = V.non_overlapping_groups(cand, [], "group_id", "entry_time", "exit_time").select("group_id")
    tr = cand.join(kept, "group_id", "left_semi").withColumn("scope_all", F.lit("all"))
    ec = V.economics(tr, ["scope_all"], "session", "group_id", "ret")
    return ec.join(F.broadcast(nd)).select(  # one-row aggregate
        "ranking_groups", r("mean_ndcg"), "selected_trades", "selected_decision_groups", "sessions", r("avg_trade_return"), r("win_rate"),
        r("profit_factor"), r("max_drawdown"), r("negative_session_rate"))


@query("evl_10", f"""WITH sb AS (SELECT * FROM evidence_x QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, ticker) <= 10),
 so AS (SELECT * FROM evidence_x WHERE downside <= 0.95 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score + 0.1::DOUBLE * downside DESC, ticker) <= 10),
 p AS (SELECT session, avg(b.m) AS base, avg(o.m) AS overlay FROM (SELECT group_id, session, avg(ret) AS m FROM sb GROUP BY 1, 2) b JOIN (SELECT group_id, session, avg(ret) AS m FROM so GROUP BY 1, 2) o USING (group_id, session) GROUP BY 1),
 b0 AS (SELECT session, overlay - base AS t, 1.0::DOUBLE AS c FROM p), {boot_sql('b0', 1000, 7)}
SELECT round((SELECT avg(base) FROM p), 6) AS baseline_mean, round((SELECT avg(overlay) FROM p), 6) AS overlay_mean, round(point, 6) AS delta, round(low, 6) AS delta_low, round(high, 6) AS delta_high FROM pt, ci""", EX)
def evl_10(v):
    """Paired ablation: baseline against overlay selection with a paired interval."""
    e = v.evidence.withColumn("adj", F.col("score") + 0.1 * F.col("downside"))
    base = X.top_k(e, ["group_id"], [F.desc("score"), F.col("ticker")], 10).groupBy("group_id", "session").agg(F.avg("ret").alias("b"))
    over = X.top_k(e.where("downside <= 0.95"), ["group_id"], [F.desc("adj"), F.col("ticker")], 10).groupBy("group_id", "session").agg(F.avg("ret").alias("o"))
    p = base.join(over, ["group_id", "session"]).groupBy("session").agg(F.avg("b").alias("b"), F.avg("o").alias("o"))
    means = p.agg(r(F.avg("b"), "baseline_mean"), r(F.avg("o"), "overlay_mean"))
    ci = V.bootstrap(p.select("session", (F.col("o") - F.col("b")).alias("t"), F.lit(1.0).alias("c")), [], "session", "t", "c", 1000, 7)
    return means.join(F.broadcast(ci)).select("baseline_mean", "overlay_mean", r("point", "delta"), r("low", "delta_low"), r("high", "delta_high"))  # one-row aggregates


def outcome_report(v, outcomes):
    """Selected, population and best-k group means per outcome; outcomes are unpivoted, so one pass serves all."""
    keys = ["scope", "group_id", "outcome"]
    long = v.evidence.select("scope", "group_id", "ticker", *[F.col(o).cast("double").alias(o) for o in outcomes]).unpivot(
        ["scope", "group_id", "ticker"], list(outcomes), "outcome", "value")
    sel = selected(v).select("scope", "group_id", "ticker")
    pop = long.groupBy(*keys).agg(F.avg("value").alias("p"))
    chosen = long.join(sel, ["scope", "group_id", "ticker"], "left_semi").groupBy(*keys).agg(F.avg("value").alias("s"))
    best = X.top_k(long, keys, [F.desc("value"), F.col("ticker")], 10).groupBy(*keys).agg(F.avg("value").alias("o"))
    return pop.join(chosen, keys).join(best, keys)


_LONG = " UNION ALL ".join(f"""SELECT scope, '{o}' AS outcome, session, p, s, o FROM (SELECT scope, group_id, min(session) AS session, avg({o}) AS p FROM attributed GROUP BY ALL)
  JOIN (SELECT scope, group_id, avg({o}) AS s FROM sel GROUP BY ALL) USING (scope, group_id)
  JOIN (SELECT scope, group_id, avg({o}) AS o FROM (SELECT * FROM attributed QUALIFY row_number() OVER (PARTITION BY scope, group_id ORDER BY {o} DESC, ticker) <= 10) GROUP BY ALL) USING (scope, group_id)""" for o in OUTCOMES)


@query("evl_11", f"""WITH {ASEL}, pg AS ({_LONG}), b0 AS (SELECT scope, outcome, session, sum(s) AS t, sum(s - p) AS d, count(*) AS c FROM pg GROUP BY ALL),
 bl AS (SELECT *, row_number() OVER (PARTITION BY scope, outcome ORDER BY session) - 1 AS pos, count(*) OVER (PARTITION BY scope, outcome) AS n FROM b0),
 dr AS (SELECT scope, outcome, i, CAST('0x' || substr(md5('42:' || i || ':' || pos), 1, 8) AS BIGINT) % n AS pick FROM bl, range(1000) z(i)),
 sa AS (SELECT dr.scope, dr.outcome, i, sum(t) / sum(c) AS t, sum(d) / sum(c) AS d FROM dr JOIN bl ON bl.scope = dr.scope AND bl.outcome = dr.outcome AND bl.pos = dr.pick GROUP BY ALL),
 ci AS (SELECT scope, outcome, quantile_cont(t, 0.025) AS tl, quantile_cont(t, 0.975) AS th, quantile_cont(d, 0.025) AS dl, quantile_cont(d, 0.975) AS dh FROM sa GROUP BY ALL)
SELECT scope, outcome, groups, round(sm, 6) AS selected_mean, round(pm, 6) AS population_group_mean, round(sm - pm, 6) AS selection_delta, round(om, 6) AS oracle_top_k_mean, round(pos, 6) AS selected_positive_group_rate,
 round(tl, 6) AS selected_mean_low, round(th, 6) AS selected_mean_high, round(dl, 6) AS selection_delta_low, round(dh, 6) AS selection_delta_high
FROM (SELECT scope, outcome, count(*) AS groups, avg(s) AS sm, avg(p) AS pm, avg(o) AS om, avg(CAST(s > 1e-12::DOUBLE AS INT)) AS pos FROM pg GROUP BY ALL) JOIN ci USING (scope, outcome)""", ("attributed",))
def evl_11(v):
    """Failure attribution: selection against population and best k with intervals, per scope and eight outcomes."""
    out = D.attribution(written(v.attributed), OUTCOMES)
    return out.select("scope", "outcome", "groups", *[r(c) for c in out.columns if c not in ("scope", "outcome", "groups")])


@query("evl_12", """SELECT ticker, group_id, scope, epoch_us(decision_time) AS decision_time, epoch_us(entry_time) AS entry_time, epoch_us(exit_time) AS exit_time, round(score, 6) AS probability,
 CAST(score >= 0.5 AS BIGINT) AS prediction, target FROM evidence_x""", EX)
def evl_12(v):
    """Prediction evidence projection with the 0.5 label."""
    return v.evidence.select("ticker", "group_id", "scope", us("decision_time"), us("entry_time"), us("exit_time"), r("score", "probability"),
                             n(F.col("score") >= 0.5, "prediction"), "target")


@query("evl_13", f"WITH {PHASE}, x AS (SELECT 0 AS phase, * FROM tr), {_econ_sql('phase', 'x')} SELECT CAST(phase AS BIGINT) AS phase, selected_trades, selected_decision_groups, sessions, {_EC_OUT} FROM ec", EX)
def evl_13(v):
    """Economics of one decision phase under the downside cap and session cap."""
    return econ_out(V.economics(phase_trades(v).withColumn("phase", F.lit(0).cast("long")), ["phase"], "session", "group_id", "ret"), "phase")


@query("lbl_14", """WITH RECURSIVE g AS (SELECT scope, group_id, min(entry_time) AS en, max(exit_time) AS ex, row_number() OVER (PARTITION BY scope ORDER BY min(entry_time), group_id) AS i FROM evidence_x GROUP BY 1, 2),
 walk AS (SELECT scope, i, group_id, ex AS last, 1 AS kept FROM g WHERE i = 1 UNION ALL
   SELECT g.scope, g.i, g.group_id, CASE WHEN g.en > walk.last THEN g.ex ELSE walk.last END, CASE WHEN g.en > walk.last THEN 1 ELSE 0 END FROM walk JOIN g ON g.i = walk.i + 1 AND g.scope = walk.scope)
SELECT scope, group_id FROM walk WHERE kept = 1""", EX)
def lbl_14(v):
    """Global non-overlap of decision groups: keep when entry > last exit."""
    return V.non_overlapping_groups(v.evidence, ["scope"], "group_id", "entry_time", "exit_time").select("scope", "group_id")
