"""Queries on confluence, costs, replays, audits and investments."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.functions import scalars
from barweave.operators import audit, confluence, costs, evaluate, invest, replay, stances
from barweave.operators.folds import with_folds
from barweave.plans import sqltext as q
from barweave.plans.catalogue import query
from barweave.plans.evaluate_q import HEAD, NUMBERED, VERDICT, full_sweep, rounded, sweep_sql
from barweave.plans.indicators_q import DAYS, FOLDED
from barweave.sources.tables import daily_bars, intraday_bars, read

HOURS, FIVES = q.intraday(60, "hours"), q.intraday(5, "fives")
DAILY_TREND = f"tr AS (SELECT symbol, ts, lag({q.EMA_CROSS}) OVER ({q.W}) AS trend FROM base)"


def ntz(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("jn1_as_of", q.with_(HOURS, FIVES) + "SELECT f.symbol, f.ts, h.close AS hour_close FROM fives f ASOF LEFT JOIN hours h ON f.symbol = h.symbol AND f.ts >= h.ts")
def as_of(spark, d):
    hours = intraday_bars(spark, d, 60).withColumnRenamed("close", "hour_close")
    return ntz(confluence.as_of(intraday_bars(spark, d, 5).select("symbol", "ts"), hours, "hour_close", default=None))


def hour_frame(spark, d):
    return with_folds(ntz(intraday_bars(spark, d, 60)))


HOUR_BASE = q.with_(q.intraday(60), q.FOLDS, q.BASE)[:-1] + ",\n"


@query("jn2_lagged_as_of", HOUR_BASE + FIVES + f", {DAILY_TREND} SELECT f.symbol, f.ts, coalesce(t.trend, 0) AS trend FROM fives f ASOF LEFT JOIN tr t ON f.symbol = t.symbol AND f.ts >= t.ts")
def lagged_as_of(spark, d):
    trend = confluence.completed_trend(hour_frame(spark, d))
    return confluence.as_of(ntz(intraday_bars(spark, d, 5)).select("symbol", "ts"), trend, "trend")


VW = "PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts"
VOTES = {
    "ema_cross": q.EMA_CROSS, "supertrend": "supertrend_dir", "vwap": q.sgn(f"close - sum((high + low + close) / 3 * volume) OVER ({VW}) / nullif(sum(volume) OVER ({VW}), 0)"),
    "rsi": q.pick("rsi > 50 AND rsi < 70", "rsi > 30 AND rsi < 50"),
    "engulfing": q.pick(f"{q.lag('close')} < {q.lag('open')} AND close > open AND open <= {q.lag('close')} AND close >= {q.lag('open')}", f"{q.lag('close')} > {q.lag('open')} AND close < open AND open >= {q.lag('close')} AND close <= {q.lag('open')}"),
    "hammer": q.pick("abs(close - open) > 0 AND least(open, close) - low >= 2 * abs(close - open) AND high - greatest(open, close) <= abs(close - open)", "false"),
}
VOTED = HOUR_BASE + "vt AS (SELECT symbol, ts, high, low, close, atr, " + ", ".join(f"{s} AS vote_{n}" for n, s in VOTES.items()) + " FROM base),\nsc AS (SELECT *, (" + " + ".join(f"vote_{n}" for n in VOTES) + ") / 6.0::DOUBLE AS score FROM vt),\nsg AS (SELECT *, CAST(sign(score) AS INT) AS direction, abs(score) AS confidence FROM sc)\n"


def voted(spark, d):
    return confluence.with_votes(hour_frame(spark, d))


@query("cf1_votes", VOTED + "SELECT symbol, ts, " + ", ".join(f"vote_{n}" for n in VOTES) + " FROM sg")
def votes(spark, d):
    return voted(spark, d).select("symbol", "ts", *(f"vote_{n}" for n in confluence.VOTES))


@query("cf2_score", VOTED + "SELECT symbol, ts, round(score, 4) AS score FROM sg")
def score(spark, d):
    return rounded(confluence.with_score(voted(spark, d)).select("symbol", "ts", "score"))


@query("cf3_signal", VOTED + "SELECT symbol, ts, direction, round(confidence, 4) AS confidence, confidence >= 0.6 AS entered FROM sg")
def signal(spark, d):
    return rounded(confluence.with_score(voted(spark, d)).select("symbol", "ts", "direction", "confidence", "entered"))


def gated(name, condition, **options):
    direction = "-direction" if options.get("invert") else "direction"

    @query(name, VOTED + f"SELECT symbol, ts, {direction} AS direction, confidence >= 0.3 AND {condition} AS entered FROM sg")
    def run(spark, d):
        scored = confluence.with_score(voted(spark, d), threshold=0.3)
        return confluence.gate(scored, **options).select("symbol", "ts", "direction", "entered")


gated("pf6_volatility_gate", "coalesce(atr / nullif(close, 0), 0) * 100 >= 20", min_atr_pct=20.0)
gated("pf7_window_gate", "strftime(ts, '%H:%M:%S') BETWEEN '09:45:00' AND '15:00:00'", window=(confluence.OPEN, confluence.CLOSE))
gated("pf8_unanimous_gate", "confidence >= 0.999", unanimous=True)
gated("pf9_invert", "true", invert=True)


@query("cf4_confluence", VOTED.rstrip() + f""", d AS (SELECT symbol, ts, {q.EMA_CROSS} AS t FROM base), dl AS (SELECT symbol, ts, lag(t) OVER ({q.W}) AS trend FROM d)
SELECT s.symbol, s.ts, round(s.score, 4) AS score, s.direction, s.confidence >= 0.3 AND s.direction = coalesce(t.trend, 0) AND s.direction <> 0 AND coalesce(atr / nullif(close, 0), 0) * 100 >= 0.15 AS entered FROM sg s ASOF LEFT JOIN dl t ON s.symbol = t.symbol AND s.ts >= t.ts""")
def full_confluence(spark, d):
    frame = hour_frame(spark, d)
    scored = confluence.with_score(confluence.with_votes(frame), threshold=0.3)
    scored = confluence.as_of(scored, confluence.completed_trend(frame), "trend")
    return rounded(confluence.gate(scored, trend="trend", min_atr_pct=confluence.MIN_ATR_PCT).select("symbol", "ts", "score", "direction", "entered"))


@query("cf5_latest_signal", VOTED + "SELECT symbol, max(ts) AS ts, round(arg_max(score, ts), 4) AS score, arg_max(direction, ts) AS direction, arg_max(vote_rsi, ts) AS rsi_vote FROM sg GROUP BY symbol")
def latest_signal(spark, d):
    last = confluence.latest(confluence.with_score(voted(spark, d)))
    return last.select("symbol", "ts", F.round("score", 4).alias("score"), "direction", F.col("votes")["rsi"].alias("rsi_vote"))


OUT = """, nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM sg), bt AS (SELECT symbol, i, close, u.n AS signal, u.s AS side FROM (SELECT symbol, i, close, unnest([{pairs}]) AS u FROM nb) WHERE u.s <> 0),
ev AS (SELECT b.symbol, b.signal, b.i, j.i AS j, CASE WHEN side > 0 AND j.low <= b.close * (1 - 0.75 / 100) OR side < 0 AND j.high >= b.close * (1 + 0.75 / 100) THEN -1 WHEN side > 0 AND j.high >= b.close * (1 + 1.5 / 100) OR side < 0 AND j.low <= b.close * (1 - 1.5 / 100) THEN 1 ELSE 0 END AS o FROM bt b JOIN nb j ON j.symbol = b.symbol AND j.i BETWEEN b.i + 1 AND b.i + 12),
f AS (SELECT symbol, signal, i, arg_min(o, j) AS o FROM ev WHERE o <> 0 GROUP BY ALL)
SELECT s.signal, count(*) FILTER (o = 1) AS wins, count(*) FILTER (o = -1) AS losses, round(count(*) FILTER (o = 1) / nullif(count(*) FILTER (o <> 0), 0), 4) AS win_rate FROM (SELECT DISTINCT signal FROM bt) s LEFT JOIN f USING (signal) GROUP BY s.signal"""


@query("cf7_calibration", VOTED + OUT.format(pairs=", ".join(f"struct_pack(n := 'vote_{n}', s := vote_{n})" for n in VOTES)))
def calibration(spark, d):
    return rounded(confluence.calibrate(voted(spark, d)))


@query("jn8_forward_outcomes", VOTED + OUT.format(pairs="struct_pack(n := 'direction', s := direction)"))
def forward_outcomes(spark, d):
    return rounded(confluence.outcomes(confluence.with_score(voted(spark, d)), ["direction"]))


# ---------------------------------------------------------------- costs

LEGS = "FROM (SELECT symbol, ts, open, close, atr, CASE WHEN close > open THEN 1 ELSE -1 END AS side FROM base)"
CHARGE = "SELECT symbol, ts, round(fee * 1.18 + sell * 0.00025 + buy * 0.00003, 4) AS charges FROM (SELECT symbol, ts, buy, sell, least(20, buy * 0.0003) + least(20, sell * 0.0003) + (buy + sell) * (0.0000297 + 10 / 1e7) AS fee FROM (SELECT symbol, ts, 10 * CASE WHEN side > 0 THEN open ELSE close END AS buy, 10 * CASE WHEN side > 0 THEN close ELSE open END AS sell " + LEGS + "))"


def legs(spark, d):
    return with_folds(daily_bars(spark, d)).withColumn("side", F.when(F.col("close") > F.col("open"), 1).otherwise(-1))


@query("sim3_charges", FOLDED + CHARGE)
def charge(spark, d):
    return legs(spark, d).select("symbol", "ts", F.round(costs.charges(F.col("open"), F.col("close"), F.lit(10), F.col("side")), 4).alias("charges"))


ROUND_TRIP = "(2 * 0.0003 + 0.00025 + 2 * 0.0000297 + 0.00003 + 2 * 0.0005 + 0.18 * (2 * 0.0003 + 2 * 0.0000297))"


@query("sim4_round_trip_cost", DAYS + f"SELECT symbol, ts, round(close * {ROUND_TRIP}, 6) AS cost, close / open - 1 > {ROUND_TRIP} AS paid FROM bars")
def round_trip(spark, d):
    """What a round trip at each close costs a share, and whether the bar's own move would have paid for one."""
    share = F.lit(costs.round_trip_pct())
    return daily_bars(spark, d).select("symbol", "ts", F.round(F.col("close") * share, 6).alias("cost"), (F.col("close") / F.col("open") - 1 > share).alias("paid"))


@query("sim5_position_size", FOLDED + "SELECT symbol, ts, CAST(CASE WHEN 1.5 * atr > 0 THEN floor(500 / abs(close - (close - side * 1.5 * atr))) ELSE 0 END AS INT) AS qty " + LEGS)
def sizes(spark, d):
    stop, _ = costs.stop_and_target(F.col("close"), F.col("atr"), F.col("side"))
    return legs(spark, d).select("symbol", "ts", costs.position_size(F.col("close"), stop).alias("qty"))


@query("sim6_stop_target", FOLDED + "SELECT symbol, ts, round(close - side * 1.5 * atr, 4) AS stop, round(close + side * greatest(close * 0.015, 1.5 * atr * 1.5), 4) AS target " + LEGS)
def stops(spark, d):
    stop, target = costs.stop_and_target(F.col("close"), F.col("atr"), F.col("side"))
    return rounded(legs(spark, d).select("symbol", "ts", stop.alias("stop"), target.alias("target")))


@query("sim13_order_params", FOLDED + "SELECT symbol AS tradingsymbol, CASE WHEN side > 0 THEN 'BUY' ELSE 'SELL' END AS transaction_type, CAST(10 AS INT) AS quantity, 'MIS' AS product, 'MARKET' AS order_type " + LEGS)
def orders(spark, d):
    return legs(spark, d).select(costs.order_params(F.col("symbol"), F.col("side"), F.lit(10)).alias("o")).select("o.*")


@query("sim14_folds", q.with_(q.DAILY, NUMBERED) + """, f AS (SELECT symbol, i, c, unnest(range(1, 5)) AS fold FROM n), b AS (SELECT *, round_even(c * fold / 5.0, 0) AS s, round_even(c * (fold + 1) / 5.0, 0) AS e FROM f)
SELECT symbol, CAST(fold AS INT) AS fold, count(*) FILTER (i - 1 < s) AS train, count(*) FILTER (i - 1 >= s) AS test FROM b WHERE i - 1 < e AND s >= 50 AND e - s >= 20 GROUP BY ALL""")
def folds(spark, d):
    rows = replay.walk_forward_folds(daily_bars(spark, d))
    return rows.groupBy("symbol", "fold").agg(*(F.sum((F.col("part") == p).cast("long")).alias(p) for p in ("train", "test")))


# ---------------------------------------------------------------- replays


def traded(bars, stance=None):
    frame = stances.prepare(with_folds(bars))
    side = stances.boll_reversion() if stance is None else stance
    return frame.withColumn("direction", side.cast("int")).withColumn("entered", F.col("direction") != 0)


@query("sim1_replay")
def replayed(spark, d):
    return replay.replay(traded(daily_bars(spark, d)))


@query("sim1_replay_metrics")
def replay_metrics(spark, d):
    return evaluate.trade_metrics(replayed(spark, d), 100_000.0, ("symbol",), ("exit_time", "entry_time"))


@query("ag11_trade_pct")
def trade_pct(spark, d):
    pct = F.col("pnl") / (F.col("entry_price") * F.col("qty")) * 100
    return replayed(spark, d).withColumn("pct", pct).groupBy("symbol").agg(F.avg("pct").alias("mean_pct"), F.percentile("pct", F.lit(0.5)).alias("median_pct"))


@query("sim2_exit_reasons")
def exit_reasons(spark, d):
    return replay.replay(traded(ntz(intraday_bars(spark, d, 5))), square_off=True).groupBy("reason").agg(F.count("*").alias("n"))


@query("sim11_paper_session")
def paper(spark, d):
    return replay.paper_session(traded(daily_bars(spark, d)))


@query("sim15_walk_forward")
def walk(spark, d):
    return replay.walk_forward(daily_bars(spark, d), traded)


@query("ag31_strategy_comparison")
def comparison(spark, d):
    """Metrics of four kinds of strategy, replayed over the same bars."""
    frame = stances.prepare(with_folds(daily_bars(spark, d)))
    kinds = {"trend": stances.ema_cross(9, 21), "mean_reversion": stances.mean_reversion(), "pullback": stances.pullback_in_trend(), "breakout": stances.donchian(20)}
    every = None
    for name, stance in kinds.items():
        own = frame.withColumn("direction", stance.cast("int")).withColumn("entered", F.col("direction") != 0)
        trades = replay.replay(own).withColumn("strategy", F.lit(name))
        every = trades if every is None else every.unionByName(trades)
    return evaluate.trade_metrics(every, 100_000.0, ("strategy",), ("exit_time", "symbol", "entry_time"))


# ---------------------------------------------------------------- audit

#: None of these reads a recursive indicator.
SMALL = stances.configs(["momentum", "boll_reversion", "donchian", "drift_rider", "tri_ma"])
RET = HEAD + q.stance_rows(SMALL) + f""",
f0 AS (SELECT symbol, ts, lead(close) OVER ({q.W}) / close - 1 AS f FROM base), f1 AS (SELECT symbol, ts, f - avg(f) OVER (PARTITION BY ts) AS f FROM f0),
m0 AS (SELECT ts, config, avg(stance * f) AS ret FROM st JOIN f1 USING (symbol, ts) WHERE f IS NOT NULL GROUP BY ts, config),
m AS (SELECT * FROM m0 WHERE config IN (SELECT config FROM m0 GROUP BY config HAVING stddev_samp(ret) > 1e-12))
"""


def matrix(spark, d):
    frame = stances.stances(daily_bars(spark, d), SMALL)
    return audit.strategy_returns(frame, [n for n, _, _ in SMALL])


@query("ag23_returns_matrix", RET + "SELECT ts, config, round(ret, 4) AS ret FROM m")
def returns_matrix(spark, d):
    return rounded(matrix(spark, d))


STATS = """, z AS (SELECT config, count(*) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd, stddev_pop(ret) AS sp FROM m GROUP BY config),
mo AS (SELECT m.config, z.n, mu / sd AS sharpe, avg(pow((ret - mu) / sp, 3)) AS skew, avg(pow((ret - mu) / sp, 4)) AS kurtosis FROM m JOIN z USING (config) GROUP BY m.config, z.n, mu, sd)
"""


@query("ag24_series_sharpe", RET + STATS + "SELECT config, n, round(sharpe, 4) AS sharpe FROM mo")
def series_sharpe(spark, d):
    return rounded(audit.series_stats(matrix(spark, d)).select("config", "n", "sharpe"))


@query("ag25_skew_kurtosis", RET + STATS + "SELECT config, round(skew, 3) AS skew, round(kurtosis, 3) AS kurtosis FROM mo")
def moments(spark, d):
    return audit.series_stats(matrix(spark, d)).select("config", F.round("skew", 3).alias("skew"), F.round("kurtosis", 3).alias("kurtosis"))


@query("fn5_overfitting", RET + """, tt AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS t FROM (SELECT DISTINCT ts FROM m)),
bl AS (SELECT ts, len(list_filter(range(0, 14), lambda b: floor(t * b / 14) <= i)) - 1 AS block FROM tt),
cm AS (SELECT config, avg(ret) AS mu FROM m GROUP BY config),
ru AS (SELECT m.config, block, mu, count(*) AS n, sum(ret - mu) AS s, sum((ret - mu) * (ret - mu)) AS q FROM m JOIN bl USING (ts) JOIN cm USING (config) GROUP BY ALL),
mk AS (SELECT range AS mask FROM range(16384) WHERE bit_count(range::INT) = 7),
ce AS (SELECT mask, config, mu, sum(CASE WHEN (mask >> block) & 1 = 1 THEN n ELSE 0 END) AS ni, sum(CASE WHEN (mask >> block) & 1 = 1 THEN s ELSE 0 END) AS si, sum(CASE WHEN (mask >> block) & 1 = 1 THEN q ELSE 0 END) AS qi, sum(CASE WHEN (mask >> block) & 1 = 0 THEN n ELSE 0 END) AS no, sum(CASE WHEN (mask >> block) & 1 = 0 THEN s ELSE 0 END) AS so, sum(CASE WHEN (mask >> block) & 1 = 0 THEN q ELSE 0 END) AS qo FROM ru, mk GROUP BY mask, config, mu),
ra AS (SELECT mask, config, (mu + si / ni) / sqrt((qi - si * si / ni) / (ni - 1)) AS x, (mu + so / no) / sqrt((qo - so * so / no) / (no - 1)) AS y FROM ce),
be AS (SELECT mask, max(x) AS x, arg_max(y, x) AS y, count(*) AS nc FROM ra GROUP BY mask),
rk AS (SELECT be.mask, be.x, be.y, nc, count(*) FILTER (ra.y <= be.y) AS r FROM ra JOIN be ON ra.mask = be.mask GROUP BY ALL),
lg AS (SELECT *, ln(least(greatest(r, 1), nc) / (nc + 1) / (1 - least(greatest(r, 1), nc) / (nc + 1))) AS l FROM rk)
SELECT round(avg(CAST(l <= 0 AS INT)), 4) AS pbo, round(median(l), 4) AS median_logit, round(avg(CAST(y < 0 AS INT)), 4) AS prob_oos_loss, round(regr_slope(y, x), 4) AS degradation_slope, count(*) AS n_splits, max(nc) AS n_configs FROM lg""")
def overfit(spark, d):
    return rounded(audit.overfitting(matrix(spark, d)))


GRID_P = "(SELECT o_orderkey AS id, (o_orderkey % 997 + 1) / 999.0::DOUBLE AS p FROM orders)"
A, B, C_, D_ = ((f"{x:.18g}" for x in v) for v in (scalars.PPF_A, scalars.PPF_B, scalars.PPF_C, scalars.PPF_D))
A, B, C_, D_ = list(A), list(B), list(C_), list(D_)


def poly(c, x):
    out = c[0]
    for k in c[1:]:
        out = f"({out} * {x} + {k})"
    return out


def ppf_sql(p):
    lo, hi, m = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"(({p} - 0.5) * ({p} - 0.5))"
    tail = lambda x: f"{poly(C_, x)} / {poly([*D_, '1.0'], x)}"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(lo)} WHEN {p} > 0.97575 THEN -({tail(hi)}) ELSE {poly(A, m)} * ({p} - 0.5) / {poly([*B, '1.0'], m)} END"


@query("fn2_norm_ppf", f"SELECT id, round({ppf_sql('p')}, 6) AS z FROM {GRID_P}")
def norm_ppf(spark, d):
    """The quantile at a share that each order's key stands for."""
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(audit.norm_ppf((F.col("o_orderkey") % 997 + 1) / 999.0), 6).alias("z"))


TRIALS = "(SELECT o_custkey AS id, count(*) + 1 AS t, var_samp(o_totalprice / 100000) AS v FROM orders GROUP BY o_custkey HAVING count(*) > 1)"


@query("fn3_expected_max_sharpe", f"SELECT id, t AS trials, round(sqrt(v) * ((1 - 0.5772156649015329) * ({ppf_sql('(1 - 1.0::DOUBLE / t)')}) + 0.5772156649015329 * ({ppf_sql('(1 - 1.0::DOUBLE / (t * exp(1)))')})), 5) AS luck FROM {TRIALS}")
def luck(spark, d):
    """The largest ratio that luck shows in as many trials as a customer has orders, with their variance."""
    n, v = F.count("*"), F.var_samp(F.col("o_totalprice") / 100000)
    rows = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg((n + 1).alias("trials"), v.alias("v")).where("trials > 2")
    return rows.select("id", "trials", F.round(audit.expected_max_sharpe_column(F.col("v"), F.col("trials")), 5).alias("luck"))


def cdf_sql(x):
    """The distribution by the alternating series of the error function, good for |x| < 5; 0 or 1 beyond."""
    z = f"(({x}) / sqrt(2))"
    return f"CASE WHEN abs({x}) >= 5 THEN CAST({x} > 0 AS INT)::DOUBLE ELSE 0.5 + 1 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * pow({z}, 2 * k + 1) / (gamma(k + 1.0) * (2 * k + 1)))) END"


@query("fn1_norm_cdf", f"SELECT id, round({cdf_sql('x')}, 6) AS p FROM (SELECT o_orderkey AS id, (o_totalprice - 250000) / 100000 AS x FROM orders)")
def norm_cdf(spark, d):
    """The share of a normal distribution below each order's price."""
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(scalars.norm_cdf((F.col("o_totalprice") - 250000) / 100000), 6).alias("p"))


LUCK_SQL = f"((1 - 0.5772156649015329) * ({ppf_sql('(1 - 1.0::DOUBLE / t)')}) + 0.5772156649015329 * ({ppf_sql('(1 - 1.0::DOUBLE / (t * exp(1)))')}))"
DEFLATED = f""", bs AS (SELECT arg_max(row(config, sharpe, n, skew, kurtosis), sharpe) AS b, var_samp(sharpe) AS v, 427 AS t FROM mo),
b2 AS (SELECT b[1] AS config, b[2] AS sharpe, b[3] AS n, sqrt(v) * {LUCK_SQL} AS luck, 1 - b[4] * b[2] + (b[5] - 1) / 4 * b[2] * b[2] AS spread FROM bs),
de AS (SELECT config, sharpe, luck, (sharpe - luck) * sqrt(n - 1) / sqrt(spread) AS z FROM b2),
df AS (SELECT config, sharpe, luck, {cdf_sql('z')} AS dsr FROM de)
"""


@query("fn4_deflated_sharpe", RET + STATS + DEFLATED + "SELECT config, round(sharpe, 4) AS sharpe, round(luck, 4) AS luck, round(dsr, 4) AS dsr, dsr > 0.95 AS significant FROM df")
def deflated(spark, d):
    return rounded(audit.deflated_sharpe(audit.series_stats(matrix(spark, d)), 427).select("config", "sharpe", "luck", "dsr", "significant"))


FAMILY = f""", fb AS (SELECT arg_max(row(config, horizon, oos_signals, oos_cond_edge_pp), oos_cond_edge_pp) AS b, count(*) AS t FROM v WHERE oos_signals > 0),
f2 AS (SELECT b[1] AS config, b[4] AS edge, 100 * sqrt(0.25 / b[3]) AS se, t, {LUCK_SQL} AS luck FROM fb WHERE t > 0),
f3 AS (SELECT *, edge / se AS z FROM f2),
f4 AS (SELECT config, edge, se * luck AS luck_edge_pp, 1 - ({cdf_sql('z')}) AS p_single, t FROM f3),
fw AS (SELECT config, p_single, 1 - pow(1 - p_single, t) AS p_fwe, luck_edge_pp, 1 - pow(1 - p_single, t) < 0.05 AND edge > luck_edge_pp AS survives FROM f4)
"""


@query("fn6_family_wise", sweep_sql(stances.configs()) + VERDICT + FAMILY + "SELECT config, round(p_single, 4) AS p_single, round(p_fwe, 4) AS p_fwe, round(luck_edge_pp, 4) AS luck_edge_pp, survives FROM fw")
def family_wise(spark, d):
    return rounded(audit.family_wise(full_sweep(spark, d)).select("config", "p_single", "p_fwe", "luck_edge_pp", "survives"))


@query("fn7_readings", """WITH g AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 10 THEN NULL ELSE (o_orderkey % 11 + 0.2) / 10.0::DOUBLE END AS pbo, (o_custkey % 20 + 0.3) / 20.0::DOUBLE AS dsr, o_orderstatus = 'O' AS fine FROM orders)
SELECT id, pbo IS NOT NULL AND pbo < 0.5 AND dsr > 0.95 AND fine AS robust,
  concat_ws(' | ', CASE WHEN pbo IS NOT NULL THEN 'PBO ' || printf('%.0f', pbo * 100) || '% (' || CASE WHEN pbo >= 0.5 THEN 'overfit' ELSE 'robust' END || ')' END, 'DSR ' || printf('%.0f', dsr * 100) || '% (' || CASE WHEN dsr > 0.95 THEN 'sig' ELSE 'not sig' END || ')', 'FWE p ' || CASE WHEN fine THEN '0.01 (survives)' ELSE '0.99 (noise)' END) AS summary FROM g""")
def readings(spark, d):
    """What is read from three figures that each order stands for."""
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 < 10, (F.col("o_orderkey") % 11 + 0.2) / 10.0).alias("pbo"), ((F.col("o_custkey") % 20 + 0.3) / 20.0).alias("dsr"), (F.col("o_orderstatus") == "O").alias("fine"))
    found = audit.reading(rows.withColumns({"significant": F.col("dsr") > audit.SIGNIFICANT, "p_fwe": F.when(F.col("fine"), 0.01).otherwise(0.99), "survives": F.col("fine")}))
    return found.select("id", "robust", "summary")


@query("fn8_audit")
def full_audit(spark, d):
    """The verdict on the returns of ``SMALL`` and the whole sweep; its parts have their SQL under fn4, fn5, fn6 and fn7."""
    returns = matrix(spark, d)
    return audit.verdict(audit.overfitting(returns), audit.deflated_sharpe(audit.series_stats(returns), 427), audit.family_wise(full_sweep(spark, d)))


@query("fn21_search_verdict", sweep_sql(SMALL) + "SELECT config, horizon, cond_edge_pp / (100 * sqrt(0.25 / greatest(signals, 1))) > sqrt(2 * ln(427)) + 1 AS beats_luck FROM stat WHERE slice = 'oos'")
def search_verdict(spark, d):
    frame = stances.stances(daily_bars(spark, d), SMALL)
    counts, base = evaluate.sweep_counts(evaluate.split(frame), [n for n, _, _ in SMALL])
    rows = evaluate.slice_stats(counts, base).where("slice = 'oos'")
    return rows.select("config", "horizon", audit.search_verdict(F.col("cond_edge_pp"), F.col("signals"), F.lit(427.0)).alias("beats_luck"))


@query("fn22_significance", sweep_sql(SMALL) + "SELECT config, horizon, slice, CASE WHEN abs(cond_edge_pp) > 2 * sqrt(0.25 / signals) * 100 THEN 'significant' ELSE 'noise' END AS reading FROM stat")
def significance(spark, d):
    frame = stances.stances(daily_bars(spark, d), SMALL)
    counts, base = evaluate.sweep_counts(evaluate.split(frame), [n for n, _, _ in SMALL])
    bar = 2 * F.sqrt(0.25 / F.col("signals")) * 100
    return evaluate.slice_stats(counts, base).select("config", "horizon", "slice", F.when(F.abs("cond_edge_pp") > bar, "significant").otherwise("noise").alias("reading"))


# ---------------------------------------------------------------- investments

MONTHS = "fm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts) AS r FROM bars) WHERE r = 1)"


@query("rk13_first_of_month", q.with_(q.DAILY, MONTHS) + "SELECT symbol, ts, close FROM fm")
def first_of_month(spark, d):
    return invest.first_of_month(daily_bars(spark, d)).select("symbol", "ts", "close")


PLAN = ", u AS (SELECT symbol, sum(10000 / close) AS units, count(*) AS months FROM fm WHERE close > 0 GROUP BY symbol), l AS (SELECT symbol, arg_max(close, ts) AS last, CAST(max(ts) AS DATE) AS day FROM bars GROUP BY symbol)\n"


@query("fn10_monthly_plan", q.with_(q.DAILY, MONTHS)[:-1] + PLAN + "SELECT symbol, months * 10000.0::DOUBLE AS invested, round(units * last, 2) AS final_value, round((units * last / (months * 10000.0) - 1) * 100, 4) AS abs_return_pct, months FROM u JOIN l USING (symbol)")
def monthly_plan(spark, d):
    return invest.monthly_plan(daily_bars(spark, d)).select("symbol", "invested", F.round("final_value", 2).alias("final_value"), F.round("abs_return_pct", 4).alias("abs_return_pct"), "months")


BISECT = """, fl AS (SELECT symbol, CAST(ts AS DATE) AS d, -10000.0::DOUBLE AS amt FROM fm WHERE close > 0 UNION ALL SELECT symbol, day, units * last FROM u JOIN l USING (symbol)),
t0 AS (SELECT symbol, min(d) AS d0 FROM fl GROUP BY symbol), f2 AS MATERIALIZED (SELECT fl.symbol, amt, date_diff('day', d0, d) / 365.0::DOUBLE AS y FROM fl JOIN t0 USING (symbol)),
it AS (SELECT symbol, 0 AS k, -0.9999::DOUBLE AS lo, 10.0::DOUBLE AS hi, sum(amt / pow(1 - 0.9999::DOUBLE, y)) AS at_lo FROM f2 GROUP BY symbol
 UNION ALL SELECT symbol, k + 1, CASE WHEN at_lo * v < 0 THEN lo ELSE mid END, CASE WHEN at_lo * v < 0 THEN mid ELSE hi END, CASE WHEN at_lo * v < 0 THEN at_lo ELSE v END
 FROM (SELECT i.symbol, i.k, i.lo, i.hi, i.at_lo, (i.lo + i.hi) / 2 AS mid, sum(f2.amt / pow(1 + (i.lo + i.hi) / 2, f2.y)) AS v FROM it i JOIN f2 ON f2.symbol = i.symbol WHERE i.k < 60 GROUP BY ALL))
SELECT symbol, round((lo + hi) / 2 * 100, 4) AS xirr_pct FROM it WHERE k = 60"""


@query("fn09_xirr", q.with_(q.DAILY, MONTHS)[:-1] + PLAN.rstrip() + BISECT)
def xirr(spark, d):
    return invest.monthly_plan(daily_bars(spark, d)).select("symbol", F.round("xirr_pct", 4).alias("xirr_pct"))


@query("fn12_portfolio_plan", q.with_(q.DAILY, MONTHS)[:-1] + PLAN + "SELECT sum(months) * 10000.0::DOUBLE AS invested, round(sum(units * last), 2) AS final_value FROM u JOIN l USING (symbol)")
def portfolio(spark, d):
    return invest.portfolio_plan(daily_bars(spark, d)).select("invested", F.round("final_value", 2).alias("final_value"))


@query("fn11_lump_sum", q.with_(q.DAILY) + "SELECT symbol, round((g - 1) * 100, 4) AS total_return_pct, round((pow(g, 1 / y) - 1) * 100, 4) AS cagr_pct, round(y, 1) AS years FROM (SELECT symbol, arg_max(close, ts) / arg_min(close, ts) AS g, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) / 365.0::DOUBLE AS y FROM bars GROUP BY symbol)")
def lump_sum(spark, d):
    return rounded(invest.lump_sum(daily_bars(spark, d)), keep=("years",))


SNAP = HEAD + f"""bk AS (SELECT *, row_number() OVER ({q.W} DESC) - 1 AS b, count(*) OVER (PARTITION BY symbol) AS n FROM base),
sn AS (SELECT symbol, count(*) AS history, arg_max(close, ts) AS p, max(close) FILTER (b = 21) AS p1, max(close) FILTER (b = 126) AS p6, max(close) FILTER (b = 252) AS p12, max(close) FILTER (b < 252) AS hi, min(close) FILTER (b < 252) AS lo, avg(close) FILTER (b < 200) AS us, arg_max(rsi, ts) AS rsi, stddev_samp(r) FILTER (b < 252) * sqrt(252) * 100 AS vol FROM bk GROUP BY symbol),
sp AS (SELECT symbol, history, p AS price, (p / p1 - 1) * 100 AS ret_1m, (p / p6 - 1) * 100 AS ret_6m, (p / p12 - 1) * 100 AS ret_1y, (p / hi - 1) * 100 AS from_high_pct, (p / lo - 1) * 100 AS from_low_pct, p > us AS trend_up, rsi, vol AS vol_pct FROM sn),
se AS (SELECT *, CASE WHEN history < 60 THEN 'insufficient history' WHEN trend_up AND round_even(from_high_pct, 1) >= -3 THEN 'near-high uptrend' WHEN trend_up AND round_even(from_high_pct, 1) <= -12 THEN 'uptrend pullback' WHEN trend_up THEN 'uptrend' WHEN round_even(rsi, 0) < 35 THEN 'oversold downtrend' ELSE 'downtrend' END AS setup FROM sp)
"""


def snapshot_frame(spark, d):
    return invest.snapshot(with_folds(daily_bars(spark, d)))


@query("fn13_snapshot", SNAP + "SELECT symbol, history, round(price, 4) AS price, round(ret_1m, 4) AS ret_1m, round(ret_6m, 4) AS ret_6m, round(ret_1y, 4) AS ret_1y, round(from_high_pct, 4) AS from_high_pct, round(from_low_pct, 4) AS from_low_pct, trend_up, round(rsi, 4) AS rsi, round(vol_pct, 4) AS vol_pct, setup FROM se")
def snapshot(spark, d):
    return rounded(snapshot_frame(spark, d))


@query("fn14_setup", SNAP + "SELECT symbol, setup FROM se")
def setup(spark, d):
    return snapshot_frame(spark, d).select("symbol", "setup")


CATEGORY = {"ECONOMY": "small", "PROMO": "small", "STANDARD": "mid", "MEDIUM": "mid", "SMALL": "small", "LARGE": "large"}


@query("ag30_screen_categories", SNAP + "SELECT CASE WHEN symbol = 'LARGE' THEN 'large' WHEN symbol IN ('STANDARD', 'MEDIUM') THEN 'mid' ELSE 'small' END AS category, count(*) AS symbols, count(*) FILTER (ret_1y > 0) AS gainers, count(*) - count(*) FILTER (ret_1y > 0) AS losers FROM se GROUP BY 1")
def categories(spark, d):
    names = F.create_map(*(F.lit(x) for kv in CATEGORY.items() for x in kv))
    return invest.by_category(snapshot_frame(spark, d).withColumn("category", F.coalesce(names[F.col("symbol")], F.lit("small"))))


@query("rk10_screen_order", SNAP + "SELECT symbol, row_number() OVER (ORDER BY ret_1y DESC, symbol) AS place FROM se")
def screen_order(spark, d):
    place = F.row_number().over(evaluate.Window.partitionBy(F.lit(0)).orderBy(F.desc("ret_1y"), "symbol"))
    return snapshot_frame(spark, d).select("symbol", place.cast("long").alias("place"))


