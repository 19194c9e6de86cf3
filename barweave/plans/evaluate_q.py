"""Queries that score stances."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.operators import evaluate as e
from barweave.operators import stances
from barweave.operators.folds import with_folds
from barweave.plans import sqltext as q
from barweave.plans.catalogue import query
from barweave.plans.indicators_q import DAYS, FOLDED, folded
from barweave.sources.tables import daily_bars

HEAD = FOLDED[:-1] + ",\n"
NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS c FROM bars)"


def rounded(df, keep=()):
    """All doubles to four places."""
    return df.select(*(F.round(c, 4).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


def moves(horizons) -> str:
    return "mv AS (SELECT symbol, ts, unnest([" + ", ".join(f"struct_pack(h := {h}, f := lead(close, {h}) OVER ({q.W}) / close - 1)" for h in horizons) + "]) AS m FROM base)"


def sweep_sql(configs, horizons=e.HORIZONS) -> str:
    return HEAD + q.stance_rows(configs) + f""",
{moves(horizons)},
sl AS (SELECT symbol, ts, CASE WHEN row_number() OVER ({q.W}) <= floor(count(*) OVER (PARTITION BY symbol) * 0.7) THEN 'is' ELSE 'oos' END AS slice FROM base),
x AS (SELECT st.config, mv.m.h AS horizon, sl.slice, st.stance, CAST(sign(mv.m.f) AS INT) AS move FROM st JOIN sl USING (symbol, ts) JOIN mv USING (symbol, ts) WHERE st.stance <> 0 AND mv.m.f IS NOT NULL),
cnt AS (SELECT config, horizon, slice, count(*) AS n, count(*) FILTER (move = stance) AS hits, count(*) FILTER (move > 0) AS up, count(*) FILTER (move < 0) AS dn, count(*) FILTER (stance = 1) AS l, count(*) FILTER (stance = -1) AS s FROM x GROUP BY ALL),
bs AS (SELECT mv.m.h AS horizon, slice, count(*) AS valid, count(*) FILTER (mv.m.f > 0) AS bup FROM mv JOIN sl USING (symbol, ts) WHERE mv.m.f IS NOT NULL GROUP BY ALL),
stat AS (SELECT config, horizon, slice, n AS signals, n / valid AS coverage, hits / n AS accuracy, greatest(up, dn) / n AS cond_base, (hits - greatest(up, dn)) / n * 100 AS cond_edge_pp,
  greatest(bup / valid, 1 - bup / valid) AS global_base, (hits / n - greatest(bup / valid, 1 - bup / valid)) * 100 AS global_edge_pp, l AS "long", s AS "short" FROM cnt JOIN bs USING (horizon, slice))
"""


STAT_OUT = 'SELECT config, horizon, slice, signals, round(coverage, 4) AS coverage, round(accuracy, 4) AS accuracy, round(cond_base, 4) AS cond_base, round(cond_edge_pp, 4) AS cond_edge_pp, round(global_base, 4) AS global_base, round(global_edge_pp, 4) AS global_edge_pp, "long", "short" FROM stat'
VERDICT = """, w AS (SELECT config, horizon, max(signals) FILTER (slice = 'is') AS is_signals, max(accuracy) FILTER (slice = 'is') AS is_accuracy, max(cond_edge_pp) FILTER (slice = 'is') AS is_cond_edge_pp, max(signals) FILTER (slice = 'oos') AS oos_signals, max(accuracy) FILTER (slice = 'oos') AS oos_accuracy, max(cond_edge_pp) FILTER (slice = 'oos') AS oos_cond_edge_pp FROM stat GROUP BY ALL),
v AS (SELECT *, oos_accuracy >= 0.6 AS raw_60, oos_cond_edge_pp >= 2 AND is_cond_edge_pp >= 1 AS real_edge FROM w WHERE is_signals >= 300 AND oos_signals >= 150)
"""
VERDICT_OUT = "SELECT config, horizon, is_signals, round(is_accuracy, 4) AS is_accuracy, round(is_cond_edge_pp, 4) AS is_cond_edge_pp, oos_signals, round(oos_accuracy, 4) AS oos_accuracy, round(oos_cond_edge_pp, 4) AS oos_cond_edge_pp, raw_60, real_edge, raw_60 AND NOT real_edge AS drift_rider FROM v"
BOLL = stances.configs(["boll_reversion"])


def boll_frame(spark, d):
    return stances.stances(daily_bars(spark, d), BOLL)


@query("ag16_boll_hit_rate", sweep_sql(BOLL) + STAT_OUT)
def boll_hit_rate(spark, d):
    """The minimum slice: bars, bands, stance, forward returns, slices, hit rates against the best constant bet."""
    counts, base = e.sweep_counts(e.split(boll_frame(spark, d)), [n for n, _, _ in BOLL])
    return rounded(e.slice_stats(counts, base))


ALL = stances.configs()


def full_frame(spark, d):
    return stances.stances(with_folds(daily_bars(spark, d)))


def full_sweep(spark, d):
    return e.sweep(full_frame(spark, d), [n for n, _, _ in ALL])


@query("ag16_sweep", sweep_sql(ALL) + STAT_OUT)
def sweep_stats(spark, d):
    counts, base = e.sweep_counts(e.split(e.long_enough(full_frame(spark, d), e.MIN_BARS)), [n for n, _, _ in ALL])
    return rounded(e.slice_stats(counts, base))


@query("ag18_verdicts", sweep_sql(ALL) + VERDICT + VERDICT_OUT)
def sweep_verdicts(spark, d):
    return rounded(full_sweep(spark, d))


@query("rk3_ranked", sweep_sql(ALL) + VERDICT + "SELECT config, horizon, round(oos_cond_edge_pp, 4) AS edge, row_number() OVER (ORDER BY oos_cond_edge_pp DESC, oos_accuracy DESC, config, horizon) AS place FROM v ORDER BY place LIMIT 20")
def ranked(spark, d):
    order = [F.desc("oos_cond_edge_pp"), F.desc("oos_accuracy"), "config", "horizon"]
    top = full_sweep(spark, d).orderBy(*order).limit(20)
    place = F.row_number().over(e.Window.partitionBy(F.lit(0)).orderBy(*order))
    return top.select("config", "horizon", F.round("oos_cond_edge_pp", 4).alias("edge"), place.cast("long").alias("place"))


@query("rk5_best_horizon", sweep_sql(ALL) + VERDICT + "SELECT config, arg_max(horizon, row(oos_cond_edge_pp, -horizon)) AS horizon, round(max(oos_cond_edge_pp), 4) AS edge FROM v GROUP BY config")
def best_horizon(spark, d):
    return full_sweep(spark, d).groupBy("config").agg(F.max_by("horizon", F.struct("oos_cond_edge_pp", -F.col("horizon"))).alias("horizon"), F.round(F.max("oos_cond_edge_pp"), 4).alias("edge"))


@query("rk6_first_per_family", sweep_sql(ALL) + VERDICT + ", f AS (SELECT *, split_part(config, '[', 1) AS family FROM v), g AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY oos_cond_edge_pp DESC, oos_accuracy DESC, config, horizon) AS p FROM f) SELECT family, config, horizon FROM g WHERE p = 1 ORDER BY oos_cond_edge_pp DESC, oos_accuracy DESC, config, horizon LIMIT 8")
def first_per_family(spark, d):
    rows = full_sweep(spark, d).withColumn("family", F.substring_index("config", "[", 1))
    order = [F.desc("oos_cond_edge_pp"), F.desc("oos_accuracy"), "config", "horizon"]
    first = rows.withColumn("p", F.row_number().over(e.Window.partitionBy("family").orderBy(*order))).where("p = 1")
    return first.orderBy(*order).limit(8).select("family", "config", "horizon")


@query("vp8_config_verdict", sweep_sql(ALL) + VERDICT + "SELECT config, horizon, CASE WHEN real_edge THEN 'real-edge-claim' WHEN raw_60 THEN 'drift-rider' ELSE 'no-edge' END AS verdict FROM v")
def config_verdict(spark, d):
    tag = F.when(F.col("real_edge"), "real-edge-claim").when(F.col("drift_rider"), "drift-rider").otherwise("no-edge")
    return full_sweep(spark, d).select("config", "horizon", tag.alias("verdict"))


def rates_sql(rules, busy: bool = False) -> str:
    tail = """SELECT rule, sg AS signals, round(acc, 4) AS base_acc, vsg AS vol_signals, round(vacc, 4) AS vol_acc, round((vacc - acc) * 100, 4) AS delta_pp, round((vacc - base) * 100, 4) AS vol_edge_pp FROM z""" if busy else "SELECT rule, sg AS signals, round(sg / b, 4) AS coverage, round(acc, 4) AS accuracy, round(base, 4) AS base, round((acc - base) * 100, 4) AS edge_pp FROM z"
    return HEAD + q.named_rows(rules) + f""",
f AS (SELECT symbol, ts, CAST(sign(lead(close, 5) OVER ({q.W}) / close - 1) AS INT) AS move, coalesce(volume > {q.SMA_V}, false) AS busy FROM base),
y AS (SELECT config AS rule, count(*) AS b, count(*) FILTER (move > 0) AS up, count(*) FILTER (stance <> 0) AS sg, count(*) FILTER (stance <> 0 AND move = stance) AS ht, count(*) FILTER (stance <> 0 AND busy) AS vsg, count(*) FILTER (stance <> 0 AND busy AND move = stance) AS vht FROM st JOIN f USING (symbol, ts) WHERE move IS NOT NULL GROUP BY config),
z AS (SELECT *, ht / nullif(sg, 0) AS acc, greatest(up / b, 1 - up / b) AS base, vht / nullif(vsg, 0) AS vacc FROM y)
{tail}"""


def named_frame(spark, d, rules):
    bars = stances.prepare(e.long_enough(with_folds(daily_bars(spark, d)), e.MIN_BARS_ACCURACY))
    return bars.select("symbol", "ts", "close", "volume", *(f().cast("int").alias(n) for n, f in rules.items()))


@query("ag12_indicator_hit_rate", rates_sql(q.SINGLE))
def indicator_hit_rate(spark, d):
    return rounded(e.hit_rates(named_frame(spark, d, stances.INDICATORS), list(stances.INDICATORS)))


@query("ag13_confluence_hit_rate", rates_sql(q.JOINT))
def confluence_hit_rate(spark, d):
    return rounded(e.hit_rates(named_frame(spark, d, stances.CONFLUENCE), list(stances.CONFLUENCE)))


@query("ag14_volume_hit_rate", rates_sql(q.SINGLE, busy=True))
def volume_hit_rate(spark, d):
    return rounded(e.hit_rates(named_frame(spark, d, stances.INDICATORS), list(stances.INDICATORS), busy=stances.busy()))


@query("ag15_all_hit_rates", rates_sql(q.SINGLE | q.JOINT).replace("SELECT rule, sg AS", f"SELECT CASE WHEN rule IN ({', '.join(repr(n) for n in q.JOINT)}) THEN 'confluence' ELSE 'single' END AS kind, rule, sg AS"))
def all_hit_rates(spark, d):
    single, joint = (e.hit_rates(named_frame(spark, d, r), list(r)).withColumn("kind", F.lit(k)) for k, r in (("single", stances.INDICATORS), ("confluence", stances.CONFLUENCE)))
    return rounded(single.unionByName(joint))


@query("vp4_indicator_verdict", rates_sql(q.SINGLE).replace("SELECT rule, sg AS signals, round(sg / b, 4) AS coverage, round(acc, 4) AS accuracy, round(base, 4) AS base, round((acc - base) * 100, 4) AS edge_pp", "SELECT rule, (acc - base) * 100 > 1 AND sg >= 200 AS edge"))
def indicator_verdict(spark, d):
    rates = e.hit_rates(named_frame(spark, d, stances.INDICATORS), list(stances.INDICATORS))
    return rates.select("rule", ((F.col("edge_pp") > 1) & (F.col("signals") >= 200)).alias("edge"))


RSI_DIR = HEAD + f"""s AS (SELECT *, {q.RSI_REV} AS direction FROM base),
"""


@query("ag09_rsi_directional", HEAD + moves((1, 3, 5, 10)) + f""", s AS (SELECT symbol, ts, {q.RSI_REV} AS d FROM base)
SELECT m.h AS horizon, count(*) FILTER (d = 1) AS longs, count(*) FILTER (d = -1) AS shorts, round(avg(CASE WHEN d = 1 THEN CAST(m.f > 0 AS INT) END), 4) AS long_acc, round(avg(CASE WHEN d = -1 THEN CAST(m.f < 0 AS INT) END), 4) AS short_acc, round(avg(CAST(m.f > 0 AS INT)), 4) AS base_up
FROM mv JOIN s USING (symbol, ts) WHERE m.f IS NOT NULL GROUP BY 1""")
def rsi_directional(spark, d):
    frame = folded(spark, d).withColumn("direction", stances.rsi_reversion(30, 70))
    rows, side, move = e.hold_by_horizon(frame, (1, 3, 5, 10)), F.col("direction"), F.col("move")
    return rounded(rows.groupBy("horizon").agg(F.sum((side == 1).cast("long")).alias("longs"), F.sum((side == -1).cast("long")).alias("shorts"), F.avg(F.when(side == 1, (move > 0).cast("int"))).alias("long_acc"), F.avg(F.when(side == -1, (move < 0).cast("int"))).alias("short_acc"), F.avg((move > 0).cast("int")).alias("base_up")))


BARS_BASE = DAYS[:-1] + ",\nbase AS (SELECT * FROM bars),\n" + f"s AS (SELECT symbol, ts, close, {q.boll(20, 2.0)} AS direction FROM base)"


def fade(spark, d):
    return daily_bars(spark, d).withColumn("direction", stances.boll_reversion())


HOLD = BARS_BASE + f", t AS (SELECT symbol, ts AS entry_date, lead(ts, 5) OVER ({q.W}) AS exit_date, direction, direction * (lead(close, 5) OVER ({q.W}) / close - 1) AS gross_ret FROM s), tr AS (SELECT *, gross_ret - 0.002 AS net_ret FROM t WHERE direction <> 0 AND gross_ret IS NOT NULL)\n"


@query("sim9_hold_trades", HOLD + "SELECT symbol, entry_date, exit_date, direction, round(gross_ret, 4) AS gross_ret, round(net_ret, 4) AS net_ret FROM tr")
def hold_trades(spark, d):
    return rounded(e.hold_trades(fade(spark, d), 5, 0.002))


@query("ag03_daily_pnl", HOLD + "SELECT exit_date, round(sum(net_ret) * 100, 4) AS pnl_pct, count(*) AS trades FROM tr GROUP BY 1")
def daily_pnl(spark, d):
    return rounded(e.daily_pnl(e.hold_trades(fade(spark, d), 5, 0.002)))


@query("ag05_day_counts", HOLD + "SELECT count(*) FILTER (p > 0) AS profit_days, count(*) FILTER (p < 0) AS loss_days FROM (SELECT exit_date, sum(net_ret) AS p FROM tr GROUP BY 1)")
def day_counts(spark, d):
    days = e.daily_pnl(e.hold_trades(fade(spark, d), 5, 0.002))
    return days.agg(F.sum((F.col("pnl_pct") > 0).cast("long")).alias("profit_days"), F.sum((F.col("pnl_pct") < 0).cast("long")).alias("loss_days"))


HT = BARS_BASE + ", mv AS (SELECT symbol, ts, direction, unnest([" + ", ".join(f"struct_pack(h := {h}, x := lead(ts, {h}) OVER ({q.W}), f := lead(close, {h}) OVER ({q.W}) / close - 1)" for h in range(1, 13)) + """]) AS m FROM s),
r AS (SELECT symbol, m.h AS horizon, m.x AS x, direction, m.f AS f, direction * m.f AS g, direction * m.f - 0.002 AS net FROM mv WHERE m.f IS NOT NULL),
b AS (SELECT symbol, horizon, avg(CAST(f > 0 AS INT)) AS base_up_rate FROM r GROUP BY ALL),
k AS (SELECT symbol, horizon, count(*) AS signals, avg(CAST(g > 0 AS INT)) AS win_rate, avg(net) * 100 AS avg_ret_pct, sum(net) * 100 AS total_pnl_pct FROM r WHERE direction <> 0 GROUP BY ALL),
dd AS (SELECT symbol, horizon, count(*) FILTER (p > 0) AS profit_days, count(*) FILTER (p < 0) AS loss_days FROM (SELECT symbol, horizon, x, sum(net) AS p FROM r WHERE direction <> 0 GROUP BY ALL) GROUP BY ALL),
ht AS (SELECT symbol, horizon, base_up_rate, coalesce(signals, 0) AS signals, win_rate, coalesce(avg_ret_pct, 0) AS avg_ret_pct, coalesce(total_pnl_pct, 0) AS total_pnl_pct, coalesce(profit_days, 0) AS profit_days, coalesce(loss_days, 0) AS loss_days, win_rate - greatest(base_up_rate, 1 - base_up_rate) AS edge_vs_base FROM b LEFT JOIN k USING (symbol, horizon) LEFT JOIN dd USING (symbol, horizon))
"""


def cols4(*names):
    return ", ".join(f"round({n}, 4) AS {n}" for n in names)


@query("ag06_horizon_table", HT + f"SELECT symbol, horizon, signals, profit_days, loss_days, {cols4('base_up_rate', 'win_rate', 'avg_ret_pct', 'total_pnl_pct', 'edge_vs_base')} FROM ht")
def horizon_table(spark, d):
    return rounded(e.horizon_table(fade(spark, d), cost=0.002))


POOL = "SELECT horizon, CAST(sum(signals) AS BIGINT) AS signals, sum(win_rate * signals) / sum(signals) AS win_rate, sum(avg_ret_pct * signals) / sum(signals) AS avg_ret_pct, sum(edge_vs_base * signals) / sum(signals) AS edge_vs_base, sum(total_pnl_pct) AS total_pnl_pct FROM ht GROUP BY 1"


@query("ag07_pooled_horizons", HT + f"SELECT horizon, signals, {cols4('win_rate', 'avg_ret_pct', 'edge_vs_base', 'total_pnl_pct')} FROM ({POOL})")
def pooled(spark, d):
    return rounded(e.pooled_horizons(e.horizon_table(fade(spark, d), cost=0.002)))


@query("ag08_pooled_daily", HT + "SELECT horizon, x AS exit_date, round(sum(net) * 100, 4) AS pnl_pct, count(*) AS trades FROM r WHERE direction <> 0 GROUP BY 1, 2")
def pooled_daily(spark, d):
    rows = e.hold_by_horizon(fade(spark, d), range(1, 13), 0.002).where("direction <> 0")
    return rounded(e.daily_pnl(rows, ("horizon",)))


@query("rk12_best_total", HT + f"SELECT arg_max(horizon, row(total_pnl_pct, -horizon)) AS horizon FROM ({POOL})")
def best_total(spark, d):
    pool = e.pooled_horizons(e.horizon_table(fade(spark, d), cost=0.002))
    return pool.agg(F.max_by("horizon", F.struct("total_pnl_pct", -F.col("horizon"))).alias("horizon"))


ALIGNED = "p AS (SELECT symbol, ts, close FROM bars WHERE ts IN (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)))"


@query("jn3_aligned", q.with_(q.DAILY, ALIGNED) + "SELECT symbol, ts, close FROM p")
def aligned(spark, d):
    return e.aligned(daily_bars(spark, d)).select("symbol", "ts", "close")


@query("ag19_cross_section", q.with_(q.DAILY, ALIGNED) + f"""SELECT lookback, horizon, slice, count(*) AS signals, round(avg(CAST(sign(f) = side AS INT)), 4) AS accuracy, round(avg(f) FILTER (side = 1) * 100, 4) AS long_mean_pp, round(avg(f) FILTER (side = -1) * 100, 4) AS short_mean_pp, round((avg(f) FILTER (side = 1) - avg(f) FILTER (side = -1)) * 100, 4) AS spread_pp
FROM (SELECT lookback, mv.h AS horizon, mv.f AS f, CASE WHEN rk > names - 1 THEN 1 WHEN rk <= 1 THEN -1 END AS side, CASE WHEN i <= floor(dates * 0.7) THEN 'is' ELSE 'oos' END AS slice
  FROM (SELECT *, row_number() OVER (PARTITION BY ts, lookback ORDER BY st, symbol) AS rk, unnest(mvs) AS mv FROM (SELECT symbol, ts, i, mvs, unnest(lks).l AS lookback, unnest(lks).s AS st,
    (SELECT count(DISTINCT symbol) FROM p) AS names, (SELECT count(DISTINCT ts) FROM p) AS dates FROM (SELECT symbol, ts, row_number() OVER ({q.W}) AS i,
      [{', '.join(f"struct_pack(l := {n}, s := close / lag(close, {n}) OVER ({q.W}) - 1)" for n in (20, 60, 120))}] AS lks, [{', '.join(f"struct_pack(h := {h}, f := lead(close, {h}) OVER ({q.W}) / close - 1)" for h in (5, 10, 20))}] AS mvs FROM p)) WHERE st IS NOT NULL))
WHERE side IS NOT NULL AND f IS NOT NULL GROUP BY ALL""")
def cross_section(spark, d):
    return rounded(e.cross_section(daily_bars(spark, d)))


ROT = q.with_(q.DAILY, ALIGNED, f"""n AS (SELECT *, row_number() OVER ({q.W}) - 1 AS i, coalesce(close / lag(close) OVER ({q.W}) - 1, 0) AS r, close / lag(close, 126) OVER ({q.W}) - 1 AS tr FROM p)""",
    "s AS (SELECT symbol, i // 21 AS per FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY tr DESC, symbol) AS k FROM n WHERE i % 21 = 0 AND i >= 126) WHERE k <= 5)",
    "h AS (SELECT n.*, CASE WHEN s.symbol IS NOT NULL THEN 1 ELSE 0 END AS held FROM n LEFT JOIN s ON s.symbol = n.symbol AND s.per = n.i // 21)",
    f"g AS (SELECT ts, sum(w * r) AS portfolio, avg(r) AS market FROM (SELECT *, coalesce(lag(wt) OVER ({q.W}), 0) AS w FROM (SELECT *, held / greatest(sum(held) OVER (PARTITION BY ts), 1) AS wt FROM h)) GROUP BY ts)")


@query("ag21_rotation", ROT + "SELECT ts, round(portfolio, 4) AS portfolio, round(market, 4) AS market FROM g")
def rotation(spark, d):
    return rounded(e.rotation(daily_bars(spark, d)))


CURVE_SQL = "SELECT '{c}' AS series, round((last_e - 1) * 100, 2) AS total_return_pct, round((pow(last_e, 252.0 / n) - 1) * 100, 4) AS cagr_pct, round(coalesce(m / nullif(sd, 0) * sqrt(252), 0), 4) AS sharpe, round(dd * 100, 4) AS max_dd_pct FROM (SELECT arg_max(e, ts) AS last_e, count(*) AS n, avg({c}) AS m, stddev_samp({c}) AS sd, min(e / pk - 1) AS dd FROM (SELECT *, max(e) OVER (ORDER BY ts) AS pk FROM (SELECT *, exp(sum(ln(1 + {c})) OVER (ORDER BY ts)) AS e FROM g)))"


@query("ag22_curve_stats", ROT + CURVE_SQL.format(c="market"))
def curve_stats(spark, d):
    returns = e.rotation(daily_bars(spark, d))
    return rounded(e.curve_stats(returns, "market").withColumns({"series": F.lit("market"), "total_return_pct": F.round("total_return_pct", 2)}))


@query("vp5_momentum_verdict", ROT + f"SELECT a.cagr_pct > b.cagr_pct AND a.sharpe >= b.sharpe AS beats FROM ({CURVE_SQL.format(c='portfolio')}) a, ({CURVE_SQL.format(c='market')}) b")
def momentum_verdict(spark, d):
    returns = e.rotation(daily_bars(spark, d))
    a, b = (e.curve_stats(returns, c).select(F.col("cagr_pct").alias(f"c_{c}"), F.col("sharpe").alias(f"s_{c}")) for c in ("portfolio", "market"))
    both = a.join(F.broadcast(b))
    return both.select(((F.col("c_portfolio") > F.col("c_market")) & (F.col("s_portfolio") >= F.col("s_market"))).alias("beats"))


METRICS = HOLD + """, t2 AS (SELECT *, round(net_ret * 1000, 2) AS pnl FROM tr), c AS (SELECT *, 100000 + sum(pnl) OVER w AS eq FROM t2 WINDOW w AS (PARTITION BY symbol ORDER BY exit_date, entry_date)), pk AS (SELECT *, max(eq) OVER (PARTITION BY symbol ORDER BY exit_date, entry_date) AS peak FROM c),
m AS (SELECT symbol, count(*) AS trades, avg(CAST(pnl > 0 AS INT)) AS win_rate, avg(pnl) AS expectancy, sum(pnl) AS total_pnl, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_win, coalesce(avg(pnl) FILTER (pnl < 0), 0) AS avg_loss,
  CASE WHEN sum(pnl) FILTER (pnl < 0) < 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / -(sum(pnl) FILTER (pnl < 0)) WHEN sum(pnl) FILTER (pnl > 0) > 0 THEN NULL ELSE 0 END AS profit_factor,
  min(eq - peak) AS max_drawdown, CASE WHEN min(peak) > 0 THEN min((eq - peak) / peak) * 100 ELSE 0 END AS max_drawdown_pct, sum(pnl) / 100000 * 100 AS return_pct, CASE WHEN count(*) > 1 AND stddev_pop(pnl) > 0 THEN avg(pnl) / stddev_pop(pnl) ELSE 0 END AS sharpe FROM pk GROUP BY symbol)
"""
M_COLS = ("win_rate", "expectancy", "total_pnl", "avg_win", "avg_loss", "profit_factor", "max_drawdown", "max_drawdown_pct", "return_pct", "sharpe")


def metrics(spark, d):
    trades = e.hold_trades(fade(spark, d), 5, 0.002).withColumn("pnl", F.round(F.col("net_ret") * 1000, 2))
    return e.trade_metrics(trades, 100000.0, ("symbol",), ("exit_date", "entry_date"))


@query("ag01_trade_metrics", METRICS + f"SELECT symbol, trades, {cols4(*[c for c in M_COLS if 'draw' not in c])} FROM m")
def trade_metrics(spark, d):
    return rounded(metrics(spark, d).drop("max_drawdown", "max_drawdown_pct"))


@query("ag02_drawdown", METRICS + f"SELECT symbol, {cols4('max_drawdown', 'max_drawdown_pct')} FROM m")
def drawdown(spark, d):
    return rounded(metrics(spark, d).select("symbol", "max_drawdown", "max_drawdown_pct"))


@query("vp1_plausible", METRICS + "SELECT symbol, expectancy > 0 AND coalesce(profit_factor, 1e9) > 1 AND trades >= 20 AS plausible, expectancy > 0 AND coalesce(profit_factor, 1e9) > 1 AS walk_forward_ok FROM m")
def plausible(spark, d):
    good = (F.col("expectancy") > 0) & (F.coalesce("profit_factor", F.lit(1e9)) > 1)
    return metrics(spark, d).select("symbol", (good & (F.col("trades") >= 20)).alias("plausible"), good.alias("walk_forward_ok"))
