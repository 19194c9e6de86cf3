"""Queries of claims, costed verdicts, accuracy rows, stores and exact rounding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barweave.functions import scalars
from barweave.operators import claims, evaluate, graph, notes, search, stances
from barweave.operators.folds import with_folds
from barweave.plans import misc_q
from barweave.plans import sqltext as q
from barweave.plans.catalogue import query
from barweave.plans.evaluate_q import HOLD, VERDICT, fade, named_frame, rates_sql, rounded, sweep_sql
from barweave.plans.indicators_q import DAYS
from barweave.plans.misc_q import BARS
from barweave.plans.strategy_q import LUCK_SQL, cdf_sql
from barweave.sources import tables
from barweave.sources.tables import daily_bars

# ---------------------------------------------------------------- stores


@query("src2_bar_store", DAYS + f"SELECT {BARS} FROM bars WHERE symbol IN ('LARGE', 'SMALL') AND ts >= TIMESTAMP '1995-01-01'")
def bar_store(spark, d):
    """Bars written on a miss and read back, from a first narrow and a later wide request."""
    store = tables.BarStore(spark, tables.shared_folder(spark, "bars"), lambda symbol, _: daily_bars(spark, d).where(F.col("symbol") == symbol))
    store.get("LARGE", "day", "1996-01-01", "1996-02-01")
    parts = [store.get(s, "day", "1995-01-01") for s in ("LARGE", "SMALL")]
    return parts[0].unionByName(parts[1]).select(*BARS.split(", "))


@query("src12_ledger_table", misc_q.L + "SELECT id, account, mode, round(pnl, 2) AS pnl FROM led WHERE mode = 'paper'")
def ledger_table(spark, d):
    """Trades written partitioned by mode; a mode is read without the others."""
    path = tables.shared_folder(spark, "ledger")
    misc_q.trades(spark, d).write.partitionBy("mode").parquet(path)
    back = spark.read.schema("id long, account long, exit_time timestamp_ntz, pnl double, mode string").parquet(path)
    return back.where("mode = 'paper'").select("id", "account", "mode", F.round("pnl", 2).alias("pnl"))


# ---------------------------------------------------------------- verdicts, ranks and views


@query("vp3_costed_verdict", HOLD + """SELECT symbol, count(*) AS trades, round(avg(net_ret) * 100, 4) AS avg_trade_pct, round(median(net_ret) * 100, 4) AS median_trade_pct,
  avg(net_ret) > 0 AND coalesce(sum(net_ret) FILTER (net_ret > 0) / nullif(-sum(net_ret) FILTER (net_ret < 0), 0), 1e9) > 1 AND count(*) >= 20 AS plausible FROM tr GROUP BY symbol""")
def costed_verdict(spark, d):
    return rounded(evaluate.costed_verdict(evaluate.hold_trades(fade(spark, d), 5, 0.002)))


RARE = {**stances.INDICATORS, "never": lambda: F.lit(0)}


@query("rk4_nan_last", rates_sql(q.SINGLE | {"never": "0"}).replace("SELECT rule, sg AS signals", "SELECT rule, row_number() OVER (ORDER BY (acc - base) DESC NULLS LAST, rule) AS place, sg AS signals"))
def nan_last(spark, d):
    """Rules by their edge, best first; one without signals has no edge and comes last."""
    rates = evaluate.hit_rates(named_frame(spark, d, RARE), list(RARE))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("edge_pp"), "rule"))  # as many rows as rules
    return rounded(rates.withColumn("place", place.cast("long")))


UI = "rule AS name, sg AS signals, round(acc, 4) AS accuracy, round((acc - base) * 100, 4) AS edge_pp"
VOLUME_UI = "rule AS name, vsg AS signals, round(vacc, 4) AS accuracy, round((vacc - base) * 100, 4) AS edge_pp"


def _body(rules: dict, columns: str, kind: str, busy: bool = False) -> str:
    sql = rates_sql(rules, busy)
    return f"SELECT * FROM ({sql[: sql.rindex('SELECT rule')]}SELECT '{kind}' AS kind, {columns} FROM z)"


@query("vp16_accuracy_rows", " UNION ALL ".join((_body(q.SINGLE, UI, "single"), _body(q.JOINT, UI, "confluence"), _body(q.SINGLE, VOLUME_UI, "volume", True))))
def accuracy_rows(spark, d):
    """Three kinds of hit rates in the one shape that a view draws."""
    shape = lambda rates, kind, accuracy, edge, signals: rates.select(F.lit(kind).alias("kind"), F.col("rule").alias("name"), F.col(signals).alias("signals"), F.col(accuracy).alias("accuracy"), F.col(edge).alias("edge_pp"))
    single, joint = (evaluate.hit_rates(named_frame(spark, d, r), list(r)) for r in (stances.INDICATORS, stances.CONFLUENCE))
    volume = evaluate.hit_rates(named_frame(spark, d, stances.INDICATORS), list(stances.INDICATORS), busy=stances.busy())
    rows = shape(single, "single", "accuracy", "edge_pp", "signals").unionByName(shape(joint, "confluence", "accuracy", "edge_pp", "signals"))
    return rounded(rows.unionByName(shape(volume, "volume", "vol_acc", "vol_edge_pp", "vol_signals")))


@query("so1_trades_of_all", HOLD.replace("lead(ts, 5)", "lead(ts, 5)") + "SELECT symbol, count(*) AS trades, round(sum(net_ret), 4) AS net FROM tr WHERE symbol IN ('LARGE', 'SMALL') GROUP BY symbol")
def trades_of_all(spark, d):
    """Trades of symbols that were held one by one, put together."""
    trades = evaluate.hold_trades(fade(spark, d), 5, 0.002)
    both = trades.where("symbol = 'LARGE'").unionByName(trades.where("symbol = 'SMALL'"))
    return rounded(both.groupBy("symbol").agg(F.count("*").alias("trades"), F.sum("net_ret").alias("net")))


@query("sc05_exact_rounding", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(printf('%.2f', l_extendedprice * l_quantity / 1000) AS DOUBLE) AS two, CAST(printf('%.1f', l_quantity / 8) AS DOUBLE) AS one, CAST(printf('%.0f', l_quantity / 2) AS DOUBLE) AS whole FROM lineitem")
def exact_rounding(spark, d):
    """Figures of order lines, rounded by their binary value; halves go to the even neighbour."""
    rows = tables.read(spark, d, "lineitem")
    two, one, whole = scalars.round_exact(F.col("l_extendedprice") * F.col("l_quantity") / 1000, 2), scalars.round_exact(F.col("l_quantity") / 8, 1), scalars.round_exact(F.col("l_quantity") / 2, 0)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", two.alias("two"), one.alias("one"), whole.alias("whole"))


# ---------------------------------------------------------------- claims

CLAIM = "Buy when RSI falls below 30 and sell above 70, or fade the lower Bollinger band; a momentum of 60 days helps."
CONFIGS = [("rsi_reversion[high=70,low=30]", "rsi_reversion", {"low": 30, "high": 70}), ("boll_reversion[num_std=2.0,period=20]", "boll_reversion", {"period": 20, "num_std": 2.0}), ("momentum[lookback=60]", "momentum", {"lookback": 60})]


@query("sc20_claim", sweep_sql(CONFIGS) + VERDICT.replace("is_signals >= 300 AND oos_signals >= 150", "is_signals >= 150 AND oos_signals >= 75") + "SELECT config, arg_max(horizon, row(oos_cond_edge_pp, -horizon)) AS horizon, round(max(oos_cond_edge_pp), 4) AS oos_cond_edge_pp FROM v GROUP BY config")
def claim(spark, d):
    """What becomes of a claim's rules out of sample, each at its best horizon."""
    configs = claims.configs_of(claims.rules_of(spark, CLAIM))
    return rounded(claims.best_of_each(claims.tested(daily_bars(spark, d), configs)).select("config", "horizon", "oos_cond_edge_pp"))


#: The configurations that the texts of the given conversations and ``misc_q.CLAIMS`` speak of.
CLAIMED = [
    ("rsi_reversion", {"high": 75, "low": 25}), ("rsi_reversion", {"high": 70, "low": 20}), ("rsi_reversion", {"high": 70, "low": 30}), ("rsi_pro_trend", {"mid": 50}), ("rsi_ma_vol", {"dip": 35, "n": 50, "style": "dip", "vol_mult": 1.0}),
    ("rsi_ma_vol", {"dip": 35, "n": 200, "style": "dip", "vol_mult": 1.0}), ("ema_cross", {"fast": 50, "slow": 200}), ("tri_ma", {"fast": 9, "mid": 21, "slow": 55}), ("boll_reversion", {"num_std": 2.0, "period": 20}), ("donchian", {"n": 20}), ("donchian", {"n": 52}),
    ("momentum", {"lookback": 20}), ("momentum", {"lookback": 60}), ("ensemble", {"k": 3}),
]
CLAIMED = [(stances.label(f, p), f, p) for f, p in CLAIMED]
RULES_CTE = misc_q.RULES.strip().removeprefix("WITH ").replace("SELECT conv_id, turn, array_to_string(", "ru AS (SELECT conv_id, turn, array_to_string(").rstrip() + ")"
RULES_CTE = RULES_CTE.replace("\nru AS", ",\nru AS").replace("c AS (SELECT conv_id", "said AS (SELECT conv_id", 1).replace("FROM c)", "FROM said)").replace("n AS (SELECT *, coalesce", "nums AS (SELECT *, coalesce").replace("AS r FROM n)", "AS r FROM nums)").replace("r AS (SELECT conv_id, turn, [", "rl AS (SELECT conv_id, turn, [").replace(" AS rules FROM r)", " AS rules FROM rl)")


@query("sc20_verdicts", sweep_sql(CLAIMED) + VERDICT.replace("is_signals >= 300 AND oos_signals >= 150", "is_signals >= 150 AND oos_signals >= 75").rstrip() + ",\n" + RULES_CTE + f""",
tc AS (SELECT DISTINCT conv_id, turn, replace(replace(trim(x), '(', '['), ')', ']') AS config FROM (SELECT conv_id, turn, unnest(string_split(rules, ';')) AS x FROM ru) WHERE x <> ''),
tv AS (SELECT conv_id, turn, arg_max(row(v.config, horizon, oos_signals, oos_cond_edge_pp), row(oos_cond_edge_pp, -horizon, v.config)) AS b, count(*) AS t FROM tc JOIN v ON v.config = tc.config GROUP BY ALL),
te AS (SELECT conv_id, turn, b[1] AS best, b[2] AS horizon, b[4] AS edge, 100 * sqrt(0.25 / b[3]) AS se, t, CASE WHEN t >= 2 THEN {LUCK_SQL} ELSE 0 END AS luck FROM tv),
tz AS (SELECT *, edge / se AS z FROM te),
tw AS (SELECT *, 1 - pow(1 - (1 - ({cdf_sql('z')})), t) < 0.05 AND edge > se * luck AS survives FROM tz)
SELECT ru.conv_id, ru.turn, tw.best, tw.horizon, coalesce(t, 0) AS trials, coalesce(survives, false) AS edge, CASE WHEN ru.rules = '' THEN 'no rule found' WHEN t IS NULL THEN 'too few signals' WHEN survives THEN 'survives' ELSE 'does not survive' END AS note
FROM ru LEFT JOIN tw ON tw.conv_id = ru.conv_id AND tw.turn = ru.turn""")
def verdicts(spark, d):
    """A verdict on every text of the conversations, from one table of their configurations."""
    found = claims.verdicts(daily_bars(spark, d), misc_q.claims(spark, d), ["conv_id", "turn"])
    return found.select("conv_id", "turn", "best", "horizon", "trials", "edge", "note")


# ---------------------------------------------------------------- the search

SEEDS = stances.configs()


#: The rows of a sweep that the search counts, suspects, and each configuration at its fittest horizon.
FIT = f""", vs AS (SELECT *, least(is_cond_edge_pp, oos_cond_edge_pp) AS fit, oos_accuracy >= 0.8 AS suspect FROM w WHERE is_signals >= 200 AND oos_signals >= 100 AND horizon IN {search.HORIZONS}),
fb AS (SELECT config, arg_max(horizon, row(fit, -horizon)) AS horizon, max(fit) AS fit, arg_max(oos_cond_edge_pp, row(fit, -horizon)) AS edge, arg_max(oos_signals, row(fit, -horizon)) AS signals FROM vs WHERE NOT suspect GROUP BY config)
"""


def searched(spark, d, generations: int = 1):
    """The search over the whole grid, in a folder of its own."""
    return search.evolve(daily_bars(spark, d), tables.shared_folder(spark, "search"), generations)


@query("fn19_generation", sweep_sql(SEEDS) + VERDICT + FIT + "SELECT config, horizon, round(fit, 4) AS fitness_pp FROM fb ORDER BY fit DESC, config LIMIT 8")
def generation(spark, d):
    """The elites of the search's first generation, read from its table."""
    return rounded(search.elites(searched(spark, d).where("horizon is not null")).select("config", "horizon", "fitness_pp"))


@query("fn19_search")
def search_of_three(spark, d):
    """Three generations, of which the last is added by a later call; children are drawn by hashes, so tests compare this with a run in one
    go."""
    folder = tables.shared_folder(spark, "search")
    for n in (2, 3):
        rows = search.evolve(daily_bars(spark, d), folder, n)
    return rounded(search.hall_of_fame(rows).select("config", "family", "horizon", "fitness_pp", "oos_signals"))


# ---------------------------------------------------------------- notes

NOTE_HEAD = sweep_sql(SEEDS) + VERDICT.rstrip() + """, w8 AS (SELECT config, arg_max(row(horizon, oos_cond_edge_pp, oos_signals, raw_60, real_edge), row(oos_cond_edge_pp, -horizon)) AS b FROM v GROUP BY config),
cn AS (SELECT 'configs' AS folder, replace(replace(replace(config, '[', ' '), ']', ' '), ',', ', ') AS slug, 'Family [[' || split_part(config, '[', 1) || ']], best after ' || b[1] || ' bars: ' || printf('%+.1f', b[2]) || ' pp on ' || b[3] || ' signals. Verdict: '
  || CASE WHEN b[5] THEN 'real-edge-claim' WHEN b[4] THEN 'drift-rider' ELSE 'no-edge' END || '.' AS body FROM w8),
sn AS (SELECT 'symbols' AS folder, symbol AS slug, 'Daily bars: ' || count(*) || ', from ' || strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d') || '. Part of [[Universe]].' AS body FROM bars GROUP BY symbol),
nn AS (SELECT folder, trim(regexp_replace(slug, '\\s+', ' ', 'g')) AS slug, body FROM cn UNION ALL SELECT * FROM sn)
"""


def vault(spark, d):
    """Notes of the symbols and of a part of the grid."""
    bars = daily_bars(spark, d)
    sweep = evaluate.sweep(stances.stances(with_folds(bars), SEEDS), [n for n, _, _ in SEEDS])
    return notes.symbol_notes(bars).unionByName(notes.config_notes(sweep, F.to_date(F.lit("1998-12-01"))))


@query("kg1_notes", NOTE_HEAD + "SELECT folder, slug, body FROM nn")
def vault_notes(spark, d):
    return vault(spark, d).select("folder", "slug", "body")


@query("kg1_index", NOTE_HEAD + "SELECT folder, '## ' || upper(folder[1]) || folder[2:] || ' (' || count(*) || ')' || chr(10) || string_agg('- [[' || slug || ']]', chr(10) ORDER BY slug) AS section FROM nn GROUP BY folder")
def vault_index(spark, d):
    return notes.index_note(vault(spark, d))


@query("src15_note_sink", DAYS + "SELECT 'symbols' AS folder, symbol AS slug FROM bars WHERE symbol <> 'LARGE' GROUP BY symbol")
def note_sink(spark, d):
    """Notes that were to be written, read from their folders; the note on one symbol is fresh."""
    rows, path = notes.symbol_notes(daily_bars(spark, d)), tables.shared_folder(spark, "vault")
    day = lambda x: F.to_date(F.lit(x))
    old = rows.where("slug = 'LARGE'").select("slug", day("2024-01-31").alias("updated"), "data_through", F.lit(False).alias("pinned"))
    notes.write_notes(rows, graph.decide(rows, old, day("2024-02-01")), path)
    return spark.read.schema("slug string, ntype string, title string, body string, links array<string>, data_through date, folder string").json(path).select("folder", "slug")


@query("vp11_edge_report", NOTE_HEAD + FIT + """, ar AS (SELECT count(*) AS archived, count(*) FILTER (real_edge) AS real_edges, count(*) FILTER (raw_60 AND NOT real_edge) AS drift_riders FROM v),
ch AS (SELECT * FROM fb ORDER BY fit DESC, config LIMIT 1)
SELECT archived, real_edges, drift_riders, 1 AS generations, 61 AS configs_tried, (SELECT count(*) FROM vs WHERE suspect) AS suspects, 'budget of 1 generations' AS last_stop,
  (SELECT string_agg(config, '; ' ORDER BY fit DESC, config) FROM (SELECT * FROM fb ORDER BY fit DESC, config LIMIT 10)) AS hall_of_fame, (SELECT config FROM ch) AS champion,
  coalesce((SELECT edge / (100 * sqrt(0.25 / greatest(signals, 1))) > sqrt(2 * ln(61)) + 1 FROM ch), false) AS meaningful FROM ar""")
def edge_report(spark, d):
    """The archive's figures beside the search's: generations, tried, suspects, hall of fame and whether its champion beats luck."""
    sweep = evaluate.sweep(stances.stances(with_folds(daily_bars(spark, d)), SEEDS), [n for n, _, _ in SEEDS])
    figures = sweep.agg(F.count("*").alias("archived"), F.count_if(F.col("real_edge")).alias("real_edges"), F.count_if(F.col("drift_rider")).alias("drift_riders"))
    return figures.join(F.broadcast(search.report(searched(spark, d), 1)))


@query("vp17_top_five", NOTE_HEAD + FIT + "SELECT config, round(edge, 4) AS edge FROM fb ORDER BY fit DESC, config LIMIT 5")
def top_five(spark, d):
    """The first five of the search's hall of fame."""
    return search.hall_of_fame(searched(spark, d), 5).select("config", F.round("oos_cond_edge_pp", 4).alias("edge"))
