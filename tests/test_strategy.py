import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import make_bars
from pyspark.sql import functions as F

from barweave.functions import scalars
from barweave.operators import audit, confluence, costs, evaluate, graph, invest, ledger, news, replay, stances
from barweave.operators.folds import with_folds


def test_hold_of_two_bars(spark):
    bars = make_bars(spark, [100.0, 110, 121, 133.1]).withColumn("direction", F.lit(1))
    rows = evaluate.hold_trades(bars, 2, 0.01).orderBy("entry_date").collect()
    assert len(rows) == 2 and rows[0].gross_ret == pytest.approx(0.21) and rows[0].net_ret == pytest.approx(0.20)


def test_metrics_of_four_trades(spark):
    trades = spark.createDataFrame([(i, float(p)) for i, p in enumerate([100, -50, 200, -30])], "exit_time int, pnl double")
    m = evaluate.trade_metrics(trades, 1000.0).first()
    assert (m.trades, m.win_rate, m.expectancy, m.total_pnl, m.max_drawdown) == (4, 0.5, 55.0, 220.0, -50.0)


def test_drift_rider_has_no_conditional_edge(spark):
    closes = [100 * 1.0004**i + 2 * np.sin(i / 15) for i in range(700)]
    chosen = stances.configs(["drift_rider", "always_long"])
    frame = stances.stances(make_bars(spark, closes), chosen)
    rows = evaluate.sweep(frame, [n for n, _, _ in chosen], min_is=10, min_oos=10).collect()
    assert rows and all(r.oos_cond_edge_pp <= 0 for r in rows)


def test_sizes_stops_and_charges(spark):
    one = spark.range(1).select(costs.position_size(F.lit(100.0), F.lit(98.0)).alias("q"), *(c.alias(n) for n, c in zip(("s", "t"), costs.stop_and_target(F.lit(100.0), F.lit(2.0), F.lit(1)))), costs.charges(F.lit(100.0), F.lit(101.0), F.lit(10), F.lit(1)).alias("c")).first()
    assert (one.q, one.s, one.t) == (250, 97.0, 104.5)
    assert one.c == pytest.approx(replay.trip_charges(100.0, 101.0, 10, 1, costs.Costs()))
    assert costs.Risk.from_config({"capital": 5.0, "unknown": 1}).capital == 5.0


def test_stop_comes_before_target_and_trails():
    p = replay.Position(1, 100.0, 97.0, 104.5, 10, None, 2.0)
    assert p.touched(200, 50) == (97.0, "stop") and p.touched(200, 99.5) == (104.5, "target") and p.touched(101, 99) is None
    p.trail(110.0, 2.0, costs.Risk())
    assert p.stop == 106.0


def test_a_new_day_lifts_the_halt():
    a = replay.Account(costs.Risk())
    a.open()
    a.close(-5000.0)
    assert not a.may_open()
    a.new_day()
    assert a.may_open()


def replayed(spark, closes):
    frame = with_folds(make_bars(spark, closes)).withColumn("direction", F.lit(1)).withColumn("entered", F.lit(True))
    return frame


def test_replay_trades_do_not_overlap(spark):
    rows = replay.replay(replayed(spark, [100 + 5 * np.sin(i / 4) for i in range(120)])).orderBy("entry_time").collect()
    assert len(rows) > 2
    assert all(a.exit_time <= b.entry_time for a, b in zip(rows, rows[1:]))
    assert {r.reason for r in rows} <= {"stop", "target", "end_of_data"}


def test_paper_session_ends_flat(spark):
    bars = replayed(spark, [100 + 3 * np.sin(i / 5) for i in range(60)])
    both = bars.union(bars.withColumn("symbol", F.lit("B")))
    rows = replay.paper_session(both, max_hold=5).collect()
    assert {r.symbol for r in rows} == {"A", "B"} and all(r.qty > 0 for r in rows)


def test_paper_session_splits_where_nothing_carries(spark):
    bars = replayed(spark, [100 + 3 * np.sin(i / 5) for i in range(60)])
    after = bars.withColumns({"symbol": F.lit("C"), "ts": F.expr("timestampadd(DAY, 59, ts)")})  # starts on the date on which B ends
    three = bars.unionByName(bars.withColumn("symbol", F.lit("B"))).unionByName(after).withColumn("_account", F.lit(0))
    session = {r.symbol: r._session for r in replay.sessions(three).collect()}
    assert session["A"] != session["B"] == session["C"]
    key = lambda r: (r.symbol, r.entry_time, r.exit_time, r.side, r.qty, r.pnl, r.reason)
    whole = replay.session_bars(three.toPandas(), replay.Risk(), replay.Costs(), 5)
    assert sorted(map(key, replay.paper_session(three.drop("_account"), max_hold=5).collect())) == sorted(map(key, whole.itertuples()))


def test_walk_forward_folds_are_disjoint(spark):
    rows = replay.walk_forward_folds(make_bars(spark, [1.0] * 300)).where("part = 'test'").groupBy("ts").count().collect()
    assert all(r["count"] == 1 for r in rows)


def test_as_of_takes_the_latest_even_if_it_is_null(spark):
    base = spark.createDataFrame([("A", 1), ("A", 5), ("A", 9), ("B", 9)], "symbol string, ts int")
    other = spark.createDataFrame([("A", 4, 1), ("A", 8, None)], "symbol string, ts int, v int")
    got = {(r.symbol, r.ts): r.v for r in confluence.as_of(base, other, "v").collect()}
    assert got == {("A", 1): 0, ("A", 5): 1, ("A", 9): 0, ("B", 9): 0}


def test_overfitting_of_noise_and_of_a_planted_edge(spark):
    def returns(n, k, edge, seed):
        x = np.random.default_rng(seed).normal(0, 1, (n, k))
        x[:, 0] += edge
        f = pd.DataFrame(x, columns=[f"c{i}" for i in range(k)]).assign(ts=range(n)).melt("ts", var_name="config", value_name="ret")
        return spark.createDataFrame(f)

    noise = audit.overfitting(returns(240, 12, 0, 1), blocks=8).first()
    planted = audit.overfitting(returns(300, 8, 1.0, 2), blocks=8).first()
    assert noise.n_splits == 70 and 0.2 < noise.pbo < 0.8
    assert planted.pbo < 0.05 and planted.prob_oos_loss < 0.05


def test_family_wise_error(spark):
    rows = spark.createDataFrame([(0, 6.7, 239, 406), (1, 9.0, 6000, 5)], "i int, edge double, n int, trials int")
    weak, strong = rows.orderBy("i").select(*(c.alias(k) for k, c in audit.edge_error(F.col("edge"), F.col("n"), F.col("trials")).items())).collect()
    assert weak["p_fwe"] > 0.5 and not weak["survives"] and strong["p_fwe"] < 0.05 and strong["survives"]


def test_normal_distribution(spark):
    xs = [-40.0, -9.0, -3.5, -1.96, -0.01, 0.0, 1e-9, 0.7, 2.0, 5.0, 8.5, 40.0]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(scalars.norm_cdf(F.col("x"))).collect()]
    assert got == pytest.approx([scalars.cdf(x) for x in xs], abs=1e-12)


def test_xirr(spark):
    flows = spark.sql("select array(named_struct('d', date'2020-01-01', 'amt', -100D), named_struct('d', date'2021-01-01', 'amt', 110D)) f, array(named_struct('d', date'2020-01-01', 'amt', 1D)) g")
    row = flows.select(invest.xirr(F.col("f")).alias("x"), invest.xirr(F.col("g")).alias("y")).first()
    assert row.x == pytest.approx(0.1, abs=2e-3) and row.y is None


def test_setup_tags(spark):
    up = with_folds(make_bars(spark, [100 * 1.004**i for i in range(300)]))
    down = with_folds(make_bars(spark, [100 * 0.997**i for i in range(300)]))
    short = with_folds(make_bars(spark, [1.0, 2.0, 3.0]))
    assert [invest.snapshot(x).first().setup for x in (up, down, short)] == ["near-high uptrend", "oversold downtrend", "insufficient history"]


def test_headlines_keep_the_first_spelling(spark):
    rows = spark.createDataFrame(list(enumerate(["Nifty up", "nifty   up", "Sensex falls", "", "Sensex falls", None])), "pos int, title string")
    assert [r.title for r in news.dedupe(rows).orderBy("pos").collect()] == ["Nifty up", "Sensex falls"]


def test_regime(spark):
    rows = spark.createDataFrame([(1.0, 1.0, -2.0), (-1.0, -1.0, 5.0), (None, None, None)], "a double, b double, v double")
    _, regime, _ = news.regime(F.col("a"), F.col("b"), F.col("v"))
    assert [r[0] for r in rows.select(regime).collect()] == ["risk_on", "risk_off", "neutral"]


def test_ledger(spark):
    t = dt.datetime
    rows = spark.createDataFrame([(1, "paper", t(2025, 1, 1, 10), 10.0), (2, "paper", t(2025, 1, 1, 11), -4.0), (3, "paper", t(2025, 1, 2), 7.5), (4, "backtest", t(2025, 1, 2), 1.0), (5, "paper", None, None)], "id int, mode string, exit_time timestamp, pnl double")
    days = {str(r.day): (r.realized_pnl, r.trades_count) for r in ledger.daily_rollup(rows, "paper").collect()}
    assert days == {"2025-01-01": (6.0, 2), "2025-01-02": (7.5, 1)}
    assert {r.id for r in ledger.recent(rows, 1).collect()} == {3, 4}


def test_staleness(spark):
    d = dt.date
    mine = spark.createDataFrame([(s, d(2024, 1, 10)) for s in "abcde"], "slug string, data_through date")
    old = spark.createDataFrame([("b", d(2024, 1, 9), d(2024, 1, 1), True), ("c", d(2024, 1, 9), d(2024, 1, 1), False), ("d", d(2023, 12, 28), d(2024, 1, 10), False), ("e", d(2024, 1, 9), d(2024, 1, 10), False), ("z", d(2023, 1, 1), None, False)], "slug string, updated date, data_through date, pinned boolean")
    got = {r.slug: r.decision for r in graph.decide(mine, old, F.to_date(F.lit("2024-01-10"))).collect()}
    assert got == {"a": "new", "b": "pinned", "c": "new-data", "d": "stale", "e": "fresh", "z": "archive"}
