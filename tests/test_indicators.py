import numpy as np
import pytest
from conftest import make_bars
from pyspark.sql import functions as F

from barweave.functions import scalars, windows
from barweave.operators import patterns, stances
from barweave.operators.folds import with_folds


def test_sma_waits_for_a_full_window(spark):
    rows = make_bars(spark, [1.0, 2, 3, 4]).select(windows.sma("close", 3).alias("x")).collect()
    assert [r.x for r in rows] == [None, None, 2.0, 3.0]


def test_ema_of_a_constant_is_the_constant(spark):
    rows = with_folds(make_bars(spark, [5.0] * 30)).select("ema_9", "rsi", "atr").collect()
    assert all(r.ema_9 == pytest.approx(5) and r.rsi == 100 and r.atr >= 0 for r in rows)


def test_rsi_stays_in_its_range_and_supertrend_sees_a_trend(spark):
    saw = with_folds(make_bars(spark, [100.0 + i % 7 for i in range(80)])).select("rsi").collect()
    assert all(0 <= r.rsi <= 100 for r in saw)
    up = with_folds(make_bars(spark, [100.0 + i for i in range(60)])).orderBy("ts").collect()
    assert up[-1].supertrend_dir == 1


def test_engulfing_and_hammer(spark):
    schema = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    import datetime as dt

    day = lambda n: dt.datetime(2020, 1, n)
    bull = spark.createDataFrame([("A", day(1), 10.0, 10.2, 8.8, 9.0, 1.0), ("A", day(2), 8.5, 10.6, 8.4, 10.5, 1.0)], schema)
    assert [r.x for r in bull.select(patterns.detect("engulfing").alias("x")).collect()] == [0, 1]
    hammer = spark.createDataFrame([("A", day(1), 10.0, 10.25, 9.0, 10.2, 1.0)], schema)
    assert hammer.select(patterns.hammer().alias("x")).first().x == 1
    flat = spark.createDataFrame([("A", day(1), 10.0, 10.0, 10.0, 10.0, 1.0)], schema)
    assert flat.select(patterns.doji().alias("x")).first().x is False
    with pytest.raises(KeyError):
        patterns.detect("unknown")


def test_the_grid_has_61_configs_in_23_families():
    assert len(stances.configs()) == 61 and len(stances.GRID) == 23


def test_stances_never_look_ahead(spark):
    rng = np.random.default_rng(3)
    closes = (100 * np.exp(np.cumsum(rng.normal(0.0003, 0.01, 330)))).tolist()
    chosen = [c for c in stances.configs() if c[1] not in ("turn_of_month",)]
    names = [n for n, _, _ in chosen]
    whole = stances.stances(with_folds(make_bars(spark, closes)), chosen).orderBy("ts").select(*[f"`{n}`" for n in names]).collect()
    part = stances.stances(with_folds(make_bars(spark, closes[:300])), chosen).orderBy("ts").select(*[f"`{n}`" for n in names]).collect()
    assert [tuple(r) for r in whole[:300]] == [tuple(r) for r in part]
    assert {v for r in whole for v in r} <= {-1, 0, 1}


def test_signal_columns(spark):
    rows = stances.signals(make_bars(spark, [1.0, 2, 1]), stances.momentum(1)).orderBy("ts").collect()
    assert [(r.direction, r.entered, r.confidence) for r in rows] == [(0, False, 0.0), (1, True, 1.0), (-1, True, 1.0)]


def test_daily_quota_fills_up_to_what_there_is(spark):
    bars = make_bars(spark, [1.0] * 5, "A").union(make_bars(spark, [1.0] * 5, "B")).union(make_bars(spark, [1.0] * 3, "C"))
    taken = stances.daily_quota(bars, 2, 1).where("entered").groupBy("ts").count().collect()
    assert len(taken) == 5 and all(r["count"] == 2 for r in taken)


def test_inverse_normal():
    for p in (0.001, 0.02, 0.3, 0.5, 0.9, 0.999):
        assert scalars.cdf(scalars.ppf(p)) == pytest.approx(p, abs=1e-6)
    assert scalars.ppf(0) == -np.inf and scalars.ppf(1) == np.inf


def test_text_scalars(spark):
    rows = spark.createDataFrame([(1, "Up - The Paper", "say ```{\"a\": 1}``` so"), (2, "plain", "no json"), (3, None, None)], "n int, title string, t string")
    head, source = scalars.publisher(F.col("title"))
    got = rows.select("n", head.alias("h"), source.alias("s"), scalars.json_object(F.col("t")).alias("j")).orderBy("n").collect()
    assert (got[0].h, got[0].s, got[0].j) == ("Up", "The Paper", '{"a": 1}')
    assert (got[1].h, got[1].s, got[1].j, got[2].j) == ("plain", "", None, None)
