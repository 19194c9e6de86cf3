"""Scans, rolling frames, quantiles and curves of one long symbol that many blocks share, against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import make_bars
from pyspark.sql import functions as F

from barweave.functions import blocks, windows
from barweave.operators import claims, evaluate, stances
from barweave.operators.folds import turns, with_folds


def walk(n, seed=1):
    return (100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0.0002, 0.02, n)))).tolist()


@pytest.fixture(scope="module")
def bars(spark):
    rows = make_bars(spark, walk(400), "A").unionByName(make_bars(spark, walk(30, 2), "B", start="2020-03-05")).unionByName(make_bars(spark, [7.0], "C"))
    return rows.repartition(3).cache()


def plain(frame):
    """The indicators of one symbol by loops."""
    frame = frame.sort_values("ts", ignore_index=True)
    close = frame["close"]

    def average(values, weight):
        out, x = [], None
        for v in values:
            x = x if pd.isna(v) else v if x is None else x + weight * (v - x)
            out.append(math.nan if x is None else x)
        return np.array(out)

    before = close.shift()
    step = close - before
    tr = pd.concat([frame["high"] - frame["low"], (frame["high"] - before).abs(), (frame["low"] - before).abs()], axis=1).max(axis=1)
    for n in (9, 12, 20, 21, 26, 50, 200):
        frame[f"ema_{n}"] = average(close, 2 / (n + 1))
    frame["macd"] = average(close, 2 / 13) - average(close, 2 / 27)
    frame["macd_signal"] = average(frame["macd"].where(close.notna()), 0.2)
    frame["macd_hist"] = frame["macd"] - frame["macd_signal"]
    won, lost = average(step.where(step.isna() | (step > 0), 0.0), 1 / 14), average((-step).where(step.isna() | (step < 0), 0.0), 1 / 14)
    frame["rsi"] = [100.0 if not b > 0 else 100 - 100 / (1 + a / b) for a, b in zip(won, lost)]
    frame["atr"] = average(tr, 1 / 14)
    return frame


def same(got, want, columns):
    keys = ["symbol", "ts"]
    got, want = (x.sort_values(keys, ignore_index=True) for x in (got, want))
    assert len(got) == len(want) and (got[keys] == want[keys]).all().all()
    for c in columns:
        assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True), c


FOLDED = ["ema_9", "ema_26", "ema_200", "macd", "macd_signal", "macd_hist", "rsi", "atr"]


@pytest.mark.parametrize(("slab_days", "unit"), [(128, 512), (20, 7), (3, 2)])
def test_averages_over_many_units(bars, slab_days, unit):
    got = with_folds(bars, slab_days=slab_days, unit=unit).toPandas()
    want = pd.concat([plain(g) for _, g in bars.toPandas().groupby("symbol")])
    same(got, want, FOLDED)
    for _, g in got.sort_values("ts").groupby("symbol"):
        assert g["_n"].tolist() == list(range(len(g)))
        middle = g["atr"].astype(float).to_numpy()
        assert len(turns(*(g[c].to_numpy() for c in ("high", "low", "close")), middle)[0]) == len(g)


def test_first_bars_are_exact(bars):
    first = with_folds(bars).where("_n = 0").collect()
    assert all((r.ema_9, r.ema_200, r.macd, r.macd_hist, r.rsi) == (r.close, r.close, 0.0, 0.0, 100.0) for r in first) and len(first) == 3


def test_missing_closes_leave_the_averages(bars):
    holes = bars.withColumn("close", F.when((F.dayofmonth("ts") % 5 != 0) & (F.col("ts") > F.lit("2020-01-04")), F.col("close")))
    got = with_folds(holes, slab_days=20, unit=7).toPandas()
    same(got, pd.concat([plain(g) for _, g in holes.toPandas().groupby("symbol")]), FOLDED)


def test_only_what_is_wanted(bars):
    assert set(with_folds(bars, want=("rsi",)).columns) - set(bars.columns) == {"rsi", "_n"} and with_folds(bars, want=()) is bars
    assert with_folds(bars.where("false")).count() == 0
    with pytest.raises(ValueError):
        with_folds(bars, emas=(1,))


COLUMNS = {
    "sma": lambda: windows.sma("close", 20), "top": lambda: windows.highest("high", 13, prior=True), "sd": lambda: windows.rolling_std("close", 7), "lag": lambda: windows.lag("close", 20),
    "tr": windows.true_range, "ahead": lambda: windows.forward_return(5),
}


@pytest.mark.parametrize("size", [8, 16, 4096])
def test_rolling_frames_in_blocks(bars, size):
    got = blocks.rolling(bars, ["symbol", "ts"], COLUMNS, back=20, ahead=5, size=size).toPandas()
    same(got, bars.select("symbol", "ts", *(f().alias(c) for c, f in COLUMNS.items())).toPandas(), COLUMNS)


def test_a_symbol_is_many_tasks_with_few_copies(bars):
    rows = blocks.in_blocks(blocks.number(bars), 20, 5, 50).where("symbol = 'A'")
    assert rows.where("_own").count() == 400 and rows.where("_own").select("_block").distinct().count() == 8
    assert rows.where("not _own and _block < 8").count() == 7 * 25


def test_sliding_quantiles(bars):
    wanted = [("close", 10, 0.5, "m"), ("volume", 4, 0.1, "v"), ("close", 25, 0.9, "h")]
    holes = bars.withColumn("close", F.when(F.dayofmonth("ts") != 9, F.col("close")))
    got = blocks.rolling_quantiles(holes, wanted, size=32).toPandas()
    want = []
    for _, g in holes.toPandas().groupby("symbol"):
        g = g.sort_values("ts", ignore_index=True)
        for x, n, q, name in wanted:
            g[name] = [np.quantile(g[x][i - n + 1 : i + 1], q) if i >= n - 1 and g[x][i - n + 1 : i + 1].notna().all() else math.nan for i in range(len(g))]
        want.append(g)
    same(got, pd.concat(want), ["m", "v", "h"])


def test_curves_in_two_levels(bars):
    returns = bars.select("symbol", "ts", (F.col("close") / F.col("open") - 1).alias("r"))
    got = blocks.curve(returns, "r", ("symbol",), slab_days=9).toPandas()
    want = []
    for _, g in returns.toPandas().groupby("symbol"):
        g = g.sort_values("ts", ignore_index=True)
        g["equity"] = np.cumprod(1 + g["r"])
        g["drawdown"] = g["equity"] / g["equity"].cummax() - 1
        want.append(g)
    same(got, pd.concat(want), ["equity", "drawdown"])
    one = evaluate.curve_stats(returns.where("symbol = 'A'"), "r").first()
    assert one.total_return_pct == pytest.approx((want[0]["equity"].iloc[-1] - 1) * 100) and one.max_dd_pct == pytest.approx(want[0]["drawdown"].min() * 100)


def test_claims_of_many_texts_have_the_verdict_of_each(spark):
    frames = [make_bars(spark, [100 * 1.0004**i + 2 * np.sin(i / 15 + k) for i in range(n)], s) for k, (s, n) in enumerate((("A", 900), ("B", 800)))]
    rising = frames[0].unionByName(frames[1]).cache()
    said = ["Buy when RSI falls below 30, sell above 70.", "Fade the Bollinger band on momentum of 60 days", "nothing", "", None, "RSI below 2, above 98"]
    texts = spark.createDataFrame(list(enumerate(said)), "k int, text string")
    got = {r.k: (r.edge, r.note) for r in claims.verdicts(rising, texts, ["k"], 5, 5, batch=1).collect()}
    want = {k: tuple(claims.analyse(rising, t, 5, 5).first()) for k, t in enumerate(said)}
    assert got == want and {n for _, n in got.values()} >= {"no rule found"}
    assert claims.verdicts(rising, texts.where("false"), ["k"]).count() == 0
    assert stances.reads(["momentum"]) == ()
