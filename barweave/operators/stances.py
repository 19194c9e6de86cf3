"""Stance rules: for each bar +1, -1 or 0, from data up to that bar.

A rule takes parameters and gives a column over bars with the recursive indicators of ``folds.with_folds``. ``GRID`` holds the
parameters that the sweep tries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.scalars import choose, ratio, sign
from barweave.functions.windows import Shared, bollinger, change, highest, lag, lowest, opening_range, quantile, rolling_std, rolling_sum, sma


def _column(name: str):
    return lambda: F.col(name)


O, H, L, C, V, RSI, ATR = map(_column, ("open", "high", "low", "close", "volume", "rsi", "atr"))



def no(condition: Column) -> Column:
    """The negation of a condition; an unknown one doesn't hold."""
    return ~F.coalesce(condition, F.lit(False))


def ema_cross(fast, slow) -> Column:
    return sign(F.col(f"ema_{fast}") - F.col(f"ema_{slow}"))


def momentum(lookback) -> Column:
    return sign(change(lookback))


def rsi_reversion(low, high) -> Column:
    return choose(RSI() < low, RSI() > high)


def rsi_pro_trend(mid) -> Column:
    above = C() > sma("close", 200)
    return choose(above & (RSI() > mid), no(above) & (RSI() < mid))


def boll_reversion(period=20, num_std=2.0) -> Column:
    lower, upper = bollinger(period, num_std)
    return choose(C() < lower, C() > upper)


def zscore(window) -> Column:
    """Of the bar's return; ``r`` is prepared by ``prepare``."""
    return ratio(F.col("r") - sma("r", window), rolling_std("r", window))


def ret_z_fade(window, k) -> Column:
    z = zscore(window)
    return choose(z < -k, z > k)


def streak_fade(n) -> Column:
    run = lambda c: sma(F.coalesce(c, F.lit(False)).cast("double"), n) == 1
    return choose(run(F.col("step") < 0), run(F.col("step") > 0))


def donchian(n) -> Column:
    return choose(C() > highest("high", n, prior=True), C() < lowest("low", n, prior=True))


def gap_fade(k) -> Column:
    gap = ratio(O() - lag("close"), ATR())
    return choose(gap < -k, gap > k)


def _volatility(window) -> tuple[Column, Column]:
    return F.col("atrp"), quantile("atrp", window, 0.5)


def vol_trend(fast, slow, window) -> Column:
    now, usual = _volatility(window)
    return F.when(now < usual, ema_cross(fast, slow)).otherwise(0)


def vol_reversion(period, num_std, window) -> Column:
    now, usual = _volatility(window)
    return F.when(now > usual, boll_reversion(period, num_std)).otherwise(0)


def drift_rider(n) -> Column:
    return choose(C() > sma("close", n), F.lit(False))


def always_long() -> Column:
    return F.lit(1)


def ensemble(k) -> Column:
    votes = ema_cross(9, 21) + sign(F.col("macd_hist")) + F.col("supertrend_dir") + momentum(20) + sign(C() - sma("close", 200))
    return choose(votes >= k, votes <= -k)


def adaptive_rsi(window, q_low, q_high) -> Column:
    return choose(RSI() < quantile("rsi", window, q_low), RSI() > quantile("rsi", window, q_high))


def range_position(n) -> Column:
    lo, hi = lowest("low", n), highest("high", n)
    return ratio(C() - lo, hi - lo)


def range_fade(n, low, high) -> Column:
    place = range_position(n)
    return choose(place < low, place > high)


def busy(mult=1.0, window=20) -> Column:
    """Volume above a multiple of its average."""
    return V() > sma("volume", window) * mult


def tri_ma(fast, mid, slow) -> Column:
    f, m, s = (sma("close", n) for n in (fast, mid, slow))
    return choose((f > m) & (m > s), (f < m) & (m < s))


def tri_ma_vol(fast, mid, slow, vol_mult) -> Column:
    return F.when(busy(vol_mult), tri_ma(fast, mid, slow)).otherwise(0)


def rsi_ma_vol(style, n, vol_mult, mid=50, dip=40) -> Column:
    average = sma("close", n)
    bounds = (RSI() < dip, RSI() > 100 - dip) if style == "dip" else (RSI() > mid, RSI() < 100 - mid)
    return F.when(busy(vol_mult), choose((C() > average) & bounds[0], (C() < average) & bounds[1])).otherwise(0)


def overnight(mode, n) -> Column:
    return sign(rolling_sum("night" if mode == "overnight" else "tug", n))


def month_place() -> tuple[Column, Column]:
    """Trading days of the month before a bar, and after it."""
    month = Window.partitionBy("symbol", F.trunc("ts", "MM"))
    return F.row_number().over(month.orderBy("ts")) - 1, F.row_number().over(month.orderBy(F.desc("ts"))) - 1


def turn_of_month(before, after, rest) -> Column:
    start, end = month_place()
    return F.when((start < after) | (end < before), 1).otherwise(-1 if rest == "short" else 0)


def low_vol_reversal(n, vol_window, vol_mult) -> Column:
    return F.when(V() < sma("volume", vol_window) * vol_mult, -sign(change(n))).otherwise(0)


def near_52w(n, band) -> Column:
    return choose(C() >= highest("high", n, prior=True) * (1 - band), C() <= lowest("low", n, prior=True) * (1 + band))


def _each(names: str, *rows) -> list[dict]:
    return [dict(zip(names.split(), r, strict=True)) for r in rows]


# The parameters that the sweep tries, 61 in 23 families.
GRID = {
    "ema_cross": (ema_cross, _each("fast slow", (9, 21), (20, 50), (50, 200))),
    "momentum": (momentum, _each("lookback", (10,), (20,), (60,), (120,))),
    "rsi_reversion": (rsi_reversion, _each("low high", (30, 70), (20, 80), (10, 90))),
    "rsi_pro_trend": (rsi_pro_trend, _each("mid", (50,), (55,))),
    "boll_reversion": (boll_reversion, _each("period num_std", (20, 2.0), (20, 2.5))),
    "ret_z_fade": (ret_z_fade, _each("window k", (20, 1.5), (20, 2.0), (20, 2.5), (60, 2.0))),
    "streak_fade": (streak_fade, _each("n", (3,), (4,), (5,))),
    "donchian": (donchian, _each("n", (20,), (55,), (120,))),
    "gap_fade": (gap_fade, _each("k", (1.0,), (1.5,), (2.0,))),
    "vol_trend": (vol_trend, _each("fast slow window", (20, 50, 100), (50, 200, 100))),
    "vol_reversion": (vol_reversion, _each("period num_std window", (20, 2.0, 100))),
    "drift_rider": (drift_rider, _each("n", (200,), (50,))),
    "always_long": (always_long, [{}]),
    "ensemble": (ensemble, _each("k", (3,), (4,), (5,))),
    "adaptive_rsi": (adaptive_rsi, _each("window q_low q_high", (250, 0.1, 0.9), (250, 0.05, 0.95))),
    "range_fade": (range_fade, _each("n low high", (14, 0.1, 0.9), (14, 0.05, 0.95))),
    "tri_ma": (tri_ma, _each("fast mid slow", (5, 20, 50), (9, 21, 50), (20, 50, 200))),
    "tri_ma_vol": (tri_ma_vol, _each("fast mid slow vol_mult", (5, 20, 50, 1.0), (9, 21, 50, 1.5), (20, 50, 200, 1.0))),
    "rsi_ma_vol": (rsi_ma_vol, [*_each("style n mid vol_mult", ("pro", 50, 50, 1.0), ("pro", 200, 55, 1.0)), *_each("style n dip vol_mult", ("dip", 50, 40, 1.0), ("dip", 200, 35, 1.5))]),
    "overnight": (overnight, _each("mode n", ("overnight", 5), ("overnight", 20), ("tug", 5), ("tug", 20))),
    "turn_of_month": (turn_of_month, _each("before after rest", (1, 3, "flat"), (1, 3, "short"), (2, 2, "short"))),
    "low_vol_reversal": (low_vol_reversal, _each("n vol_window vol_mult", (5, 20, 1.0), (10, 20, 0.8))),
    "near_52w": (near_52w, _each("n band", (252, 0.02), (252, 0.05))),
}


#: What the rules of a family read of ``folds.with_folds``; the others read none of it.
READS = {
    "ema_cross": ("ema",), "rsi_reversion": ("rsi",), "rsi_pro_trend": ("rsi",), "gap_fade": ("atr",), "vol_trend": ("ema", "atr"), "vol_reversion": ("atr",), "ensemble": ("ema", "macd", "supertrend"),
    "adaptive_rsi": ("rsi",), "rsi_ma_vol": ("rsi",),
}


def reads(families) -> tuple[str, ...]:
    """What the rules of some families read of ``folds.with_folds``, for its ``want``."""
    return tuple(sorted({x for f in families for x in READS.get(f, ())}))


def label(family: str, params: dict) -> str:
    return f"{family}[{','.join(f'{k}={v}' for k, v in params.items())}]"


def configs(families=None) -> list[tuple[str, str, dict]]:
    """(label, family, parameters) of all configurations, in the grid's order."""
    return [(label(f, p), f, p) for f, (_, grid) in GRID.items() if families is None or f in families for p in grid]


def changes() -> dict[str, Column]:
    """step (change of the close), r (its relative change), night and tug (overnight return, and what it leads the session's by)."""
    night = O() / lag("close") - 1
    return {"step": C() - lag("close"), "r": change(1), "night": night, "tug": night - (C() / O() - 1)}


def prepare(bars: DataFrame) -> DataFrame:
    """Adds what several rules read: ``changes``, and atrp where there is an ``atr``."""
    out = bars.withColumns(changes())
    return out.withColumn("atrp", ATR() / C()) if "atr" in bars.columns else out


def stances(bars: DataFrame, chosen=None, grid: dict | None = None) -> DataFrame:
    """Bars with one column for each configuration, named by its label; ``chosen`` as of ``configs``, families as in ``grid``."""
    chosen, prepared = configs() if chosen is None else chosen, prepare(bars)
    with Shared() as shared:
        made = [(grid or GRID)[f][0](**p).cast("int").alias(name) for name, f, p in chosen]
    return shared.on(prepared).select(*prepared.columns, *made)


def unpivot(frame: DataFrame, names: list[str], ids: list[str]) -> DataFrame:
    """(ids, config, stance) in long form."""
    pairs = F.array(*(F.struct(F.lit(n).alias("config"), F.col(f"`{n}`").alias("stance")) for n in names))
    return frame.select(*ids, F.inline(pairs))


# ---------------------------------------------------------------- the accuracy harness


def regime() -> Column:
    """1 above a rising pair of averages of 50 and 200 bars, -1 below a falling pair, else 0."""
    quick, slow = sma("close", 50), sma("close", 200)
    return choose((C() > quick) & (quick > slow), (C() < quick) & (quick < slow))


def _macd() -> Column:
    return sign(F.col("macd") - F.col("macd_signal"))


def _all_same(*stances: Column) -> Column:
    """The stance that all agree on, else 0."""
    return choose(*(_every([s == x for s in stances]) for x in (1, -1)))


def _every(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


INDICATORS = {
    "rsi_reversion": lambda: rsi_reversion(30, 70),
    "ema_cross": lambda: ema_cross(9, 21),
    "sma_cross": lambda: sign(sma("close", 50) - sma("close", 200)),
    "macd": _macd,
    "boll_reversion": lambda: boll_reversion(),
    "boll_breakout": lambda: -boll_reversion(),
    "supertrend": lambda: F.col("supertrend_dir"),
    "price_vs_sma200": lambda: sign(C() - sma("close", 200)),
    "momentum_20": lambda: momentum(20),
}


def _when_flat(stance: Column) -> Column:
    return F.when(regime() == 0, stance).otherwise(0)


CONFLUENCE = {
    "pullback_in_trend": lambda: choose((regime() == 1) & (RSI() < 40), (regime() == -1) & (RSI() > 60)),
    "triple_trend": lambda: _all_same(ema_cross(9, 21), _macd(), F.col("supertrend_dir")),
    "reversion_in_range": lambda: _when_flat(boll_reversion()),
    "rsi_in_range": lambda: _when_flat(rsi_reversion(30, 70)),
    "trend_volume": lambda: F.when(busy(), _all_same(regime(), ema_cross(9, 21))).otherwise(0),
}


# ---------------------------------------------------------------- tradeable signals


def mean_reversion(low=30, high=70) -> Column:
    lower, upper = bollinger()
    return choose((C() < lower) & (RSI() < low), (C() > upper) & (RSI() > high))


def pullback_in_trend(dip=40, rip=60) -> Column:
    quick, slow = sma("close", 50), sma("close", 200)
    return choose((C() > slow) & (quick > slow) & (RSI() < dip), (C() < slow) & (quick < slow) & (RSI() > rip))


def opening_range_breakout(bars=6) -> Column:
    hi, lo, number = opening_range(bars)
    later = number > bars
    return F.when(later & (C() < lo), -1).when(later & (C() > hi), 1).otherwise(0)


TRADEABLE = {"mean_reversion": mean_reversion, "rsi": lambda: rsi_reversion(30, 70), "pullback_in_trend": pullback_in_trend, "candidate": lambda: rsi_ma_vol("dip", 200, 1.5, dip=35)}


def signals(frame: DataFrame, stance: Column, keep=("symbol", "ts")) -> DataFrame:
    """The signal columns of a stance: score, direction, confidence, entered."""
    d = F.col("_stance")
    return frame.withColumn("_stance", stance.cast("int")).select(*keep, d.cast("double").alias("score"), d.alias("direction"), F.when(d != 0, 1.0).otherwise(0.0).alias("confidence"), (d != 0).alias("entered"))


def random_signals(bars: DataFrame, p: float, seed: int) -> DataFrame:
    """Entries with probability ``p`` and a fair direction, by a hash of symbol, time and seed: the same on every run."""
    draw = lambda salt: F.pmod(F.xxhash64("symbol", F.col("ts").cast("string"), F.lit(seed), F.lit(salt)), F.lit(1_000_000)) / 1_000_000
    return signals(bars, F.when(draw(0) < p, F.when(draw(1) < 0.5, 1).otherwise(-1)).otherwise(0))


def daily_quota(bars: DataFrame, per_day: int, seed: int) -> DataFrame:
    """At each time ``per_day`` symbols (or all there are) in a random direction."""
    rank = F.row_number().over(Window.partitionBy("ts").orderBy(F.xxhash64("symbol", F.col("ts").cast("string"), F.lit(seed)), "symbol"))
    side = F.when(F.pmod(F.xxhash64("symbol", F.col("ts").cast("string"), F.lit(seed + 1)), F.lit(2)) == 0, 1).otherwise(-1)
    ranked = bars.select("symbol", "ts", rank.alias("_rank"))
    return signals(ranked, F.when(F.col("_rank") <= per_day, side).otherwise(0))
