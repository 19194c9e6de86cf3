"""Recursive indicators: averages that carry a state from bar to bar, as scans over slabs of time.

An exponential average is an affine step, ``x -> a * x + b``, and steps compose. A symbol's bars are dealt to tasks by slabs of days and,
within them, units of a few hundred rows. Running sums give what a unit's bars make of an empty state and how much of the state before
is left; the units' last rows, a few numbers each, are composed in order of time; and every row adds what is left of the state that its
unit begins with. Only Supertrend, whose bands depend on comparisons with themselves, walks a symbol's history bar by bar.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMAS = (9, 12, 20, 21, 26, 50, 200)
#: What ``with_folds`` can add.
ALL = ("ema", "macd", "rsi", "atr", "supertrend")
#: Days of a slab, rows of a unit, and the least share of a state that a bar may leave, so weights within a unit stay in range.
SLAB_DAYS, UNIT, LEAST = 128, 512, 0.25


def _scans(emas, want, rsi_n: int, atr_n: int, wide_n: int) -> dict[str, tuple[str, float]]:
    """By name: the column that is averaged, and the weight of a new value."""
    spans = {*(emas if "ema" in want else ()), *((12, 26) if "macd" in want else ())}
    out = {f"_e{n}": ("close", 2 / (n + 1)) for n in sorted(spans)}
    if "rsi" in want:
        out |= {"_gain": ("_up", 1 / rsi_n), "_loss": ("_down", 1 / rsi_n)}
    if "atr" in want:
        out["_atr"] = ("_tr", 1 / atr_n)
    if "supertrend" in want:
        out["_wide"] = ("_tr", 1 / wide_n)
    return out


def _decayed(value: Column, a: float, count: Column, run) -> Column:
    """The running sum of values, each worth ``a`` times as much with every count after it."""
    return F.pow(F.lit(a), count - 1) * F.sum(value * F.pow(F.lit(a), 1 - count)).over(run)


def _moves(high, low, close, before) -> dict[str, Column]:
    """Gain, loss and true range of a bar after a close; null without it, but for the range."""
    step = close - before
    return {"_up": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), "_down": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))), "_tr": F.greatest(high - low, F.abs(high - before), F.abs(low - before))}


def with_folds(bars: DataFrame, emas: tuple[int, ...] = EMAS, rsi_n: int = 14, atr_n: int = 14, supertrend_n: int = 10, supertrend_k: float = 3.0, want: tuple[str, ...] = ALL, slab_days: int = SLAB_DAYS, unit: int = UNIT) -> DataFrame:
    """``bars`` with those of ema_<n> (ema), macd, macd_signal, macd_hist (macd), rsi, atr, supertrend and supertrend_dir (supertrend) that
    are in ``want``, and ``_n``, a bar's number in its symbol from 0; without any, the bars as they are.

    Bars must be unique by symbol and ts. A bar with a null close leaves the averages of closes as they are; an average is null before
    its first value, which it takes whole.
    """
    scans = _scans(emas, want, rsi_n, atr_n, supertrend_n)
    if not scans:
        return bars
    if any(1 - w < LEAST for _, w in scans.values()):
        raise ValueError("an average over so few bars")
    slab = Window.partitionBy("symbol", "_slab").orderBy("ts")
    rows = bars.withColumn("_slab", F.floor(F.unix_date(F.to_date("ts")) / slab_days))
    rows = rows.withColumns({"_place": F.row_number().over(slab), "_before": F.lag("close").over(slab)})
    moves = _moves(F.col("high"), F.col("low"), F.col("close"), F.col("_before"))
    # The move of a slab's first bar depends on the slab before it; the composition adds it.
    rows = rows.withColumns({"_unit": F.floor((F.col("_place") - 1) / unit), **{x: F.when(F.col("_place") > 1, m) for x, m in moves.items()}})
    run = Window.partitionBy("symbol", "_slab", "_unit").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    counted = {x: f"_k{x}" for x in dict.fromkeys(x for x, _ in scans.values())}
    rows = rows.withColumns({k: F.count(x).over(run) for x, k in counted.items()})
    local = {name: _decayed(F.coalesce(F.col(x), F.lit(0.0)) * w, 1 - w, F.col(counted[x]), run) for name, (x, w) in scans.items()}
    rows = rows.withColumns(local)
    left = {name: F.pow(F.lit(1 - w), F.col(counted[x])) for name, (x, w) in scans.items()}
    signal = "macd" in want
    if signal:  # it averages the difference of two averages, so its state takes in what is left of theirs
        there = F.when(F.col("close").isNotNull(), 0.2).otherwise(0.0)
        n = F.col(counted["close"])
        rows = rows.withColumns({"_sig": _decayed((F.col("_e12") - F.col("_e26")) * there, 0.8, n, run), "_sig12": _decayed(left["_e12"] * there, 0.8, n, run), "_sig26": _decayed(left["_e26"] * there, 0.8, n, run)})
        left["_sig"] = F.pow(F.lit(0.8), n)
    states = _states(rows, bars.columns, scans, counted, left, signal)
    rows = rows.join(states, rows["symbol"].eqNullSafe(states["_s"]) & rows["_slab"].eqNullSafe(states["_b"]) & (rows["_unit"] == states["_u"]))
    first = (F.col("_begin.n") == 0) & (F.col("_place") == 1)
    full = {}
    for name, (x, _) in scans.items():
        value = F.when(F.col(f"_begin.{counted[x]}") + F.col(counted[x]) > 0, F.col(name) + left[name] * F.col(f"_begin.{name}"))
        full[name] = F.when(first, F.col("close")).otherwise(value) if x == "close" else value
    added = {f"ema_{n}": full[f"_e{n}"] for n in emas} if "ema" in want else {}
    if signal:
        line = F.col("_sig") + left["_sig"] * F.col("_begin._sig") + F.col("_sig12") * F.col("_begin._e12") - F.col("_sig26") * F.col("_begin._e26")
        macd = full["_e12"] - full["_e26"]
        line = F.when(macd.isNotNull(), F.when(first, 0.0).otherwise(line))
        added |= {"macd": macd, "macd_signal": line, "macd_hist": macd - line}
    if "rsi" in want:
        added["rsi"] = F.coalesce(100 - 100 / (1 + full["_gain"] / F.nullif(full["_loss"], F.lit(0.0))), F.lit(100.0))
    if "atr" in want:
        added["atr"] = full["_atr"]
    if "supertrend" in want:
        added["_wide"] = full["_wide"]
    out = rows.select(*bars.columns, *(x.alias(c) for c, x in added.items()), (F.col("_begin.n") + (F.col("_place") - 1) % unit).alias("_n"))
    return _with_supertrend(out, supertrend_k) if "supertrend" in want else out


def _states(rows: DataFrame, columns: list[str], scans: dict, counted: dict, left: dict, signal: bool) -> DataFrame:
    """(_s, _b, _u, _begin): what each unit of a symbol begins with, its number of bars so far, of values so far, and the states, with the
    move of a slab's first bar in them. The units of a symbol are in one array: a bar in some hundreds, or one a slab."""
    names = [*scans, *(["_sig"] if signal else [])]
    ends = [*(F.col(x).alias(f"b{x}") for x in names), *(left[x].alias(f"a{x}") for x in names), *(F.col(k) for k in counted.values()), *([F.col("_sig12"), F.col("_sig26")] if signal else [])]
    # All columns of the bars, so that this branch can share the shuffle of the other.
    last = F.max_by(F.struct(*columns, *ends), "_place").alias("last")
    begins = {x: F.min_by(x, F.when(F.col(x).isNotNull(), F.col("_place"))).alias(f"f{x}") for x in counted}
    units = rows.groupBy("symbol", "_slab", "_unit").agg(last, F.count("*").alias("rows"), F.min_by(F.struct("high", "low", "close"), "_place").alias("first"), *begins.values())
    units = units.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("_slab", "_unit", F.struct("last", "rows", "first", *(f"f{x}" for x in counted)).alias("v")))).alias("units"))
    kind = "struct<" + ",".join(["n:bigint", *(f"{k}:bigint" for k in counted.values()), *(f"{x}:double" for x in names)]) + ">"
    zero = F.struct(F.lit(0).cast("long").alias("n"), *(F.lit(0).cast("long").alias(k) for k in counted.values()), *(F.lit(0.0).alias(x) for x in names))
    start = F.struct(F.array().cast(f"array<struct<b:bigint,u:bigint,s:{kind}>>").alias("out"), zero.alias("now"), F.lit(None).cast("double").alias("close"))

    def step(acc, unit):
        now, v = acc["now"], unit["v"]
        opens = (unit["_unit"] == 0)
        moved = {x: F.when(opens, m) for x, m in _moves(v["first"]["high"], v["first"]["low"], v["first"]["close"], acc["close"]).items()}
        begin = {"n": now["n"]}
        for x, k in counted.items():
            begin[k] = now[k] + (moved[x].isNotNull().cast("long") if x in moved else F.lit(0).cast("long"))
        for name, (x, w) in scans.items():
            empty = F.coalesce(v[f"f{x}"], F.lit(0.0))
            held = F.when(now[counted[x]] == 0, empty).otherwise(now[name])
            begin[name] = F.coalesce(F.when(now[counted[x]] == 0, moved[x]).otherwise((1 - w) * now[name] + w * moved[x]), held) if x in moved else held
        if signal:
            begin["_sig"] = now["_sig"]
        after = {"n": now["n"] + v["rows"]} | {k: begin[k] + v["last"][k] for k in counted.values()} | {x: v["last"][f"b{x}"] + v["last"][f"a{x}"] * begin[x] for x in scans}
        if signal:
            after["_sig"] = v["last"]["b_sig"] + v["last"]["a_sig"] * begin["_sig"] + v["last"]["_sig12"] * begin["_e12"] - v["last"]["_sig26"] * begin["_e26"]
        packed = lambda d: F.struct(*(d[c].alias(c) for c in ["n", *counted.values(), *names]))
        row = F.struct(unit["_slab"].alias("b"), unit["_unit"].alias("u"), packed(begin).alias("s"))
        return F.struct(F.concat(acc["out"], F.array(row)).alias("out"), packed(after).alias("now"), v["last"]["close"].alias("close"))

    found = units.select(F.col("symbol").alias("_s"), F.explode(F.aggregate("units", start, step, lambda acc: acc["out"])).alias("x"))
    return found.select("_s", F.col("x.b").alias("_b"), F.col("x.u").alias("_u"), F.col("x.s").alias("_begin"))


def turns(high: np.ndarray, low: np.ndarray, close: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, direction) of bands ``width`` above and below the middle of a bar. A band moves only towards the price unless the last close
    was beyond it; a close beyond the last band turns the direction."""
    middle = (high + low) / 2
    upper, lower = middle + width, middle - width
    line, turn = np.empty(len(close)), np.ones(len(close), np.int32)
    top = bottom = 0.0
    for i, c in enumerate(close):
        if i == 0:
            top, bottom, line[0] = upper[0], lower[0], lower[0]
            continue
        turn[i] = 1 if c > top else -1 if c < bottom else turn[i - 1]
        last = close[i - 1]
        top = upper[i] if upper[i] < top or last > top else top
        bottom = lower[i] if lower[i] > bottom or last < bottom else bottom
        line[i] = bottom if turn[i] > 0 else top
    return line, turn


def _with_supertrend(frame: DataFrame, k: float) -> DataFrame:
    """Adds supertrend and supertrend_dir; a symbol's history is one group."""
    kept = [f for f in frame.schema if f.name != "_wide"]
    schema = T.StructType([*kept, T.StructField("supertrend", T.DoubleType()), T.StructField("supertrend_dir", T.IntegerType())])

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", ignore_index=True)
        rows["supertrend"], rows["supertrend_dir"] = turns(*(rows[c].to_numpy(float) for c in ("high", "low", "close")), k * rows["_wide"].to_numpy(float))
        return rows[schema.names]

    return frame.groupBy("symbol").applyInPandas(walk, schema)
