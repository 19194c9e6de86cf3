"""The trade ledger: filters, roll-ups and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_rollup(trades: DataFrame, mode: str) -> DataFrame:
    """(day, realized_pnl, trades_count, halted, mode) of closed trades; made anew each time, not appended."""
    closed = trades.where((F.col("mode") == mode) & F.col("exit_time").isNotNull())
    return closed.groupBy(F.to_date("exit_time").alias("day")).agg(F.round(F.sum("pnl"), 2).alias("realized_pnl"), F.count("*").alias("trades_count")).withColumns({"halted": F.lit(False), "mode": F.lit(mode)})


def without_mode(trades: DataFrame, mode: str) -> DataFrame:
    """What a reset of a mode's session leaves."""
    return trades.where(F.col("mode") != mode)


def recent(trades: DataFrame, days: int) -> DataFrame:
    """Trades that closed in the ``days`` calendar days that end with the latest close."""
    latest = trades.agg(F.max("exit_time").alias("_last"))
    return trades.join(F.broadcast(latest)).where(F.col("exit_time") >= F.date_sub(F.to_date("_last"), days - 1)).drop("_last")


def latest_rows(rows: DataFrame, n: int, by: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(by)).limit(min(n, 500))


def bar_heights(daily: DataFrame) -> DataFrame:
    """(day, realized_pnl, height): days in order with heights in per cent of the largest, 6 at least."""
    most = daily.agg(F.max(F.abs("realized_pnl")).alias("_most"))
    height = F.greatest(F.lit(6.0), F.abs("realized_pnl") / F.nullif("_most", F.lit(0.0)) * 100)
    return daily.join(F.broadcast(most)).select("day", "realized_pnl", height.alias("height"))


def heat_map(daily: DataFrame) -> DataFrame:
    """(week, weekday, realized_pnl, intensity): weeks from Sunday on; intensity relative to the largest day."""
    most = daily.agg(F.max(F.abs("realized_pnl")).alias("_most"))
    weekday = F.dayofweek("day") - 1
    return daily.join(F.broadcast(most)).select(F.date_sub("day", weekday).alias("week"), weekday.alias("weekday"), "realized_pnl", (F.abs("realized_pnl") / F.nullif("_most", F.lit(0.0))).alias("intensity"))


def downsample(bars: DataFrame, most: int = 1500) -> DataFrame:
    """Every k-th bar of a symbol with more than ``most``, k = n div most: what a chart draws."""
    every = Window.partitionBy("symbol")
    rows = bars.withColumns({"_i": F.row_number().over(every.orderBy("ts")) - 1, "_n": F.count("*").over(every)})
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return rows.where((F.col("_n") <= most) | (F.col("_i") % step == 0)).drop("_i", "_n")


def tail(bars: DataFrame, n: int) -> DataFrame:
    back = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return bars.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= n).drop("_r")


def market_open(ts, open_: str = "09:15", close: str = "15:30") -> "F.Column":
    return ~F.dayofweek(ts).isin(1, 7) & F.date_format(ts, "HH:mm:ss").between(f"{open_}:00", f"{close}:00")


def trading_days(bars: DataFrame, holidays: DataFrame) -> DataFrame:
    """Bars of weekdays that are no holidays (``holidays`` has ``day``)."""
    week = bars.where(~F.dayofweek("ts").isin(1, 7)).withColumn("_day", F.to_date("ts"))
    return week.join(F.broadcast(holidays.select(F.col("day").alias("_day"))), "_day", "left_anti").drop("_day")
