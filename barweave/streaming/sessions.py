"""Bars and session signals from ticks with keyed state of our own.

State of a symbol: its open bars by start, the range of its day's first bars as a list, and the day with its number of closed bars. Ticks
become parts of the bar of their event time where they are read, so that what is shuffled and what a symbol's task merges is a row a bar
and batch, not a row a tick. A timer closes the bar when the watermark passes its end, in order of time. A new day clears the range
and the count. A symbol without open bars for ``idle`` minutes of event time loses all its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIGNALS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, day_bar long, stance int"
DAY = 86_400_000
BAR = "first_ts long, first_id long, open double, high double, low double, last_ts long, last_id long, close double, volume double"
PART = [column.split()[0] for column in BAR.split(", ")]


def merged(a: tuple | None, b: tuple) -> tuple:
    """Two parts of one bar as one, whatever their order."""
    if a is None:
        return b
    first, last = min(a, b, key=lambda x: x[:2]), max(a, b, key=lambda x: x[5:7])
    return (*first[:3], max(a[3], b[3]), min(a[4], b[4]), *last[5:8], a[8] + b[8])


def parts(ticks: pd.DataFrame, size: int) -> pd.DataFrame:
    """One row a symbol and bar of some ticks, whose times ``us`` are in microseconds with an order ``event_id`` among equals."""
    ticks = ticks.sort_values(["symbol", "us", "event_id"])
    ticks["start"] = ticks["us"] // 1000 // size * size
    bar = ["symbol", "start"]
    first, last = ticks.drop_duplicates(bar), ticks.drop_duplicates(bar, keep="last")
    over = ticks.groupby(bar, sort=False).agg(high=("price", "max"), low=("price", "min"), volume=("volume", "sum"))
    values = {
        "first_ts": first["us"], "first_id": first["event_id"], "open": first["price"], "high": over["high"], "low": over["low"],
        "last_ts": last["us"], "last_id": last["event_id"], "close": last["price"], "volume": over["volume"],
    }
    return pd.DataFrame({c: first[c].to_numpy() for c in bar} | {c: v.to_numpy() for c, v in values.items()})


class SessionBars(StatefulProcessor):
    """Closed bars with their number in the day, and a stance: 1 or -1 if the close is beyond the range of the day's first bars."""

    def __init__(self, minutes: int, first: int, idle: int):
        self.size, self.first, self.idle = 60_000 * minutes, first, 60_000 * idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open_bars = handle.getMapState("open_bars", "start long", BAR)
        self.range = handle.getListState("range", "high double, low double")
        self.day = handle.getValueState("day", "day long, bars long")
        self.seen = handle.getValueState("seen", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        watermark, latest = timerValues.getCurrentWatermarkInMs(), -1
        found: dict[int, tuple] = {}
        for frame in rows:
            for start, *part in frame[["start", *PART]].itertuples(index=False, name=None):
                if start + self.size > watermark:  # a tick of a bar that is closed comes too late
                    found[start] = merged(found.get(start), tuple(part))
            latest = max(latest, int(frame["last_ts"].max()) // 1000)
        for start, part in found.items():
            known = self.open_bars.getValue((start,)) if self.open_bars.containsKey((start,)) else None
            if known is None:
                self.handle.registerTimer(start + self.size)
            self.open_bars.updateValue((start,), merged(known and tuple(known), part))
        before = self.seen.get()[0] if self.seen.exists() else -1
        if latest > before:
            self.seen.update((latest,))
            self.handle.registerTimer(latest + self.idle)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark = timerValues.getCurrentWatermarkInMs()
        due = sorted(k[0] for k in self.open_bars.keys() if k[0] + self.size <= watermark)
        out = [self._closed(key[0], start) for start in due]
        idle = self.seen.exists() and self.seen.get()[0] + self.idle <= watermark
        if idle and not any(True for _ in self.open_bars.keys()):
            for state in (self.open_bars, self.range, self.day, self.seen):
                state.clear()
        yield pd.DataFrame(out, columns=["symbol", "ts", "open", "high", "low", "close", "volume", "day_bar", "stance"]).astype({"day_bar": "int64", "stance": "int32"}) if out else pd.DataFrame()

    def _closed(self, symbol: str, start: int) -> tuple:
        _, _, open_, high, low, _, _, close, volume = self.open_bars.getValue((start,))
        self.open_bars.removeKey((start,))
        day, bars = self.day.get() if self.day.exists() else (None, 0)
        if day != start // DAY:
            self.range.clear()
            day, bars = start // DAY, 0
        bars += 1
        self.day.update((day, bars))
        stance = 0
        if bars <= self.first:
            self.range.appendValue((high, low))
        else:
            ranges = list(self.range.get())
            stance = 1 if close > max(r[0] for r in ranges) else -1 if close < min(r[1] for r in ranges) else 0
        return symbol, pd.Timestamp(start, unit="ms", tz="UTC"), open_, high, low, close, volume, bars, stance


def session_bars(ticks: DataFrame, minutes: int = 60, first: int = 6, late: str = "10 minutes", idle: int = 7 * 24 * 60) -> DataFrame:
    """Closed bars of a stream of ticks (symbol, price, volume, ts, event_id) with day_bar and stance; ticks without a symbol, time or
    price take no part, and a missing volume counts as 0. A tick that is later than ``late`` may count while its bar is open. The keyed
    state needs Spark's RocksDB store, which the session is set to."""
    ticks.sparkSession.conf.set(PROVIDER, ROCKS)
    processor = SessionBars(minutes, first, idle)
    size = processor.size

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield parts(frame, size)

    rows = ticks.where("symbol is not null and ts is not null and price is not null").select("symbol", F.unix_micros("ts").alias("us"), "event_id", "price", F.coalesce("volume", F.lit(0.0)).alias("volume"))
    bars = rows.mapInPandas(partial, f"symbol string, start long, {BAR}").withColumn("ts", F.timestamp_micros("last_ts")).withWatermark("ts", late)
    return bars.groupBy("symbol").transformWithStateInPandas(processor, SIGNALS, "Append", "EventTime")
