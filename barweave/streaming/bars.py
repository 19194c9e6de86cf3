"""Bars from a stream of ticks, and a stateful consumer of bars.

Windows go by event time: a late tick within the watermark corrects its bar, a later one is dropped. A bar closes once the watermark
passes its end, so the last bar of a stream stays open, as it would on a live feed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tick_stream(spark: SparkSession, path: str) -> DataFrame:
    """Ticks of Parquet files of events as they appear in a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    events = spark.readStream.schema(schema).parquet(path)
    return events.select(F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def bars(ticks: DataFrame, size: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars; for a stream or a table."""
    rows = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    rank = F.struct("ts", "event_id")
    out = rows.groupBy("symbol", F.window("ts", size).alias("w")).agg(F.min_by("price", rank).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", rank).alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what there is and returns what it appended, from Parquet files under ``folder``."""
    to_files(stream, f"{folder}/rows", f"{folder}/checkpoint")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def frame(closed: DataFrame, now: DataFrame, include_current: bool = True) -> DataFrame:
    """Closed bars, and, if asked for, the newest bar of each symbol among ``now`` that is not closed yet; ``current`` tells them apart."""
    done = closed.withColumn("current", F.lit(False))
    if not include_current:
        return done
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    open_ = now.join(closed.select("symbol", "ts"), ["symbol", "ts"], "left_anti")
    return done.unionByName(open_.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r").withColumn("current", F.lit(True)))


def to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what a stream emits to Parquet files, once each, until it has read what there is."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def follow(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what a live stream emits to Parquet files, once each, and stops it when it has caught up. Unlike ``to_files`` it ends with
    a batch without rows, in which the last watermark closes what it can; a source of our own gets none from ``availableNow``."""
    running = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()


def bar_stream(spark: SparkSession, path: str) -> DataFrame:
    """Closed bars as they appear in a folder."""
    return spark.readStream.schema(BAR).parquet(path)


def each_batch(stream: DataFrame, act, checkpoint: str):
    """Hands every batch of closed bars to ``act(frame, batch_id)``."""
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EVENTS = "symbol string, ts timestamp, event string, price double, pnl double"


def breakout_positions(bars_: DataFrame, hold: int = 5) -> DataFrame:
    """A stateful consumer: by symbol, goes long when a close passes the last high, leaves at a close under the entry's low or after
    ``hold`` bars. State is four numbers a symbol."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_high, entry, floor, held = state.get if state.exists else (float("inf"), 0.0, 0.0, -1)
        out = []
        for b in pd.concat(list(frames)).sort_values("ts").itertuples(index=False):
            if held >= 0:
                held += 1
                if b.close < floor or held >= hold:
                    out.append((key[0], b.ts, "close", b.close, b.close - entry))
                    held = -1
            elif b.close > last_high:
                entry, floor, held = b.close, b.low, 0
                out.append((key[0], b.ts, "open", b.close, None))
            last_high = b.high
        state.update((last_high, entry, floor, held))
        yield pd.DataFrame(out, columns=["symbol", "ts", "event", "price", "pnl"])

    return bars_.groupBy("symbol").applyInPandasWithState(step, EVENTS, "last_high double, entry double, floor double, held int", "append", GroupStateTimeout.NoTimeout)


def distinct_payloads(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Payloads by hash, each once within the watermark."""
    return stream.withColumn("input_hash", F.sha2("payload", 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["input_hash"])
