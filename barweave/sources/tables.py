"""Market tables derived from the driver's tables, and readers and writers of bars.

Bars are long: symbol, ts, open, high, low, close, volume. Every reader passes an explicit schema or reads Parquet, so filters and
columns reach the scan.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OHLCV = ("open", "high", "low", "close", "volume")
BAR_SCHEMA = T.StructType([T.StructField("ts", T.TimestampNTZType())] + [T.StructField(c, T.DoubleType()) for c in OHLCV])
#: Interval codes and the longest period, in days, that a remote source serves (None: no limit).
INTERVALS = {"1m": 7, "5m": 60, "15m": 60, "30m": 60, "60m": 730, "day": None, "week": None}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_bars(prices: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Bars of (price, volume) rows: one hash aggregation, partial before its shuffle."""
    rank = F.struct(*order)
    return prices.groupBy(*keys).agg(
        F.min_by("price", rank).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", rank).alias("close"), F.sum("volume").alias("volume")
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of ``lineitem``: a symbol is a part type; parts are the small side of the join."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("symbol"))
    line = read(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    rows = line.join(part, line.l_partkey == part.p_partkey).select("symbol", F.col("l_shipdate").alias("ts"), "price", F.col("l_quantity").alias("volume"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return to_bars(rows, ["symbol", "ts"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, price, volume, ts) of ``events``; the volume is a field of the JSON column."""
    events = read(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def intraday_bars(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """Bars of ``minutes`` from ticks, by buckets aligned to the epoch."""
    seconds = 60 * minutes
    bucket = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / seconds) * seconds)
    rows = ticks(spark, sf_dir).withColumn("bucket", bucket)
    bars = to_bars(rows, ["symbol", "bucket"], ["ts", "event_id"])
    return bars.withColumnRenamed("bucket", "ts")


def qualify(symbol):
    """An index (``^…``) or a name with a dot stays; any other gets the exchange's suffix."""
    return F.when(symbol.contains(".") | symbol.startswith("^"), symbol).otherwise(F.concat(symbol, F.lit(".NS")))


def check_interval(interval: str) -> str:
    """The interval, or ValueError before anything is read."""
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval!r}; one of {', '.join(INTERVALS)}")
    return interval


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``; a local session may do with a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def in_range(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from ``start`` to ``end``, both included; a bound that is only a date covers its whole day."""
    if start:
        bars = bars.where(F.col("ts") >= F.to_timestamp_ntz(F.lit(start)))
    if end:
        day = len(end) == 10
        bars = bars.where(F.col("ts") < F.to_timestamp_ntz(F.lit(end)) + F.expr("interval 1 day")) if day else bars.where(F.col("ts") <= F.to_timestamp_ntz(F.lit(end)))
    return bars


class BarStore:
    """Bars kept in Parquet by interval and symbol, filled on a miss from ``fetch(symbol, interval)``.

    The range is a filter on read, not part of the key, so a first narrow request can't be served for a later wide one.
    """

    def __init__(self, spark: SparkSession, path: str, fetch=None):
        self.spark, self.path, self.fetch = spark, path.rstrip("/"), fetch

    def _place(self, symbol: str, interval: str) -> str:
        return f"{self.path}/interval={interval}/symbol={symbol.replace('/', '_')}"

    def put(self, symbol: str, interval: str, bars: DataFrame) -> None:
        bars.select("ts", *OHLCV).na.drop("any").write.mode("overwrite").parquet(self._place(symbol, interval))

    def get(self, symbol: str, interval: str, start: str | None = None, end: str | None = None, refresh: bool = False) -> DataFrame:
        check_interval(interval)
        reader = self.spark.read.schema(BAR_SCHEMA)
        try:
            if refresh:
                raise FileNotFoundError
            bars = reader.parquet(self._place(symbol, interval))
            bars.schema  # noqa: B018  the path is resolved here
        except Exception:
            if self.fetch is None:
                raise
            self.put(symbol, interval, self.fetch(symbol, interval))
            bars = reader.parquet(self._place(symbol, interval))
        return in_range(bars, start, end).withColumn("symbol", F.lit(symbol))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars of CSV files with a header and the time first; rows with a null are dropped."""
    return spark.read.schema(BAR_SCHEMA).option("header", True).csv(path).na.drop("any")


def write_csv(bars: DataFrame, path: str) -> None:
    bars.select("ts", *OHLCV).write.mode("overwrite").option("header", True).csv(path)
