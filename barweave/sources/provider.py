"""Bars of a remote provider as a Spark data source, with the provider's answers recorded in files.

    spark.dataSource.register(ProviderBars)
    spark.read.format("provider_bars").option("path", folder).option("interval", "day").load().where("symbol = 'INFY'")

An answer is a JSON object a bar, in files under ``ticker=<ticker>/interval=<code>``: the time in ``Datetime`` or ``Date``, and columns that
may have a second header, the ticker (``{"Open": {"INFY.NS": 1.0}}``). Each file of a ticker is read by a task of its own. Conditions on
the symbol choose the tickers, those on the time narrow the request; both happen before anything is read.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from barweave.sources.tables import OHLCV, qualify

#: The provider's code of an interval, and the longest period in days that it serves (None: no limit).
CODES = {"minute": ("1m", 7), "3minute": ("3m", 60), "5minute": ("5m", 60), "10minute": ("10m", 60), "15minute": ("15m", 60), "30minute": ("30m", 60), "60minute": ("60m", 730), "day": ("1d", None)}
SUFFIX = ".NS"
SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
ROWS = pa.schema([("symbol", pa.string()), ("ts", pa.timestamp("us")), *((c, pa.float64()) for c in OHLCV)])


def code_of(interval: str) -> tuple[str, int | None]:
    """The provider's code and cap of an interval, or ValueError before anything is read."""
    if interval not in CODES:
        raise ValueError(f"unknown interval {interval!r}; one of {', '.join(CODES)}")
    return CODES[interval]


def days_of(period: str | None, cap: int | None) -> int | None:
    """A period such as ``60d``, ``2y`` or ``max`` in days, never more than the cap; the cap if there is none."""
    if period is None or period == "max":
        return cap
    found = re.fullmatch(r"(\d+)(d|mo|y)", period)
    if not found:
        raise ValueError(f"unknown period {period!r}")
    days = int(found[1]) * {"d": 1, "mo": 30, "y": 365}[found[2]]
    return days if cap is None else min(days, cap)


def _time(x: str | None) -> dt.datetime | None:
    return None if x is None else dt.datetime.fromisoformat(x)


@dataclass
class Answer(InputPartition):
    """A file of a ticker's answer and the range of times that is wanted of it."""

    symbol: str
    path: str
    start: dt.datetime | None
    end: dt.datetime | None


class ProviderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.code, self.cap = code_of(options.get("interval", "day"))
        self.path, self.named = options["path"], options.get("symbols")
        self.start, self.end = _time(options.get("start")), _time(options.get("end"))
        self.wanted: set[str] | None = {s.strip() for s in self.named.split(",")} if self.named else None
        self.filtered: set[str] | None = None
        if options.get("period") or not (self.start or self.end):
            days = days_of(options.get("period"), self.cap)
            if days is not None:
                now = _time(options.get("asof")) or dt.datetime.now()
                self.start, self.end = now - dt.timedelta(days=days), self.end

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("symbol",):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.filtered = some if self.filtered is None else self.filtered & some
                continue
            if getattr(f, "attribute", None) == ("ts",) and isinstance(getattr(f, "value", None), dt.datetime):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.start = max(self.start or f.value, f.value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.end = min(self.end or f.value, f.value)
            yield f  # bounds here include their end

    def partitions(self) -> list[Answer]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        known = {unquote(x.base_name.removeprefix("ticker=")): x.path for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.base_name.startswith("ticker=")}
        wanted = self.wanted if self.wanted is not None else {t.removesuffix(SUFFIX) for t in known}
        out = []
        for symbol in sorted(wanted if self.filtered is None else wanted & self.filtered):
            ticker = symbol if "." in symbol or symbol.startswith("^") else symbol + SUFFIX
            folder = f"{known.get(ticker, root + '/none')}/interval={self.code}"
            files = [x.path for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.is_file and x.base_name.endswith(".json")]
            if not files and self.wanted is not None:
                raise RuntimeError(f"no data returned for {ticker} @ {self.code}")
            out += [Answer(symbol, path, self.start, self.end) for path in sorted(files)]
        return out

    def read(self, partition: Answer) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        with store.open_input_stream(partition.path) as file:
            for batch in json.open_json(file):
                yield from _bars(batch, partition)


def _bars(batch: pa.RecordBatch, of: Answer) -> Iterator[pa.RecordBatch]:
    """Bars of a piece of an answer: one header, lower case, the columns that are asked for, no nulls, in range."""
    columns = {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        columns[name.lower()] = column.field(0) if pa.types.is_struct(column.type) else column
    time = columns.get("datetime", columns.get("date"))
    missing = [c for c in OHLCV if c not in columns] + ["datetime"] * (time is None)
    if missing:
        raise RuntimeError(f"the answer for {of.symbol} lacks {', '.join(missing)}")
    if not pa.types.is_timestamp(time.type):
        time = pc.strptime(time, format="%Y-%m-%d %H:%M:%S", unit="us")
    time = time.cast(pa.timestamp("us"))
    rows = pa.record_batch([pa.array([of.symbol] * len(time), pa.string()), time, *(columns[c].cast(pa.float64()) for c in OHLCV)], schema=ROWS)
    keep = pc.and_(pc.is_valid(time), pa.array([True] * len(time)))
    for c in OHLCV:
        keep = pc.and_(keep, pc.invert(pc.fill_null(pc.is_nan(rows[c]), True)))
    if of.start is not None:
        keep = pc.and_(keep, pc.greater_equal(time, pa.scalar(of.start, pa.timestamp("us"))))
    if of.end is not None:
        keep = pc.and_(keep, pc.less_equal(time, pa.scalar(of.end, pa.timestamp("us"))))
    yield rows.filter(keep)


class ProviderBars(DataSource):
    """Options: path, interval (default day), symbols (comma-separated; default all that is recorded), start and end, or period, and asof,
    the time at which the request counts as made. Without start, end and period, and with a longer period, the cap of the interval holds."""

    @classmethod
    def name(cls) -> str:
        return "provider_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ProviderReader:
        return ProviderReader(self.options)


def provider_bars(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Bars of recorded answers under ``path``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProviderBars)
    return spark.read.format("provider_bars").options(path=path, **options).load()


def record(bars: DataFrame, path: str, interval: str) -> None:
    """Writes bars as the provider would answer: a folder for each ticker and interval, two headers."""
    ticker = qualify(F.col("symbol"))
    named = {c.capitalize(): F.create_map(F.col("ticker"), F.col(c)) for c in OHLCV}
    rows = bars.withColumn("ticker", ticker).select("ticker", F.lit(code_of(interval)[0]).alias("interval"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Datetime"), *(x.alias(n) for n, x in named.items()))
    rows.write.mode("append").partitionBy("ticker", "interval").option("ignoreNullFields", "false").json(path)
