"""Queries of connectors and of keyed stream state."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.plans import sqltext as q
from barweave.plans.catalogue import query
from barweave.plans.misc_q import BARS, CLOSED
from barweave.sources import feed, provider, tables
from barweave.streaming import bars as stream_bars
from barweave.streaming import sessions

# ---------------------------------------------------------------- a provider's answers

ASOF = "1998-08-02"
ORDER_BARS = """ob AS (SELECT trim(substr(o_orderpriority, 3)) AS symbol, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
  CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY ALL)"""


def order_bars(spark, d):
    """Daily bars of the orders of each priority."""
    rows = tables.read(spark, d, "orders").select(F.trim(F.substring("o_orderpriority", 3, 99)).alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"), "o_orderkey")
    return tables.to_bars(rows, ["symbol", "ts"], ["o_orderkey"])


@query("src3_provider_bars", q.with_(ORDER_BARS) + f"""SELECT '60minute' AS request, {BARS} FROM ob WHERE ts >= TIMESTAMP '{ASOF}' - INTERVAL 730 DAY
UNION ALL SELECT '15minute', {BARS} FROM ob WHERE ts >= TIMESTAMP '{ASOF}' - INTERVAL 60 DAY
UNION ALL SELECT 'day', {BARS} FROM ob WHERE symbol IN ('URGENT', 'LOW') AND ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1996-07-01'""")
def provider_bars(spark, d):
    """Answers recorded as a provider gives them, read through the data source: two requests without a period, which the interval's cap
    bounds, and one whose symbols and times are pushed into the request."""
    path = tables.shared_folder(spark, "provider")
    bars = order_bars(spark, d)
    for interval in ("day", "60minute", "15minute"):
        provider.record(bars, path, interval)
    asked = {i: provider.provider_bars(spark, path, interval=i, asof=ASOF) for i in ("60minute", "15minute", "day")}
    asked["day"] = asked["day"].where("symbol in ('URGENT', 'LOW') and ts >= timestamp_ntz '1995-01-01' and ts < timestamp_ntz '1996-07-01'")
    parts = [rows.select(F.lit(i).alias("request"), *BARS.split(", ")) for i, rows in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- a feed that stops and goes on


def fed_in_two(spark, d, run) -> None:
    """Records the first half of the ticks, or about that, as a feed, runs the stream to its end, records the rest and runs it again."""
    path, ticks = tables.shared_folder(spark, "feed"), tables.ticks(spark, d).where("symbol is not null and ts is not null")
    middle = ticks.select(F.timestamp_micros(F.percentile_approx(F.unix_micros("ts"), 0.5)).alias("m")).first().m
    for number, half in enumerate((F.col("ts") < F.lit(middle), F.col("ts") >= F.lit(middle))):
        feed.record_ticks(ticks.where(half), path, number, segments=4)
        run(feed.tick_feed(spark, path))


@query("src7_tick_feed", q.with_(q.intraday(), CLOSED) + f"SELECT {BARS} FROM bars_closed")
def tick_feed(spark, d):
    """Bars of a feed with offsets; the stream stops in the middle and goes on from its checkpoint."""
    folder = tables.shared_folder(spark, "fed")
    fed_in_two(spark, d, lambda ticks: stream_bars.follow(stream_bars.bars(ticks), f"{folder}/rows", f"{folder}/state"))
    rows = spark.read.schema(stream_bars.BAR).parquet(f"{folder}/rows")
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*BARS.split(", "))


SESSION = "n AS (SELECT *, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS day_bar FROM bars_closed)"
DAY_RANGE = "FILTER (day_bar <= 6) OVER (PARTITION BY symbol, CAST(ts AS DATE))"


@query("ss5_session_bars", q.with_(q.intraday(), CLOSED, SESSION) + f"SELECT {BARS}, day_bar, CASE WHEN day_bar > 6 AND close > max(high) {DAY_RANGE} THEN 1 WHEN day_bar > 6 AND close < min(low) {DAY_RANGE} THEN -1 ELSE 0 END AS stance FROM n")
def session_bars(spark, d):
    """Bars that timers close and their place in the day's opening range, from keyed state that is restored in the middle."""
    folder = tables.shared_folder(spark, "sessions")
    fed_in_two(spark, d, lambda ticks: stream_bars.follow(sessions.session_bars(ticks), f"{folder}/rows", f"{folder}/state"))
    rows = spark.read.schema(sessions.SIGNALS).parquet(f"{folder}/rows")
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*BARS.split(", "), "day_bar", "stance")
