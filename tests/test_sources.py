import pytest
from conftest import make_bars
from pyspark.sql import functions as F

from barweave.sources import tables
from barweave.streaming import bars as stream


def test_store_fetches_once_and_on_refresh(spark, tmp_path):
    calls = []

    def fetch(symbol, interval):
        calls.append(symbol)
        return make_bars(spark, [100.0 + i for i in range(10)], symbol)

    store = tables.BarStore(spark, str(tmp_path), fetch)
    assert store.get("A/B", "day").count() == 10
    assert store.get("A/B", "day", "2020-01-02", "2020-01-03").count() == 2
    assert len(calls) == 1
    store.get("A/B", "day", refresh=True)
    assert len(calls) == 2
    with pytest.raises(ValueError):
        store.get("A", "7m")


def test_csv_round_trip(spark, tmp_path):
    tables.write_csv(make_bars(spark, [1.0, 2, 3]), str(tmp_path / "x"))
    assert [r.close for r in tables.read_csv(spark, str(tmp_path / "x")).orderBy("ts").collect()] == [1.0, 2.0, 3.0]


def test_tickers(spark):
    rows = spark.createDataFrame([("^NSEI",), ("INFY",), ("A.BO",)], "s string").select(tables.qualify(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["^NSEI", "INFY.NS", "A.BO"]


def test_bars_of_ticks(spark):
    rows = [("A", 100.0, 10.0, "2024-01-01 09:15:00", 1), ("A", 102.0, 5.0, "2024-01-01 09:15:30", 2), ("A", 101.0, 5.0, "2024-01-01 09:15:59", 3), ("A", 103.0, 1.0, "2024-01-01 09:16:01", 4), ("B", 1.0, 1.0, "2024-01-01 09:15:01", 5)]
    ticks = spark.createDataFrame(rows, "symbol string, price double, volume double, t string, event_id long").withColumn("ts", F.to_timestamp("t"))
    got = {(r.symbol, str(r.ts)[11:16]): (r.open, r.high, r.low, r.close, r.volume) for r in stream.bars(ticks, "1 minute").collect()}
    assert got["A", "09:15"] == (100.0, 102.0, 100.0, 101.0, 20.0) and len(got) == 3


def test_streamed_bars_match_the_batch(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    out = stream.drain(stream.bars(stream.tick_stream(spark, f"{d}/events.parquet*")), str(tmp_path))
    got = {tuple(r) for r in out.collect()}
    batch = {tuple(r) for r in stream.bars(tables.ticks(spark, d)).collect()}
    assert got <= batch and len(batch) - len(got) <= 5 * 2


def test_registry_has_a_query_for_every_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150
