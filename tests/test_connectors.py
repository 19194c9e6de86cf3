"""The provider's answers, the feed with offsets, and keyed state: caps, headers, pushed conditions, stops, replays and expiry."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barweave.sources import feed, provider
from barweave.streaming import bars as stream
from barweave.streaming import sessions

ASOF = dt.datetime(2024, 6, 1)


def answer(folder, ticker, code, rows, header=True):
    place = folder / f"ticker={ticker}" / f"interval={code}"
    place.mkdir(parents=True)
    names = ("Open", "High", "Low", "Close", "Volume")
    with open(place / "part-0.json", "w") as file:
        for time, *values in rows:
            print(json.dumps({"Datetime": time} | {n: {ticker: v} if header else v for n, v in zip(names, values)}), file=file)


def at(days):
    return (ASOF - dt.timedelta(days=days)).strftime("%Y-%m-%d %H:%M:%S")


@pytest.mark.parametrize("interval", list(provider.CODES))
def test_the_cap_of_each_interval(spark, tmp_path, interval):
    code, cap = provider.CODES[interval]
    answer(tmp_path, "A.NS", code, [(at(k), 1.0, 2.0, 0.5, 1.5, 10.0) for k in (1, 6, 8, 59, 61, 729, 731, 9000)])
    ask = lambda **more: provider.provider_bars(spark, str(tmp_path), interval=interval, asof=ASOF.isoformat(), **more).count()
    served = {7: 2, 60: 4, 730: 6, None: 8}[cap]
    assert ask() == served and ask(period="max") == served and ask(period="20y") == (served if cap else 7) and ask(period="2d") == 1
    assert ask(start="2020-01-01", end=at(7)[:10]) == len([k for k in (8, 59, 61, 729, 731) if ASOF - dt.timedelta(days=k) >= dt.datetime(2020, 1, 1)])


def test_headers_nulls_and_errors(spark, tmp_path):
    answer(tmp_path, "A.NS", "1d", [(at(2), 1.0, 2.0, 0.5, 1.5, 10.0), (at(1), 1.0, None, 0.5, 1.5, 10.0)])
    answer(tmp_path, "B.NS", "1d", [(at(2), 1.0, 2.0, 0.5, 1.5, 10.0)], header=False)
    answer(tmp_path, "%5EX", "1d", [(at(2), 1.0, 2.0, 0.5, 1.5, 10.0)])
    rows = provider.provider_bars(spark, str(tmp_path)).orderBy("symbol").collect()
    assert [r.symbol for r in rows] == ["A", "B", "^X"] and rows[0].high == 2.0
    with pytest.raises(ValueError):
        provider.ProviderReader({"path": "x", "interval": "2minute"})
    with pytest.raises(ValueError):
        provider.days_of("soon", 7)
    with pytest.raises(Exception, match="no data returned for C.NS"):
        provider.provider_bars(spark, str(tmp_path), symbols="A,C").count()
    (tmp_path / "ticker=D.NS" / "interval=1d").mkdir(parents=True)
    (tmp_path / "ticker=D.NS" / "interval=1d" / "x.json").write_text('{"Datetime": "2024-01-01 00:00:00", "Open": 1.0}\n')
    with pytest.raises(Exception, match="lacks high, low, close, volume"):
        provider.provider_bars(spark, str(tmp_path), symbols="D").count()


def test_conditions_choose_tickers_and_times(spark, tmp_path):
    for t in "ABC":
        answer(tmp_path, f"{t}.NS", "1d", [(at(k), 1.0, 2.0, 0.5, 1.5, float(k)) for k in (1, 2, 3)])
    rows = provider.provider_bars(spark, str(tmp_path)).where(f"symbol in ('A', 'C') and ts > timestamp_ntz '{at(3)}'")
    assert rows.rdd.getNumPartitions() == 2 and sorted((r.symbol, r.volume) for r in rows.collect()) == [("A", 1.0), ("A", 2.0), ("C", 1.0), ("C", 2.0)]


def made_ticks(spark, rows):
    return spark.createDataFrame([(s, float(p), float(v), t, i) for i, (s, p, v, t) in enumerate(rows)], "symbol string, price double, volume double, t string, event_id long").withColumn("ts", F.to_timestamp("t"))


def test_a_failed_batch_is_read_again(spark, tmp_path):
    path = str(tmp_path / "feed")
    feed.record_ticks(made_ticks(spark, [("A", i, 1, f"2024-01-01 00:{i:02d}:00") for i in range(20)]), path, 0, segments=3)
    seen, fail = [], [True]

    def act(frame, batch):
        seen.append((batch, sorted(r.event_id for r in frame.collect())))
        if fail.pop() if fail else False:
            raise RuntimeError("lost")

    run = lambda: stream.each_batch(feed.tick_feed(spark, path, rows_per_task="4"), act, str(tmp_path / "state"))
    with pytest.raises(Exception, match="lost"):
        run().awaitTermination()
    (tmp_path / "feed" / "00000001").mkdir()  # not done yet: no _SUCCESS
    run().awaitTermination()
    feed.record_ticks(made_ticks(spark, [("B", 1, 1, "2024-01-01 01:00:00")]), path, 2, segments=1)
    run().awaitTermination()
    assert seen[0] == seen[1] == (0, list(range(20))) and seen[2:] == [(1, [0])]


def test_rows_of_a_segment_are_dealt_to_tasks(tmp_path, spark):
    path = str(tmp_path / "feed")
    feed.record_ticks(made_ticks(spark, [("A", i, 1, f"2024-01-01 00:{i:02d}:00") for i in range(20)]), path, 0, segments=1)
    reader = feed.FeedReader({"path": path, "rows_per_task": "6"})
    end = reader.latestOffset()
    parts = reader.partitions({"segment": end["segment"], "row": 5}, end)
    assert [(p.first, p.end) for p in parts] == [(5, 11), (11, 17), (17, 20)] and reader.partitions(end, end) == []
    assert [x for p in parts for b in reader.read(p) for x in b.column(4).to_pylist()] == list(range(5, 20))


def plain_sessions(rows, size, first):
    """Bars and stances by a loop over sorted ticks; without the bars that stay open."""
    bars = {}
    for i, (s, p, v, t) in sorted(enumerate(rows), key=lambda x: (x[1][3], x[0])):
        ts = dt.datetime.fromisoformat(t)
        start = ts - dt.timedelta(minutes=(ts.hour * 60 + ts.minute) % size, seconds=ts.second)
        b = bars.setdefault((s, start), [p, p, p, p, 0.0])
        b[1], b[2], b[3], b[4] = max(b[1], p), min(b[2], p), p, b[4] + v
    latest = max(dt.datetime.fromisoformat(t) for *_, t in rows) - dt.timedelta(minutes=10)
    out, days = [], {}
    for (s, start), (o, h, lo, c, v) in sorted(bars.items()):
        if start + dt.timedelta(minutes=size) <= latest:
            day = days.setdefault((s, start.date()), [])
            day.append((h, lo))
            r = day[:first]
            stance = 0 if len(day) <= first else 1 if c > max(x for x, _ in r) else -1 if c < min(x for _, x in r) else 0
            out.append((s, start, o, h, lo, c, v, len(day), stance))
    return out


def test_keyed_bars_against_a_plain_loop(spark, tmp_path):
    import random

    rng = random.Random(2)
    rows = [(rng.choice("AB"), 100 + rng.gauss(0, 5), rng.randrange(9), f"2024-01-0{d} {h:02d}:{m:02d}:{rng.randrange(60):02d}") for d in (1, 2) for h in range(9, 16) for m in range(0, 60, 7)]
    path, out, state = (str(tmp_path / x) for x in ("feed", "rows", "state"))
    ticks = made_ticks(spark, rows)
    for n, (low, high) in enumerate(((0, 30), (30, 31), (31, 1000))):  # stops inside a bar, and goes on from its state
        feed.record_ticks(ticks.where(F.col("event_id").between(low, high - 1)), path, n, segments=2)
        stream.follow(sessions.session_bars(feed.tick_feed(spark, path), minutes=30, first=3), out, state)
    got = [(r.symbol, r.ts, *(r[2:])) for r in spark.read.schema(sessions.SIGNALS).parquet(out).orderBy("symbol", "ts").collect()]
    want = plain_sessions(rows, 30, 3)
    assert [g[:2] + g[7:] for g in got] == [w[:2] + w[7:] for w in want] and {w[8] for w in want} > {0}
    assert all(g[2:7] == pytest.approx(w[2:7]) for g, w in zip(got, want))


def test_late_ticks_and_idle_symbols(spark, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("feed", "rows", "state"))
    run = lambda: stream.follow(sessions.session_bars(feed.tick_feed(spark, path), minutes=30, first=1, idle=120), out, state)
    for n, rows in enumerate((
        [("A", 10, 1, "2024-01-01 09:00:00"), ("A", 12, 1, "2024-01-01 09:40:00")],
        [("A", 11, 1, "2024-01-01 09:35:00"), ("A", 99, 1, "2024-01-01 08:00:00"), ("B", 5, 1, "2024-01-01 14:00:00")],
        [("A", 1, 1, "2024-01-01 14:05:00"), ("B", 6, 1, "2024-01-01 15:00:00"), (None, 1, 1, "2024-01-01 15:00:00")],
    )):
        feed.record_ticks(made_ticks(spark, rows), path, n, segments=1)
        run()
    got = [(r.symbol, f"{r.ts:%H:%M}", r.open, r.close, r.day_bar) for r in spark.read.schema(sessions.SIGNALS).parquet(out).orderBy("symbol", "ts").collect()]
    # The tick of 08:00 is too late, that of 09:35 opens its bar; A was idle from 09:40 on, so its day begins anew.
    assert got == [("A", "09:00", 10.0, 10.0, 1), ("A", "09:30", 11.0, 12.0, 2), ("A", "14:00", 1.0, 1.0, 1), ("B", "14:00", 5.0, 5.0, 1)]


def test_parts_of_bars_are_made_before_the_shuffle():
    import pandas as pd

    size, us = 60_000, lambda *x: [1_700_000_040_000_000 + v for v in x]
    ticks = pd.DataFrame({"symbol": list("ABAAA"), "us": us(900, 10, 100, 100, 60_000_000), "event_id": [1, 2, 4, 3, 5], "price": [5.0, 9, 7, 6, 1], "volume": [1.0, 1, 2, 3, 4]})
    got = [tuple(r) for r in sessions.parts(ticks, size).itertuples(index=False)]
    first, second = 1_700_000_040_000, 1_700_000_100_000
    # Ticks of one millisecond go by their microseconds, then by their ids.
    assert got == [
        ("A", first, *us(100), 3, 6.0, 7.0, 5.0, *us(900), 1, 5.0, 6.0),
        ("A", second, *us(60_000_000), 5, 1.0, 1.0, 1.0, *us(60_000_000), 5, 1.0, 4.0),
        ("B", first, *us(10), 2, 9.0, 9.0, 9.0, *us(10), 2, 9.0, 1.0),
    ]


def test_what_a_symbol_merges_does_not_grow_with_its_ticks(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    class Counting(sessions.SessionBars):
        def handleInputRows(self, key, rows, timerValues):
            frames = list(rows)
            (seen / f"{key[0]}-{sum(map(len, frames))}").touch()
            yield from super().handleInputRows(key, iter(frames), timerValues)

    plain, sessions.SessionBars = sessions.SessionBars, Counting
    try:
        feed.record_ticks(made_ticks(spark, [("A", 1.0, 1.0, f"2024-01-01 09:{i // 60:02d}:{i % 60:02d}") for i in range(1800)]), str(tmp_path / "feed"), 0, segments=1)
        stream.follow(sessions.session_bars(feed.tick_feed(spark, str(tmp_path / "feed")), minutes=15), str(tmp_path / "rows"), str(tmp_path / "state"))
    finally:
        sessions.SessionBars = plain
    assert [f.name for f in seen.iterdir()] == ["A-2"]
    assert [(r.close, r.volume) for r in spark.read.schema(sessions.SIGNALS).parquet(str(tmp_path / "rows")).collect()] == [(1.0, 900.0)]
