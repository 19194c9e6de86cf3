"""The search for configurations, claims from their text to a verdict, exact rounding and character references."""

import html

import numpy as np
import pytest
from conftest import make_bars
from pyspark.sql import functions as F

from barweave.functions import scalars
from barweave.functions.windows import lead
from barweave.operators import claims, search, stances
from barweave.streaming import bars as stream


@pytest.fixture(scope="module")
def rising(spark):
    frames = [make_bars(spark, [100 * 1.0004**i + 2 * np.sin(i / 15 + k) for i in range(n)], s) for k, (s, n) in enumerate((("A", 900), ("B", 800)))]
    return frames[0].unionByName(frames[1]).cache()


def test_a_look_ahead_is_kept_apart(rising, tmp_path):
    grid = {"cheat": (lambda: scalars.sign(lead("close", 1) - F.col("close")), [{}])}
    rows = search.evolve(rising, str(tmp_path / "s"), 1, horizons=(1,), min_is=50, min_oos=50, grid=grid)
    assert [(r.config, r.suspect) for r in rows.collect()] == [("cheat[]", True)] and search.hall_of_fame(rows).count() == 0
    said = search.report(rows, 1).first()
    assert (said.suspects, said.configs_tried, said.champion, said.meaningful) == (1, 1, None, False)


def test_a_search_that_stops_goes_on_as_if_it_had_not(rising, tmp_path):
    grid = {k: stances.GRID[k] for k in ("ema_cross", "drift_rider", "always_long")}
    go = lambda name, n: search.evolve(rising, str(tmp_path / name), n, seed=3, horizons=(3, 5), min_is=50, min_oos=50, grid=grid)
    whole = go("whole", 3)
    go("parts", 1)
    # The driver is lost while it writes the second generation: what is there of it has no _SUCCESS.
    (tmp_path / "parts" / "generation=1").mkdir()
    (tmp_path / "parts" / "generation=1" / "part-0.parquet").write_bytes(b"torn")
    parts = go("parts", 3)
    key = lambda rows: sorted(map(str, rows.collect()))
    assert key(whole) == key(parts)
    tried = whole.groupBy("generation").agg(F.count_distinct("config").alias("n")).orderBy("generation").collect()
    assert [r.generation for r in tried] == list(range(len(tried))) and tried[0].n == 6 and len(tried) >= 2
    fits = [r.fitness_pp for r in search.hall_of_fame(whole).collect()]
    assert fits and fits == sorted(fits, reverse=True)
    assert search.report(whole, 3).first().configs_tried == sum(r.n for r in tried)


def test_slow_progress_adds_up():
    assert search.stalled([1.0, 1.04, 1.08]) == 0 and search.stalled([1.0, 1.04]) == 1 and search.stalled([1.0, 1.04, 1.03]) == 2
    assert search.stalled([None, None]) == 2 and search.stalled([]) == 0 and search.stalled([None, 0.5, 0.5]) == 1


def test_changes_keep_their_limits_and_their_order(spark):
    every = search.seeds(spark, stances.GRID)
    labels = {name for name, _, _ in stances.configs()}
    assert {r.config for r in every.collect()} == labels
    once, twice, other = (sorted(map(str, search.changed(every, s, 1, children=20).collect())) for s in (7, 7, 8))
    assert once == twice != other
    for r in search.changed(every, 7, 1, children=20).collect():
        params = {p["name"]: p for p in r["params"]}
        assert r.config == stances.label(r.family, {k: p["text"] if p["text"] is not None else int(p["number"]) if p["whole"] else p["number"] for k, p in params.items()})
        rising = [params[k]["number"] for k in search.RISING.get(r.family, ())]
        assert all(a < b for a, b in zip(rising, rising[1:]))
        for name, p in params.items():
            if p["text"] is None and name not in search.RISING.get(r.family, ()):
                least, most = search.BOUNDS.get(r.family, {}).get(name, (2 if p["whole"] else 0.01, 500))
                assert least <= p["number"] <= most


def test_claims(spark, rising):
    text = "Buy when RSI falls below 30, sell above 70."
    assert claims.rules_of(spark, text) == [("rsi_reversion", {"high": 70, "low": 30})]
    assert claims.analyse(rising, text, 5, 5).first().note in ("survives", "does not survive", "too few signals")
    for nothing in ("Thanks for watching, like and subscribe.", "", None):
        assert tuple(claims.analyse(rising, nothing).first()) == (False, "no rule found")


def test_rounding_by_the_binary_value(spark):
    values = [(2.675, 2), (0.125, 2), (0.375, 2), (1.005, 2), (-2.675, 2), (-0.125, 2), (2.5, 0), (3.5, 0), (-2.5, 0), (1e15 + 0.5, 0), (0.1 + 0.2, 1), (123456.785, 2)]
    for digits in {d for _, d in values}:
        xs = [x for x, d in values if d == digits]
        got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(scalars.round_exact(F.col("x"), digits)).collect()
        assert [r[0] for r in got] == [round(x, digits) for x in xs]


def test_a_rounded_zero_keeps_its_sign(spark):
    xs = [-0.03, -0.05, 0.03, 0.0, -0.0, -0.06, -1e-300, None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(F.format_string("%+.1f", scalars.round_exact(F.col("x"), 1))).collect()
    assert [r[0] for r in got[:-1]] == [f"{x:+.1f}" for x in xs[:-1]]


def test_character_references(spark):
    said = ["a &amp; b", "&lt;p&gt; &quot;x&quot; &#39;y&#x27;", "&copy; &middot; &eacute;&hellip;", "&#128512; &nosuch; &", "&amp;lt;", None, "plain"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string").orderBy("i").select(scalars.unescape(F.col("x"))).collect()
    assert [r[0] for r in got] == [None if x is None else html.unescape(x) for x in said]


def test_stream_positions_follow_a_plain_loop(spark, tmp_path):
    closes = [10.0, 11, 12, 9, 10, 13, 14, 15, 16, 17, 18, 12]
    made = make_bars(spark, closes).withColumn("ts", F.col("ts").cast("timestamp"))
    made.coalesce(1).write.parquet(str(tmp_path / "bars"))
    got = [(r.event, r.price) for r in stream.drain(stream.breakout_positions(stream.bar_stream(spark, str(tmp_path / "bars"))), str(tmp_path / "out")).orderBy("ts").collect()]
    high, entry, floor, held, want = float("inf"), 0.0, 0.0, -1, []
    for b in made.orderBy("ts").collect():
        if held >= 0:
            held += 1
            if b.close < floor or held >= 5:
                want.append(("close", b.close))
                held = -1
        elif b.close > high:
            floor, held = b.low, 0
            want.append(("open", b.close))
        high = b.high
    assert got == want and len(want) > 1
