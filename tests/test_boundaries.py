"""Cases at the edges of rules: ages, margins, slugs, prompts, setups, publishers, JSON and rules in text."""

import math

import pytest
from pyspark.sql import functions as F

from barweave.functions import scalars
from barweave.operators import audit, graph, invest, news


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_a_note_is_stale_on_its_seventh_day(spark):
    day = lambda x: F.to_date(F.lit(x))
    new = spark.createDataFrame([("a",), ("b",), ("c",)], "slug string").withColumn("data_through", day("2024-01-01"))
    old = spark.createDataFrame([("a", "2024-01-25"), ("b", "2024-01-26"), ("c", None)], "slug string, u string").select("slug", F.to_date("u").alias("updated"), day("2024-01-01").alias("data_through"), F.lit(False).alias("pinned"))
    assert dict(tuple(r) for r in graph.decide(new, old, day("2024-02-01")).collect()) == {"a": "stale", "b": "fresh", "c": "stale"}


def test_an_edge_must_clear_luck_by_a_standard_error(spark):
    luck = math.sqrt(2 * math.log(427))
    edges = [(luck + x) * 5 for x in (0.5, 0.99, 1.01)]  # of 100 signals; an error is 5 points
    assert column(spark, edges, lambda v: audit.search_verdict(v, F.lit(100), F.lit(427)), "double") == [False, False, True]
    few = math.sqrt(2 * math.log(2)) * 5
    assert column(spark, [few + 4.9, few + 5.1], lambda v: audit.search_verdict(v, F.lit(100), F.lit(1)), "double") == [False, True]


def test_slugs(spark):
    said = ["RSI [low=30,high=70] / dip", "a|b#c^d:e\\f", "  plain \t title ", "x" * 200, "\"quoted\" <b>?*"]
    assert column(spark, said, scalars.slug) == ["RSI low=30, high=70 dip", "a b c d e f", "plain title", "x" * 200, "\"quoted\" <b>?*"]


def test_prompts(spark):
    cues = spark.createDataFrame([("b", -2.0), ("a", 1.234), ("c", None)], "symbol string, pct double")
    heads = spark.createDataFrame([(2, "second"), (1, "first")], "pos long, title string")
    assert news.prompt(cues, heads).first()[0] == "GLOBAL CUES (1-day % change):\n- a: +1.23%\n- b: -2.00%\n\nRECENT HEADLINES:\n- first\n- second"
    assert news.prompt(cues.where("false"), heads.where("false")).first()[0] == "GLOBAL CUES (1-day % change):\n- (none)\n\nRECENT HEADLINES:\n- (none)"


@pytest.mark.parametrize("history,up,high,rsi,want", [(59, True, 0.0, 50.0, "insufficient history"), (60, True, -3.04, 50.0, "near-high uptrend"), (60, True, -3.06, 50.0, "uptrend"), (60, True, -11.96, 50.0, "uptrend pullback"), (60, False, -20.0, 34.4, "oversold downtrend"), (60, False, -20.0, 34.6, "downtrend")])
def test_setups_follow_the_rounded_figures(spark, history, up, high, rsi, want):
    row = spark.createDataFrame([(history, up, high, rsi)], "history int, trend_up boolean, from_high_pct double, rsi double")
    assert row.select(invest.setup()).first()[0] == want


def test_publishers(spark):
    said = ["Up again - Paper", " - Paper", "a - b - C", "no publisher", "x - " + "y" * 60]
    both = column(spark, said, lambda v: F.struct(*(c.alias(n) for n, c in zip("hp", scalars.publisher(v), strict=True))))
    assert [tuple(x) for x in both] == [("Up again", "Paper"), ("- Paper", ""), ("a - b", "C"), ("no publisher", ""), (said[4], "")]


def test_json_objects(spark):
    said = ['{"a": 1}', '```json\n{"a": 1}\n```', 'so: {"a": 1}.', '[{"a": 1}]', "none", None, "{broken"]
    assert column(spark, said, scalars.json_object) == ['{"a": 1}'] * 3 + [None] * 4


def test_rules(spark):
    said = ["RSI 14, buy below 30", "golden cross", "the 50-day, 100-day and 200-day sma crossover", "new high of 400 days", "roc", None]
    got = column(spark, said, lambda v: F.transform(news.rules_in(v), lambda r: F.concat_ws(":", r["family"], r["params"])))
    assert got == [["rsi_reversion:high=70,low=30"], ["ema_cross:fast=50,slow=200"], ["tri_ma:fast=50,mid=100,slow=200"], ["donchian:n=400"], ["momentum:lookback=20"], []]


def test_a_config_that_idles_through_half_of_the_runs(spark):
    import itertools
    import random
    import zlib

    import numpy as np

    rng, blocks, days = random.Random(5), 6, 120
    rets = {f"idle{k}": [0.0 if i // 20 in (0, 2, 3, 5) or rng.random() < 0.5 else rng.gauss(-0.3, 3) for i in range(days)] for k in range(4)}
    rets |= {f"busy{k}": [rng.gauss(-0.2, 1) for _ in range(days)] for k in range(2)}
    rows = [(f"2024-{i:04d}", c, x) for c, xs in rets.items() for i, x in enumerate(xs)]
    got = audit.overfitting(spark.createDataFrame(rows, "ts string, config string, ret double"), blocks).first()

    def ratio(xs):
        sd = np.std(xs, ddof=1)
        return np.mean(xs) / sd if sd > 1e-12 else 0.0

    logits, best = [], []
    for chosen in itertools.combinations(range(blocks), blocks // 2):
        half = lambda c, inside: ratio([x for i, x in enumerate(rets[c]) if (i // 20 in chosen) == inside])
        rated = [(half(c, True), -zlib.crc32(c.encode()), half(c, False)) for c in rets]
        x, _, y = max(rated)
        share = sum(z <= y for _, _, z in rated) / (len(rated) + 1)
        logits.append(math.log(share / (1 - share)))
        best.append((x, y))
    assert got.n_splits == len(logits) and got.pbo == pytest.approx(np.mean([v <= 0 for v in logits])) and got.median_logit == pytest.approx(np.median(logits))
    assert got.prob_oos_loss == pytest.approx(np.mean([y < 0 for _, y in best])) and got.degradation_slope == pytest.approx(np.polyfit(*zip(*best), 1)[0])
