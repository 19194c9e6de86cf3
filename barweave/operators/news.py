"""Headlines, cues, regimes and rules read from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.scalars import json_object, normal_title, publisher, unescape


def dedupe(items: DataFrame, title: str = "title", order: tuple = ("pos",), limit: int | None = None) -> DataFrame:
    """The first item of each normalised title, in ``order``; blank titles are left out."""
    key = normal_title(F.col(title))
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    kept = items.withColumn("_key", key).where("_key <> ''").withColumn("_r", rank).where("_r = 1").drop("_key", "_r")
    return kept.orderBy(*order).limit(limit) if limit else kept


def headlines(docs: DataFrame) -> DataFrame:
    """(pos, title, source): the first line of every text as a feed's item."""
    return docs.select(F.col("doc_id").alias("pos"), F.substring_index("text", "\n", 1).alias("title"), "source")


def feed_items(pages: DataFrame) -> DataFrame:
    """(title, link, source, pos) of raw pages; character references of the title are decoded."""
    title = unescape(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    head, source = publisher(F.col("title"))
    return pages.select(F.col("page_id").alias("pos"), title.alias("title"), F.col("url").alias("link")).select("pos", "link", head.alias("title"), source.alias("source"))


def per_group(items: DataFrame, by: str, n: int, order: tuple) -> DataFrame:
    """At most n items of each group, in order."""
    return items.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def last_change(bars: DataFrame) -> DataFrame:
    """(symbol, pct): the last close against the one before; null with fewer than two."""
    back = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    two = bars.withColumn("_r", F.row_number().over(back)).where("_r <= 2")
    now, before = F.max(F.when(F.col("_r") == 1, F.col("close"))), F.max(F.when(F.col("_r") == 2, F.col("close")))
    return two.groupBy("symbol").agg(((now / before - 1) * 100).alias("pct"))


def regime(nifty: Column, sp500: Column, vix: Column) -> tuple[Column, Column, Column]:
    """(score, regime, bias) of three cues; a missing one counts 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = zero(nifty) + zero(sp500) - 0.5 * zero(vix)
    return score, F.when(score > 0.3, "risk_on").when(score < -0.3, "risk_off").otherwise("neutral"), F.when(score > 0.3, "bullish").when(score < -0.3, "bearish").otherwise("neutral")


def input_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def changed(latest: DataFrame, inputs: DataFrame) -> DataFrame:
    """Inputs (payload) whose hash isn't the last stored one."""
    last = latest.agg(F.max_by("input_hash", "ts").alias("last"))
    return inputs.withColumn("input_hash", input_hash(F.col("payload"))).join(F.broadcast(last)).where(~F.col("input_hash").eqNullSafe(F.col("last"))).drop("last")


def with_json(rows: DataFrame, column: str, required: tuple[str, ...]) -> DataFrame:
    """Adds ``body`` (the JSON object in a noisy text, or null) and ``valid`` (it has all required keys)."""
    body = rows.withColumn("body", json_object(F.col(column)))
    keys = F.json_object_keys("body")
    has = F.lit(True)
    for k in required:
        has = has & F.coalesce(F.array_contains(keys, k), F.lit(False))
    return body.withColumn("valid", has)


#: Words that make a text speak of a trend, of crossing averages, of breakouts and of momentum.
TREND_WORDS = ("moving average", "sma", "200", "50 day", "trend")
CROSS_WORDS = ("moving average", "ema", "sma", "crossover", "cross above", "cross over", "golden cross", "death cross")
BREAK_WORDS = ("breakout", "donchian", "new high", "day high", "52 week", "52-week")
MOMENTUM_WORDS = ("momentum", "rate of change", " roc ")


def _numbers(text: Column, pattern: str, low: int, high: int) -> Column:
    """The numbers in [low, high] that the pattern's group matches, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("long"))
    return F.filter(found, lambda x: x.between(low, high))


def _numbers_near(text: Column, words: str, low: int, high: int, before: int = 16, after: int = 40) -> Column:
    """The numbers in [low, high] that stand around the words, word by word."""
    pattern = F.lit(f"(?s)(?<=(^.{{0,{before - 1}}}|.{{{before}}}))(?:{words})(?=(.{{{after}}}|.{{0,{after - 1}}}$))")
    group = lambda k: F.regexp_extract_all(text, pattern, F.lit(k))
    joined = lambda x, y: F.concat(x, y)
    around = F.zip_with(F.zip_with(group(1), group(0), joined), group(2), joined)
    found = F.flatten(F.transform(around, lambda x: F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0))))
    return F.filter(F.transform(found, lambda x: x.try_cast("long")), lambda x: x.between(low, high))


def rules_in(text: Column) -> Column:
    """The rules that a text on strategies speaks of, as an array of (family, params) without repeats; numbers that a text leaves
    out get the usual ones."""
    low = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))

    def has(*words):
        found = F.lit(False)
        for w in words:
            found = found | low.contains(w)
        return found

    def rule(family, **params):
        said = [F.concat(F.lit(f"{k}="), v.cast("string") if isinstance(v, Column) else F.lit(str(v))) for k, v in sorted(params.items())]
        return F.struct(F.lit(family).alias("family"), F.concat_ws(",", *said).alias("params"))

    oversold = F.coalesce(F.get(_numbers(low, r"(?:below|under)\s+([0-9]{1,2})\b", 0, 49), 0), F.lit(30))
    overbought = F.coalesce(F.get(_numbers(low, r"(?:above|over)\s+([0-9]{1,2})\b", 51, 99), 0), F.lit(70))
    trend = has(*TREND_WORDS)
    rsi = F.when(
        has("rsi", "relative strength"),
        F.when(trend & has("volume"), rule("rsi_ma_vol", style="dip", n=F.when(has("200"), 200).otherwise(50), dip=oversold, vol_mult=1.0))
        .when(trend, rule("rsi_pro_trend", mid=50)).otherwise(rule("rsi_reversion", low=oversold, high=overbought)),
    )
    periods = F.array_sort(F.array_distinct(F.concat(_numbers(low, r"([0-9]+)[\s-]*(?:day|period|bar|ema|sma|wma|ma\b)", 2, 400), _numbers(low, r"(?:ema|sma|wma|ma)[\s-]*([0-9]+)", 2, 400))))
    nth, many = (lambda k: F.get(periods, k)), F.size(periods)
    averages = F.when(
        has(*CROSS_WORDS),
        F.when(many >= 3, rule("tri_ma", fast=nth(0), mid=nth(1), slow=nth(2))).when(many == 2, rule("ema_cross", fast=nth(0), slow=nth(1)))
        .when(has("golden cross", "death cross"), rule("ema_cross", fast=50, slow=200)),
    )
    channel = F.coalesce(F.array_max(_numbers_near(low, "breakout|donchian|high|week", 5, 400)), F.lit(20))
    lookback = F.coalesce(F.get(_numbers_near(low, "momentum|roc|day|month|period", 2, 300), 0), F.lit(20))
    found = [rsi, averages, F.when(has("bollinger"), rule("boll_reversion", period=20, num_std=2.0)), F.when(has(*BREAK_WORDS), rule("donchian", n=channel)), F.when(has(*MOMENTUM_WORDS), rule("momentum", lookback=lookback)), F.when(has("macd"), rule("ensemble", k=3))]
    return F.array_distinct(F.array_compact(F.array(*found)))


def prompt(cues: DataFrame, heads: DataFrame) -> DataFrame:
    """One row: the text that a model is asked with, of cues (symbol, pct) and headlines (pos, title); both are short lists."""
    listed = lambda rows: F.coalesce(F.nullif(F.array_join(rows, "\n"), F.lit("")), F.lit("- (none)"))
    cue = cues.where("pct is not null").agg(listed(F.transform(F.array_sort(F.collect_list(F.struct("symbol", "pct"))), lambda x: F.format_string("- %s: %+.2f%%", x["symbol"], F.bround(x["pct"], 2)))).alias("cue"))
    head = heads.agg(listed(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: F.concat(F.lit("- "), x["title"]))).alias("head"))
    return cue.join(head).select(F.concat(F.lit("GLOBAL CUES (1-day % change):\n"), "cue", F.lit("\n\nRECENT HEADLINES:\n"), "head").alias("prompt"))


def cost_inr(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, rate: float = 83.0) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1e6 * rate


def briefing(cues: DataFrame, heads: DataFrame) -> DataFrame:
    """One row: cues as a map, the number of headlines and the first ten."""
    c = cues.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", "pct")))).alias("cues"))
    first = heads.orderBy("pos").limit(10).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]).alias("headlines"))
    return c.join(heads.agg(F.count("*").alias("n"))).join(first)
