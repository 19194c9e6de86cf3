"""Queries on scans, slices, ledgers, text, graphs and streams."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from barweave.functions import scalars
from barweave.operators import graph, ledger, news, stances
from barweave.operators.evaluate import aligned, hold_trades, long_enough
from barweave.plans import sqltext as q
from barweave.plans.catalogue import query
from barweave.plans.evaluate_q import ALIGNED, HOLD, fade, rounded
from barweave.plans.indicators_q import DAYS
from barweave.sources import tables
from barweave.sources.tables import daily_bars, intraday_bars, read
from barweave.streaming import bars as stream_bars

BARS = "symbol, ts, open, high, low, close, volume"


def select(name: str, sql: str, f, head: str = DAYS):
    query(name, head + sql)(f)


# ---------------------------------------------------------------- scans and slices

select("src1_daily_bars", f"SELECT {BARS} FROM bars", lambda s, d: daily_bars(s, d).select(*BARS.split(", ")))
select("src7_ticks", "SELECT event_type AS symbol, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, event_id FROM events", lambda s, d: tables.ticks(s, d).select("symbol", "price", "volume", "event_id"), "")
select("src4_qualified", "SELECT DISTINCT p_type AS symbol, CASE WHEN contains(p_type, '.') OR starts_with(p_type, '^') THEN p_type ELSE p_type || '.NS' END AS ticker FROM part", lambda s, d: read(s, d, "part").select(F.col("p_type").alias("symbol")).distinct().withColumn("ticker", tables.qualify(F.col("symbol"))), "")
select("src8_headlines", "SELECT doc_id AS pos, split_part(text, chr(10), 1) AS title, source FROM documents", lambda s, d: news.headlines(read(s, d, "documents")), "")
select("src11_cues", f"SELECT symbol, round((max(close) FILTER (r = 1) / max(close) FILTER (r = 2) - 1) * 100, 4) AS pct FROM (SELECT *, row_number() OVER ({q.W} DESC) AS r FROM bars) GROUP BY symbol", lambda s, d: rounded(news.last_change(daily_bars(s, d))))
select("fn15_last_change", f"SELECT symbol, round((max(close) FILTER (r = 1) / max(close) FILTER (r = 2) - 1) * 100, 4) AS pct FROM (SELECT *, row_number() OVER ({q.W} DESC) AS r FROM bars) GROUP BY symbol", lambda s, d: rounded(news.last_change(ntz60(s, d))), q.with_(q.intraday()))


def ntz60(spark, d):
    return intraday_bars(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


select("pf1_projection", "SELECT symbol, ts, open, close FROM bars", lambda s, d: daily_bars(s, d).select("symbol", "ts", "open", "close"))
select("pf2_no_nulls", f"SELECT symbol, ts, r FROM (SELECT symbol, ts, round(close / lag(close) OVER ({q.W}) - 1, 4) AS r FROM bars) WHERE r IS NOT NULL", lambda s, d: rounded(stances.prepare(daily_bars(s, d)).select("symbol", "ts", "r").na.drop("any")))
select("pf3_range", "SELECT symbol, ts, close FROM bars WHERE ts >= '1995-03-01' AND ts < '1995-07-01'", lambda s, d: tables.in_range(daily_bars(s, d), "1995-03-01", "1995-06-30").select("symbol", "ts", "close"))
select("pf4_tail", f"SELECT symbol, ts, close FROM (SELECT *, row_number() OVER ({q.W} DESC) AS r FROM bars) WHERE r <= 200", lambda s, d: ledger.tail(daily_bars(s, d), 200).select("symbol", "ts", "close"))
select("pf5_long_enough", "SELECT symbol, count(*) AS bars FROM bars GROUP BY symbol HAVING count(*) >= 2460", lambda s, d: long_enough(daily_bars(s, d), 2460).groupBy("symbol").agg(F.count("*").alias("bars")))
select("pf10_trading_days", "SELECT symbol, ts FROM bars WHERE dayofweek(ts) NOT IN (0, 6) AND CAST(ts AS DATE) NOT IN (DATE '1995-01-26', DATE '1995-08-15')", lambda s, d: ledger.trading_days(daily_bars(s, d), s.createDataFrame([("1995-01-26",), ("1995-08-15",)], "day string").select(F.to_date("day").alias("day"))).select("symbol", "ts"))
select("pf10_market_open", "SELECT event_id, dayofweek(ts) NOT IN (0, 6) AND strftime(ts, '%H:%M:%S') BETWEEN '09:15:00' AND '15:30:00' AS is_open FROM events", lambda s, d: tables.ticks(s, d).select("event_id", ledger.market_open(F.col("ts")).alias("is_open")), "")
select("pf11_downsample", "SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars) WHERE n <= 700 OR i % greatest(1, n // 700) = 0", lambda s, d: ledger.downsample(daily_bars(s, d), 700).select("symbol", "ts", "close"))
select("pf16_symbol", "SELECT symbol, ts, close FROM bars WHERE symbol = 'LARGE'", lambda s, d: daily_bars(s, d).where("symbol = 'LARGE'").select("symbol", "ts", "close"))
select("pf18_prices", "SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, floor(close * 100 + 0.5) / 100 AS close FROM bars", lambda s, d: daily_bars(s, d).select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.floor(F.col("close") * 100 + 0.5) / 100).alias("close")))
select("sc22_iso_dates", "SELECT symbol, strftime(ts, '%Y-%m') AS month, count(*) AS bars FROM bars GROUP BY ALL", lambda s, d: daily_bars(s, d).groupBy("symbol", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("bars")))
select("sc23_days", "SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS bars FROM bars GROUP BY ALL", lambda s, d: ntz60(s, d).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").alias("bars")), q.with_(q.intraday()))
select("sc25_price_scale", "SELECT symbol, round(ln(max(close)) - ln(min(close)), 4) AS log_range, round(median(close), 4) AS mid, round(regr_slope(close, volume), 4) AS slope FROM bars GROUP BY symbol", lambda s, d: rounded(daily_bars(s, d).groupBy("symbol").agg((F.log(F.max("close")) - F.log(F.min("close"))).alias("log_range"), F.percentile("close", F.lit(0.5)).alias("mid"), F.regr_slope("close", "volume").alias("slope"))))
select("jn5_active_return", f"SELECT symbol, ts, round(f - avg(f) OVER (PARTITION BY ts), 4) AS active FROM (SELECT symbol, ts, lead(close) OVER ({q.W}) / close - 1 AS f FROM bars)", lambda s, d: rounded(daily_bars(s, d).withColumn("f", stances_forward()).select("symbol", "ts", (F.col("f") - F.avg("f").over(Window.partitionBy("ts"))).alias("active"))))


def stances_forward():
    from barweave.functions.windows import forward_return

    return forward_return(1)


select("jn7_time_shift", f"SELECT symbol, ts, lag(close, 20) OVER ({q.W}) AS before, lead(close, 5) OVER ({q.W}) AS later FROM bars", lambda s, d: daily_bars(s, d).select("symbol", "ts", F.lag("close", 20).over(Window.partitionBy("symbol").orderBy("ts")).alias("before"), F.lead("close", 5).over(Window.partitionBy("symbol").orderBy("ts")).alias("later")))
select("jn11_lookup", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", lambda s, d: read(s, d, "nation").join(F.broadcast(read(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name"), "")
select("jn12_signalled", HOLD[len(DAYS) - 1 :] + "SELECT b.symbol, count(*) AS bars FROM bars b WHERE b.symbol IN (SELECT symbol FROM s WHERE direction <> 0) GROUP BY 1", lambda s, d: daily_bars(s, d).join(fade(s, d).where("direction <> 0").select("symbol").distinct(), "symbol", "left_semi").groupBy("symbol").agg(F.count("*").alias("bars")), DAYS[:-1])
select("ag26_data_through", "SELECT CAST(max(ts) AS DATE) AS data_through FROM bars", lambda s, d: daily_bars(s, d).agg(F.max(F.to_date("ts")).alias("data_through")))
select("ag27_symbol_span", "SELECT symbol, count(*) AS bars, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM bars GROUP BY symbol", lambda s, d: daily_bars(s, d).groupBy("symbol").agg(F.count("*").alias("bars"), F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day")))
MOM = f"(SELECT symbol, ts, close / lag(close, 20) OVER ({q.W}) - 1 AS m FROM p)"
select("rk1_cross_rank", f"SELECT ts, symbol, row_number() OVER (PARTITION BY ts ORDER BY m, symbol) AS rk FROM {MOM} WHERE m IS NOT NULL", lambda s, d: momentum_panel(s, d).withColumn("rk", F.row_number().over(Window.partitionBy("ts").orderBy("m", "symbol")).cast("long")).select("ts", "symbol", "rk"), q.with_(q.DAILY, ALIGNED))
select("rk2_strongest", f"SELECT ts, symbol FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY m DESC, symbol) AS rk FROM {MOM} WHERE m IS NOT NULL) WHERE rk <= 2", lambda s, d: momentum_panel(s, d).withColumn("rk", F.row_number().over(Window.partitionBy("ts").orderBy(F.desc("m"), "symbol"))).where("rk <= 2").select("ts", "symbol"), q.with_(q.DAILY, ALIGNED))


def momentum_panel(spark, d):
    panel = aligned(daily_bars(spark, d)).select("symbol", "ts", "close")
    return panel.withColumn("m", F.col("close") / F.lag("close", 20).over(Window.partitionBy("symbol").orderBy("ts")) - 1).where("m is not null")


select("so2_date_union", "SELECT ts FROM bars WHERE symbol = 'LARGE' UNION SELECT ts FROM bars WHERE symbol = 'SMALL'", lambda s, d: daily_bars(s, d).where("symbol = 'LARGE'").select("ts").union(daily_bars(s, d).where("symbol = 'SMALL'").select("ts")).distinct())
select("so4_date_intersection", "SELECT ts FROM bars WHERE symbol = 'LARGE' INTERSECT SELECT ts FROM bars WHERE symbol = 'SMALL'", lambda s, d: daily_bars(s, d).where("symbol = 'LARGE'").select("ts").intersect(daily_bars(s, d).where("symbol = 'SMALL'").select("ts")))

# ---------------------------------------------------------------- the ledger: orders stand for trades

LED = "led AS (SELECT o_orderkey AS id, o_custkey % 50 AS account, CASE WHEN o_orderpriority LIKE '1%' THEN 'paper' ELSE 'backtest' END AS mode, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS exit_time, o_totalprice - 150000 AS pnl FROM orders)"


def trades(spark, d):
    mode = F.when(F.col("o_orderpriority").startswith("1"), "paper").otherwise("backtest")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("account"), mode.alias("mode"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("exit_time"), (F.col("o_totalprice") - 150000).alias("pnl"))


DAY = "dp AS (SELECT CAST(exit_time AS DATE) AS day, round(sum(pnl), 2) AS realized_pnl, count(*) AS trades_count FROM led WHERE mode = 'paper' AND exit_time IS NOT NULL GROUP BY 1)"
L, LD = q.with_(LED), q.with_(LED, DAY)
select("ag04_daily_rollup", "SELECT day, round(realized_pnl, 1) AS realized_pnl, trades_count, false AS halted, 'paper' AS mode FROM dp", lambda s, d: ledger.daily_rollup(trades(s, d), "paper").withColumn("realized_pnl", F.round("realized_pnl", 1)), LD)
select("ag29_trades_by_day", "SELECT CAST(exit_time AS DATE) AS day, count(*) AS n FROM led WHERE exit_time IS NOT NULL GROUP BY 1", lambda s, d: trades(s, d).where("exit_time is not null").groupBy(F.to_date("exit_time").alias("day")).agg(F.count("*").alias("n")), L)
select("pf12_closed_paper", "SELECT id FROM led WHERE mode = 'paper' AND exit_time IS NOT NULL", lambda s, d: trades(s, d).where("mode = 'paper' and exit_time is not null").select("id"), L)
select("pf13_recent", "SELECT id FROM led WHERE exit_time >= (SELECT CAST(max(exit_time) AS DATE) - 6 FROM led)", lambda s, d: ledger.recent(trades(s, d), 7).select("id"), L)
select("pf14_reset", "SELECT id, mode FROM led WHERE mode <> 'paper'", lambda s, d: ledger.without_mode(trades(s, d), "paper").select("id", "mode"), L)
select("rk8_latest", "SELECT id, mode FROM led ORDER BY id DESC LIMIT 100", lambda s, d: ledger.latest_rows(trades(s, d).dropDuplicates(["id"]), 100).select("id", "mode"), L)
select("vp14_bar_heights", "SELECT day, round(greatest(6, abs(realized_pnl) / (SELECT max(abs(realized_pnl)) FROM dp) * 100), 3) AS height FROM dp", lambda s, d: ledger.bar_heights(ledger.daily_rollup(trades(s, d), "paper")).select("day", F.round("height", 3).alias("height")), LD)
select("fn23_heat_map", "SELECT day - CAST(dayofweek(day) AS INT) AS week, CAST(dayofweek(day) AS INT) AS weekday, round(abs(realized_pnl) / (SELECT max(abs(realized_pnl)) FROM dp), 4) AS intensity FROM dp", lambda s, d: ledger.heat_map(ledger.daily_rollup(trades(s, d), "paper")).select("week", "weekday", F.round("intensity", 4).alias("intensity")), LD)
select("vp7_last_days", HOLD[len(DAYS) - 1 :] + "SELECT CAST(exit_date AS VARCHAR) AS day, p AS pnl_pct FROM (SELECT exit_date, round(sum(net_ret) * 100, 4) AS p FROM tr GROUP BY 1 ORDER BY 1 DESC LIMIT 15)", lambda s, d: rounded(hold_trades(fade(s, d), 5, 0.002).groupBy("exit_date").agg((F.sum("net_ret") * 100).alias("pnl_pct")).orderBy(F.desc("exit_date")).limit(15).select(F.date_format("exit_date", "yyyy-MM-dd HH:mm:ss").alias("day"), "pnl_pct")), DAYS[:-1])
select("vp15_scaled_line", "SELECT symbol, ts, round((close - min(close) OVER w) / nullif(max(close) OVER w - min(close) OVER w, 0), 4) AS y FROM bars WINDOW w AS (PARTITION BY symbol)", lambda s, d: rounded(daily_bars(s, d).select("symbol", "ts", scalars.ratio(F.col("close") - F.min("close").over(Window.partitionBy("symbol")), F.max("close").over(Window.partitionBy("symbol")) - F.min("close").over(Window.partitionBy("symbol"))).alias("y"))))
USE = "us AS (SELECT event_id AS id, CAST(ts AS DATE) AS day, user_id % 5000 AS ti, user_id % 700 AS tokens_out FROM events)"


def usage(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.to_date("ts").alias("day"), (F.col("user_id") % 5000).alias("ti"), (F.col("user_id") % 700).alias("tokens_out"))


select("sc21_model_cost", "SELECT id, round((ti * 0.3 + tokens_out * 2.5) / 1e6 * 83, 6) AS cost FROM us", lambda s, d: usage(s, d).select("id", F.round(news.cost_inr(F.col("ti"), F.col("tokens_out"), F.lit(0.3), F.lit(2.5)), 6).alias("cost")), q.with_(USE))
select("ag28_spend_by_day", "SELECT day, round(sum((ti * 0.3 + tokens_out * 2.5) / 1e6 * 83), 6) AS cost FROM us GROUP BY day", lambda s, d: usage(s, d).groupBy("day").agg(F.round(F.sum(news.cost_inr(F.col("ti"), F.col("tokens_out"), F.lit(0.3), F.lit(2.5))), 6).alias("cost")), q.with_(USE))
select("vp12_latest_usage", "SELECT id, round((ti * 0.3 + tokens_out * 2.5) / 1e6 * 83, 3) AS cost FROM us ORDER BY id DESC LIMIT 50", lambda s, d: ledger.latest_rows(usage(s, d), 50).select("id", F.round(news.cost_inr(F.col("ti"), F.col("tokens_out"), F.lit(0.3), F.lit(2.5)), 3).alias("cost")), q.with_(USE))

# ---------------------------------------------------------------- text

HEADS = "hd AS (SELECT doc_id AS pos, split_part(text, chr(10), 1) AS title, source FROM documents), nk AS (SELECT *, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS k FROM hd)"
FIRST = "dd AS (SELECT pos, title, source FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS r FROM nk WHERE k <> '') WHERE r = 1)"
select("sc6_normal_title", "SELECT pos, k AS title FROM nk", lambda s, d: news.headlines(read(s, d, "documents")).select("pos", scalars.normal_title(F.col("title")).alias("title")), q.with_(HEADS))
select("sc7_deduped_headlines", "SELECT pos, title, source FROM dd", lambda s, d: news.dedupe(news.headlines(read(s, d, "documents"))), q.with_(HEADS, FIRST))
select("src10_per_source", "SELECT pos, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos DESC) AS r FROM hd) WHERE r <= 4", lambda s, d: news.per_group(news.headlines(read(s, d, "documents")), "source", 4, (F.desc("pos"),)).select("pos", "source"), q.with_(HEADS))
select("rk11_newest_first", "SELECT pos, title FROM (SELECT pos, title FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos DESC) AS r FROM nk WHERE k <> '') WHERE r = 1 ORDER BY pos DESC LIMIT 60)", lambda s, d: news.dedupe(news.headlines(read(s, d, "documents")), order=(F.desc("pos"),), limit=60).select("pos", "title"), q.with_(HEADS))
select("pf15_breaking", "SELECT event_id FROM (SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id) AS r, max(ts) OVER () AS m FROM events) WHERE ts > m - INTERVAL 24 HOUR OR r <= 8", lambda s, d: breaking(s, d), "")


def breaking(spark, d):
    """Items of the last day; the newest eight if there are fewer."""
    items = read(spark, d, "events").select("event_id", "ts")
    last = items.agg(F.max("ts").alias("m"))
    recent = items.join(F.broadcast(last)).where(F.col("ts") > F.col("m") - F.expr("interval 24 hours")).select("event_id")
    return recent.union(items.orderBy(F.desc("ts"), "event_id").limit(8).select("event_id")).distinct()


select("sc10_domains", "SELECT page_id, regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1), '^www\\.', '') AS host FROM pages", lambda s, d: read(s, d, "pages").select("page_id", scalars.domain(F.col("url")).alias("host")), "")
select("sc13_age_labels", "SELECT event_id, CASE WHEN s >= 86400 THEN s // 86400 || 'd ago' WHEN s >= 3600 THEN s // 3600 || 'h ago' WHEN s >= 60 THEN s // 60 || 'm ago' ELSE 'just now' END AS age FROM (SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-03-01' - ts)) AS BIGINT) AS s FROM events)", lambda s, d: read(s, d, "events").select("event_id", scalars.age_label(F.floor(F.lit(1709251200) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)).alias("age")), "")
select("sc14_json_objects", "SELECT event_id, body IS NOT NULL AS parsed, coalesce(json_exists(body, '$.k'), false) AS valid FROM (SELECT event_id, regexp_extract('text ' || props || ' end', '(?s)\\{.*\\}') AS body FROM events)", lambda s, d: news.with_json(read(s, d, "events").withColumn("noisy", F.concat(F.lit("text "), "props", F.lit(" end"))), "noisy", ("k",)).select("event_id", F.col("body").isNotNull().alias("parsed"), "valid"), "")
select("sc16_slugs", r"SELECT pos, trim(regexp_replace(replace(regexp_replace(title, '[\[\]#^|:\\/]+', ' ', 'g'), ',', ', '), '\s+', ' ', 'g')) AS slug FROM hd", lambda s, d: news.headlines(read(s, d, "documents")).select("pos", scalars.slug(F.col("title")).alias("slug")), q.with_(HEADS))
select("sc17_days_since", "SELECT o_orderkey, o_orderdate, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01')::DOUBLE AS days FROM orders", lambda s, d: read(s, d, "orders").select("o_orderkey", "o_orderdate", scalars.days_since(F.date_format("o_orderdate", "yyyy-MM-dd"), F.to_date(F.lit("2000-01-01"))).alias("days")), "")
select("fn16_regime", f", w AS (SELECT ts, max(r) FILTER (symbol = 'LARGE') AS a, max(r) FILTER (symbol = 'MEDIUM') AS b, max(r) FILTER (symbol = 'SMALL') AS v FROM (SELECT symbol, ts, (close / lag(close) OVER ({q.W}) - 1) * 100 AS r FROM bars) GROUP BY ts), x AS (SELECT ts, coalesce(a, 0) + coalesce(b, 0) - 0.5 * coalesce(v, 0) AS s FROM w) SELECT ts, round(s, 4) AS score, CASE WHEN s > 0.3 THEN 'risk_on' WHEN s < -0.3 THEN 'risk_off' ELSE 'neutral' END AS regime FROM x", lambda s, d: regimes(s, d), DAYS[:-1])


def regimes(spark, d):
    r = F.col("r") * 100
    wide = stances.prepare(daily_bars(spark, d)).groupBy("ts").agg(*(F.max(F.when(F.col("symbol") == n, r)).alias(n) for n in ("LARGE", "MEDIUM", "SMALL")))
    score, regime, _ = news.regime(F.col("LARGE"), F.col("MEDIUM"), F.col("SMALL"))
    return wide.select("ts", F.round(score, 4).alias("score"), regime.alias("regime"))


select("fn17_input_hash", "SELECT event_id, sha256(props) AS input_hash FROM events", lambda s, d: read(s, d, "events").select("event_id", news.input_hash(F.col("props")).alias("input_hash")), "")
PROMPT = """SELECT 'GLOBAL CUES (1-day % change):' || chr(10) || coalesce((SELECT string_agg('- ' || symbol || ': ' || printf('%+.2f', pct) || '%', chr(10) ORDER BY symbol) FROM cu WHERE pct IS NOT NULL), '- (none)')
  || chr(10) || chr(10) || 'RECENT HEADLINES:' || chr(10) || coalesce((SELECT string_agg('- ' || title, chr(10) ORDER BY pos) FROM (SELECT * FROM dd ORDER BY pos LIMIT 25)), '- (none)') AS prompt"""
CUES = f"cu AS (SELECT symbol, (max(close) FILTER (r = 1) / max(close) FILTER (r = 2) - 1) * 100 AS pct FROM (SELECT *, row_number() OVER ({q.W} DESC) AS r FROM bars) GROUP BY symbol)"
select("sc26_prompt", PROMPT, lambda s, d: news.prompt(news.last_change(daily_bars(s, d)), news.dedupe(news.headlines(read(s, d, "documents")), limit=25)), q.with_(q.DAILY, CUES, HEADS, FIRST))
TITLES = """ti AS (SELECT page_id AS pos, url AS link, replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM pages),
pb AS (SELECT *, regexp_extract(t, '(?s)^(.+) - (.*)$', ['h', 's']) AS m FROM ti),
fi AS (SELECT pos, link, trim(CASE WHEN m.h <> '' AND length(m.s) < 60 THEN m.h ELSE t END) AS title, CASE WHEN m.h <> '' AND length(m.s) < 60 THEN trim(m.s) ELSE '' END AS source FROM pb)"""
select("src9_feed_items", "SELECT pos, link, title, source FROM fi", lambda s, d: news.feed_items(read(s, d, "pages")), q.with_(TITLES))
select("sc8_publishers", "SELECT pos, title, source FROM fi", lambda s, d: news.feed_items(read(s, d, "pages")).select("pos", "title", "source"), q.with_(TITLES))

#: Claims that are sure to speak of rules, beside the conversations.
CLAIMS = (
    "Buy when the RSI drops below 25 and sell when it rises above 75.", "RSI under 60 or below 20, over 40", "Relative strength with the trend.",
    "Long when RSI is below 35 while price holds above the 200 day moving average on high volume.", "Go long when the 50 day moving average crosses above the 200 day moving average.",
    "The 9-ema, the 21 ema and SMA 55 in line", "A golden cross is near", "Trade the breakout above the 20 day high.", "A new high after 52 weeks, number 999999999999999999999", "Ride 60 day price momentum.",
    "Momentum", "Fade the lower Bollinger band with MACD", "Remember to like and subscribe!", "",
)


def claims(spark, d):
    literal = spark.createDataFrame([(-1, k, t) for k, t in enumerate(CLAIMS)], "conv_id long, turn long, text string")
    return read(spark, d, "conversations").select("conv_id", "turn", "text").unionByName(literal)


def _near(words: str, low: int, high: int) -> str:
    start = "greatest(1, i - 16)"
    around = f"substring(t, {start}, i - {start} + length(regexp_extract(substring(t, i, 10), '^(?:{words})')) + 40)"
    return f"list_filter(flatten(list_transform(list_filter(range(1, length(t) + 1), lambda i: regexp_matches(substring(t, i, 10), '^(?:{words})')), lambda i: list_transform(regexp_extract_all({around}, '[0-9]+'), lambda x: TRY_CAST(x AS BIGINT)))), lambda x: x BETWEEN {low} AND {high})"


def _all(pattern: str, low: int, high: int) -> str:
    return f"list_filter(list_transform(regexp_extract_all(t, '{pattern}', 1), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x BETWEEN {low} AND {high})"


def _says(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


RULES = rf"""
WITH c AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -1, k, x FROM (VALUES {", ".join(f"({k}, '{x}')" for k, x in enumerate(CLAIMS))}) v(k, x)),
t AS (SELECT conv_id, turn, ' ' || lower(text) || ' ' AS t FROM c),
n AS (SELECT *, coalesce({_all(r"(?:below|under)\s+([0-9]{1,2})\b", 0, 49)}[1], 30) AS lo, coalesce({_all(r"(?:above|over)\s+([0-9]{1,2})\b", 51, 99)}[1], 70) AS hi,
  list_sort(list_distinct(list_concat({_all(r"([0-9]+)[\s-]*(?:day|period|bar|ema|sma|wma|ma\b)", 2, 400)}, {_all(r"(?:ema|sma|wma|ma)[\s-]*([0-9]+)", 2, 400)}))) AS p,
  coalesce(list_max({_near("breakout|donchian|high|week", 5, 400)}), 20) AS channel, coalesce({_near("momentum|roc|day|month|period", 2, 300)}[1], 20) AS back,
  {_says(("moving average", "sma", "200", "50 day", "trend"))} AS trend FROM t),
r AS (SELECT conv_id, turn, [
  CASE WHEN {_says(("rsi", "relative strength"))} THEN CASE WHEN trend AND contains(t, 'volume') THEN 'rsi_ma_vol(dip=' || lo || ',n=' || CASE WHEN contains(t, '200') THEN 200 ELSE 50 END || ',style=dip,vol_mult=1.0)'
    WHEN trend THEN 'rsi_pro_trend(mid=50)' ELSE 'rsi_reversion(high=' || hi || ',low=' || lo || ')' END END,
  CASE WHEN {_says(("moving average", "ema", "sma", "crossover", "cross above", "cross over", "golden cross", "death cross"))} THEN CASE WHEN len(p) >= 3 THEN 'tri_ma(fast=' || p[1] || ',mid=' || p[2] || ',slow=' || p[3] || ')'
    WHEN len(p) = 2 THEN 'ema_cross(fast=' || p[1] || ',slow=' || p[2] || ')' WHEN {_says(("golden cross", "death cross"))} THEN 'ema_cross(fast=50,slow=200)' END END,
  CASE WHEN contains(t, 'bollinger') THEN 'boll_reversion(num_std=2.0,period=20)' END,
  CASE WHEN {_says(("breakout", "donchian", "new high", "day high", "52 week", "52-week"))} THEN 'donchian(n=' || channel || ')' END,
  CASE WHEN {_says(("momentum", "rate of change", " roc "))} THEN 'momentum(lookback=' || back || ')' END,
  CASE WHEN contains(t, 'macd') THEN 'ensemble(k=3)' END] AS r FROM n)
SELECT conv_id, turn, array_to_string(list_filter(r, lambda x: x IS NOT NULL), ';') AS rules FROM r"""


@query("sc19_rules_in_text", RULES)
def rules_in_text(spark, d):
    said = F.transform(news.rules_in(F.col("text")), lambda r: F.concat(r["family"], F.lit("("), r["params"], F.lit(")")))
    return claims(spark, d).select("conv_id", "turn", F.concat_ws(";", said).alias("rules"))


select("vp10_briefing", """SELECT (SELECT string_agg(symbol || '=' || printf('%+.2f', pct), ', ' ORDER BY symbol) FROM cu WHERE pct IS NOT NULL) AS cues, (SELECT count(*) FROM dd) AS n, (SELECT string_agg(title, chr(10) ORDER BY pos) FROM (SELECT * FROM dd ORDER BY pos LIMIT 10)) AS headlines""",
    lambda s, d: briefing(s, d), q.with_(q.DAILY, CUES, HEADS, FIRST))


def briefing(spark, d):
    found = news.briefing(news.last_change(daily_bars(spark, d)), news.dedupe(news.headlines(read(spark, d, "documents"))))
    cue = F.transform(F.map_entries("cues"), lambda c: F.concat(c["key"], F.lit("="), F.format_string("%+.2f", scalars.round_exact(c["value"], 2))))
    return found.select(F.array_join(cue, ", ").alias("cues"), "n", F.array_join("headlines", "\n").alias("headlines"))


# ---------------------------------------------------------------- the graph: links between pages

NOTES = "nt AS (SELECT 'p' || page_id AS slug, CASE WHEN page_id % 3 = 0 THEN 'concept' ELSE 'run' END AS ntype, 'f' || page_id % 4 AS folder, '[[p' || (page_id * 7) % 300 || ']] [[p' || page_id || ']] [[p' || (page_id * 3) % 260 || ']] [[p' || (page_id * 7) % 300 || ']]' AS body FROM pages)"
EDGES = r"ed AS (SELECT DISTINCT src, dst FROM (SELECT slug AS src, unnest(regexp_extract_all(body, '\[\[([^\]]+)\]\]', 1)) AS dst FROM nt) WHERE src <> dst)"
NODES = "nd AS (SELECT coalesce(slug, id) AS id, coalesce(ntype, 'unresolved') AS grp, coalesce(degree, 0) AS degree, 1 + coalesce(degree, 0) AS value FROM nt FULL JOIN (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ed UNION ALL SELECT dst FROM ed) GROUP BY id) ON slug = id)"
G = q.with_(NOTES, EDGES, NODES)


def notes(spark, d):
    p = F.col("page_id")
    link = lambda x: F.concat(F.lit("[[p"), x.cast("string"), F.lit("]]"))
    body = F.concat_ws(" ", link(p * 7 % 300), link(p), link(p * 3 % 260), link(p * 7 % 300))
    return read(spark, d, "pages").select(F.concat(F.lit("p"), p.cast("string")).alias("slug"), F.when(p % 3 == 0, "concept").otherwise("run").alias("ntype"), F.concat(F.lit("f"), (p % 4).cast("string")).alias("folder"), body.alias("body"), p.alias("n"))


def nodes(spark, d):
    return graph.nodes_of(notes(spark, d), graph.links_of(notes(spark, d)))


select("kg2_links", "SELECT src, dst FROM ed", lambda s, d: graph.links_of(notes(s, d)), G)
select("kg3_nodes", "SELECT id, grp, degree, value FROM nd", nodes, G)
select("jn13_unresolved", "SELECT id FROM nd WHERE grp = 'unresolved'", lambda s, d: nodes(s, d).where("grp = 'unresolved'").select("id"), G)
select("so3_node_ids", "SELECT slug AS id FROM nt UNION SELECT src FROM ed UNION SELECT dst FROM ed", lambda s, d: nodes(s, d).select("id"), G)
select("rk9_hubs", "SELECT id, degree FROM nd ORDER BY degree DESC, id LIMIT 8", lambda s, d: graph.hubs(nodes(s, d)).select("id", "degree"), G)
select("rk14_folder_index", "SELECT folder, slug FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY slug) AS r FROM nt) WHERE r <= 60", lambda s, d: graph.per_folder(notes(s, d)).select("folder", "slug"), G)
select("kg5_staleness", """SELECT coalesce(n.slug, e.slug) AS slug, CASE WHEN n.slug IS NULL THEN CASE WHEN e.pinned THEN 'pinned' WHEN DATE '2024-02-01' - e.updated > 30 THEN 'archive' ELSE 'keep' END WHEN e.slug IS NULL THEN 'new' WHEN e.pinned THEN 'pinned' WHEN n.through > e.through THEN 'new-data' WHEN DATE '2024-02-01' - e.updated >= 7 THEN 'stale' ELSE 'fresh' END AS decision
FROM (SELECT 'p' || page_id AS slug, DATE '2024-01-20' AS through FROM pages WHERE page_id % 5 <> 0) n FULL JOIN (SELECT 'p' || page_id AS slug, DATE '2024-02-01' - CAST(page_id % 40 AS INT) AS updated, DATE '2024-01-15' + CAST(page_id % 9 AS INT) AS through, page_id % 11 = 0 AS pinned FROM pages WHERE page_id % 7 <> 0) e ON n.slug = e.slug""", lambda s, d: staleness(s, d), "")


def staleness(spark, d):
    all_ = notes(spark, d)
    n, day = F.col("n"), lambda x: F.to_date(F.lit(x))
    mine = all_.where("n % 5 <> 0").select("slug", day("2024-01-20").alias("data_through"))
    old = all_.where("n % 7 <> 0").select("slug", F.date_sub(day("2024-02-01"), (n % 40).cast("int")).alias("updated"), F.date_add(day("2024-01-15"), (n % 9).cast("int")).alias("data_through"), (n % 11 == 0).alias("pinned"))
    return graph.decide(mine, old, day("2024-02-01"))


select("kg6_front_matter", "SELECT slug, ntype AS type FROM nt", lambda s, d: notes(s, d).withColumn("head", graph.front_matter(F.col("slug"), F.col("ntype"), F.array(F.lit("a"), F.lit("b")))).withColumn("m", graph.parse_front_matter(F.col("head"))).select(F.col("m")["slug"].alias("slug"), F.col("m")["type"].alias("type")), G)

# ---------------------------------------------------------------- streams

select("ss1_buckets", "SELECT event_id, CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS bucket FROM events", lambda s, d: tables.ticks(s, d).select("event_id", (F.floor(F.unix_timestamp("ts") / 300) * 300).alias("bucket")), "")
select("ss2_bars", f"SELECT {BARS} FROM bars", lambda s, d: stream_bars.bars(tables.ticks(s, d)).withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*BARS.split(", ")), q.with_(q.intraday()))
CLOSED = "bars_closed AS (SELECT * FROM bars WHERE ts + INTERVAL 60 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events))"


def _file_stream(spark, d):
    """A folder with a link to the events as a stream's source is what a driver has; here the one file is the stream."""
    return stream_bars.tick_stream(spark, f"{d}/events.parquet*")


@query("ss3_closed_bars", q.with_(q.intraday(), CLOSED) + f"SELECT {BARS} FROM bars_closed")
def closed_bars(spark, d):
    """Bars that the stream has closed when it has read all ticks."""
    out = stream_bars.drain(stream_bars.bars(_file_stream(spark, d)), tables.shared_folder(spark, "closed"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*BARS.split(", "))


@query("ss4_frame", q.with_(q.intraday(), CLOSED) + f"SELECT {BARS}, false AS current FROM bars_closed UNION ALL SELECT {BARS}, true FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars WHERE NOT EXISTS (SELECT 1 FROM bars_closed c WHERE c.symbol = bars.symbol AND c.ts = bars.ts)) WHERE r = 1")
def frame_with_current_bar(spark, d):
    """Closed bars and each symbol's newest open one."""
    closed = closed_bars(spark, d)
    now = stream_bars.bars(tables.ticks(spark, d)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return stream_bars.frame(closed, now).select(*BARS.split(", "), "current")


@query("ss6_each_batch", q.with_(q.intraday(), CLOSED) + "SELECT symbol, count(*) AS bars, round(sum(volume), 3) AS volume FROM bars_closed GROUP BY symbol")
def each_batch(spark, d):
    """Every batch of closed bars handed to a function, which appends what a strategy would see."""
    folder = tables.shared_folder(spark, "batches")
    act = lambda frame, batch: frame.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{folder}/seen")
    stream_bars.each_batch(stream_bars.bars(_file_stream(spark, d)), act, f"{folder}/state").awaitTermination()
    seen = spark.read.schema(f"{stream_bars.BAR}, batch long").parquet(f"{folder}/seen")
    return seen.groupBy("symbol").agg(F.count("*").alias("bars"), F.round(F.sum("volume"), 3).alias("volume"))


@query("ss7_stateful_positions")
def positions(spark, d):
    """Positions that the stateful consumer opens and closes: closed bars go to files, which are its stream. A fold; tests compare it
    with a plain loop."""
    folder = tables.shared_folder(spark, "positions")
    stream_bars.to_files(stream_bars.bars(_file_stream(spark, d)), f"{folder}/bars", f"{folder}/state")
    return stream_bars.drain(stream_bars.breakout_positions(stream_bars.bar_stream(spark, f"{folder}/bars")), f"{folder}/out")


@query("ss9_distinct_payloads", "SELECT DISTINCT sha256(props) AS input_hash FROM events")
def distinct_payloads(spark, d):
    """Payloads by hash, each once while the watermark remembers it."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").select(F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("ts"))
    return stream_bars.drain(stream_bars.distinct_payloads(rows), tables.shared_folder(spark, "payloads")).select("input_hash").distinct()
