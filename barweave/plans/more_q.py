"""Queries on pooled accuracy, merges of results, archives and small functions."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from barweave.functions import scalars
from barweave.operators import evaluate as e
from barweave.operators import news, stances
from barweave.plans import sqltext as q
from barweave.plans.catalogue import SQL, query
from barweave.plans.evaluate_q import ALIGNED, BOLL, HEAD, STAT_OUT, VERDICT, boll_frame, cols4, moves, rounded, sweep_sql
from barweave.plans.indicators_q import DAYS, folded
from barweave.plans.strategy_q import RET, matrix
from barweave.sources.tables import daily_bars, read, shared_folder

MOM = stances.configs(["momentum"])


def momentum_stats(spark, d):
    counts, base = e.sweep_counts(e.split(stances.stances(daily_bars(spark, d), MOM)), [n for n, _, _ in MOM])
    return e.slice_stats(counts, base)


@query("ag17_slice_stats", sweep_sql(MOM) + STAT_OUT)
def slice_stats(spark, d):
    return rounded(momentum_stats(spark, d))


@query("pf19_signal_floor", sweep_sql(MOM) + "SELECT config, horizon, slice FROM stat WHERE signals >= CASE slice WHEN 'is' THEN 300 ELSE 150 END")
def signal_floor(spark, d):
    least = F.when(F.col("slice") == "is", e.MIN_IS).otherwise(e.MIN_OOS)
    return momentum_stats(spark, d).where(F.col("signals") >= least).select("config", "horizon", "slice")


@query("pf20_varying_configs", RET + "SELECT config, count(*) AS n FROM m GROUP BY config")
def varying(spark, d):
    return matrix(spark, d).groupBy("config").agg(F.count("*").alias("n"))


@query("jn4_mean_over_symbols", RET + "SELECT ts, round(avg(ret), 5) AS ret FROM m GROUP BY ts")
def mean_over_symbols(spark, d):
    return matrix(spark, d).groupBy("ts").agg(F.round(F.avg("ret"), 5).alias("ret"))


@query("jn6_signals_on_bars", DAYS[:-1] + f", s AS (SELECT symbol, ts, {q.boll(20, 2.0)} AS direction FROM bars) SELECT b.symbol, b.ts, coalesce(x.direction, 0) AS direction FROM bars b LEFT JOIN (SELECT * FROM s WHERE direction <> 0) x USING (symbol, ts)")
def signals_on_bars(spark, d):
    bars = daily_bars(spark, d)
    given = bars.select("symbol", "ts", stances.boll_reversion().alias("direction")).where("direction <> 0")
    return bars.join(given, ["symbol", "ts"], "left").select("symbol", "ts", F.coalesce("direction", F.lit(0)).alias("direction"))


@query("jn9_config_bars", HEAD + q.stance_rows(BOLL) + " SELECT config, stance, count(*) AS bars FROM st GROUP BY ALL")
def config_bars(spark, d):
    return stances.unpivot(boll_frame(spark, d), [n for n, _, _ in BOLL], []).groupBy("config", "stance").agg(F.count("*").alias("bars"))


@query("jn10_balanced_splits", "WITH b AS (SELECT CAST(dense_rank() OVER (ORDER BY n_regionkey * 100 + n_nationkey % 3) - 1 AS INT) AS block, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey), k AS (SELECT CAST(count(DISTINCT block) AS INT) // 2 * 2 AS n FROM b), s AS (SELECT block, sum(cents) AS s FROM b GROUP BY block), m AS (SELECT range AS mask FROM range(65536), k WHERE range < (1 << n) AND bit_count(range::INT) = n // 2) SELECT mask, CAST(sum(CASE WHEN (mask >> block) & 1 = 1 THEN s ELSE 0 END) AS BIGINT) AS one, CAST(sum(CASE WHEN (mask >> block) & 1 = 0 AND block < n THEN s ELSE 0 END) AS BIGINT) AS other FROM m, s, k GROUP BY mask")
def splits(spark, d):
    """All balanced splits of the blocks that nations fall into, with the sums of balances, in cents, on either side."""
    nation = read(spark, d, "nation").withColumn("key", F.col("n_regionkey") * 100 + F.col("n_nationkey") % 3)
    sums = read(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("key").agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("s"))
    blocks = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "s"))), lambda x: x["s"]).alias("s"))  # 15 blocks at most
    n = F.floor(F.size("s") / 2) * 2
    masks = blocks.select("s", n.alias("n"), F.explode(F.expr("sequence(0, shiftleft(1, cast(floor(size(s) / 2) * 2 as int)) - 1)")).alias("mask")).where(F.bit_count("mask") == F.col("n") / 2)
    side = lambda bit: F.aggregate(F.sequence(F.lit(0), F.col("n").cast("int") - 1), F.lit(0).cast("long"), lambda acc, i: acc + F.when(F.getbit("mask", i) == bit, F.get("s", i)).otherwise(F.lit(0).cast("long")))
    return masks.select(F.col("mask").cast("long").alias("mask"), side(1).alias("one"), side(0).alias("other"))


@query("jn14_hall_of_fame", sweep_sql(MOM) + "SELECT config, arg_max(horizon, row(cond_edge_pp, -horizon)) AS horizon, round(max(cond_edge_pp), 4) AS edge FROM stat WHERE slice = 'oos' GROUP BY config")
def hall_of_fame(spark, d):
    """Keeps the better of the old and the new entry of each config: two halves of the horizons are merged."""
    rows = momentum_stats(spark, d).where("slice = 'oos'").select("config", "horizon", F.col("cond_edge_pp").alias("edge"))
    both = rows.where("horizon <= 5").unionByName(rows.where("horizon > 5"))
    return rounded(both.groupBy("config").agg(F.max_by("horizon", F.struct("edge", -F.col("horizon"))).alias("horizon"), F.max("edge").alias("edge")))


@query("rk7_elites", sweep_sql(MOM) + "SELECT config, horizon FROM stat WHERE slice = 'oos' ORDER BY cond_edge_pp DESC, config, horizon LIMIT 12")
def elites(spark, d):
    return momentum_stats(spark, d).where("slice = 'oos'").orderBy(F.desc("cond_edge_pp"), "config", "horizon").limit(12).select("config", "horizon")


@query("ag10_pooled_rsi_accuracy", HEAD + moves((1, 3, 5, 10)) + f""", s AS (SELECT symbol, ts, {q.RSI_REV} AS d FROM base), k AS (SELECT symbol, m.h AS horizon, count(*) FILTER (d <> 0) AS n, avg(CAST(sign(m.f) = d AS INT)) FILTER (d <> 0) AS acc FROM mv JOIN s USING (symbol, ts) WHERE m.f IS NOT NULL GROUP BY ALL)
SELECT horizon, CAST(sum(n) AS BIGINT) AS signals, round(sum(acc * n) / sum(n), 4) AS accuracy FROM k GROUP BY horizon""")
def pooled_rsi(spark, d):
    rows = e.hold_by_horizon(folded(spark, d).withColumn("direction", stances.rsi_reversion(30, 70)), (1, 3, 5, 10)).where("direction <> 0")
    by = rows.groupBy("symbol", "horizon").agg(F.count("*").alias("n"), F.avg((F.signum("move") == F.col("direction")).cast("int")).alias("acc"))
    return rounded(by.groupBy("horizon").agg(F.sum("n").alias("signals"), (F.sum(F.col("acc") * F.col("n")) / F.sum("n")).alias("accuracy")))


@query("ag20_cross_section_guard", q.with_(q.DAILY, ALIGNED) + "SELECT count(DISTINCT symbol) >= 5 AND count(DISTINCT ts) >= 300 AS available FROM p")
def guard(spark, d):
    panel = e.aligned(daily_bars(spark, d))
    return panel.agg(((F.count_distinct("symbol") >= 5) & (F.count_distinct("ts") >= 300)).alias("available"))


@query("vp6_spread_rows", f"SELECT * FROM ({SQL['ag19_cross_section']}) WHERE slice = 'is' AND signals >= 300 ORDER BY spread_pp DESC, lookback, horizon LIMIT 6")
def spread_rows(spark, d):
    """The widest spreads in sample; out of sample the six symbols here leave none above 0."""
    rows = rounded(e.cross_section(daily_bars(spark, d))).where("slice = 'is'").where(F.col("signals") >= e.MIN_IS)
    return rows.orderBy(F.desc("spread_pp"), "lookback", "horizon").limit(6)


@query("vp9_archive_rows", sweep_sql(MOM) + VERDICT + f"SELECT config, split_part(config, '[', 1) AS family, horizon, {cols4('oos_accuracy')} FROM v")
def archive_rows(spark, d):
    """A sweep's rows written as JSON and read again with their schema."""
    rows = e.verdicts(momentum_stats(spark, d)).select("config", "horizon", "oos_accuracy")
    packed = rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct("config", "horizon", "oos_accuracy")))).alias("archive"))
    back = packed.select(F.inline(F.from_json("archive", "array<struct<config:string,horizon:int,oos_accuracy:double>>")))
    return back.select("config", F.substring_index("config", "[", 1).alias("family"), "horizon", F.round("oos_accuracy", 4).alias("oos_accuracy"))


@query("src13_json_archive", sweep_sql(MOM) + "SELECT config, horizon, slice, signals, round(accuracy, 6) AS accuracy FROM stat")
def json_archive(spark, d):
    """A sweep written as JSON lines and read again with its schema."""
    path = shared_folder(spark, "archive")
    momentum_stats(spark, d).write.json(path)
    back = spark.read.schema("config string, horizon int, slice string, signals long, accuracy double").json(path)
    return back.withColumn("accuracy", F.round("accuracy", 6))


@query("sc01_sign", DAYS + f"SELECT symbol, ts, {q.sgn(f'close - lag(close) OVER ({q.W})')} AS s FROM bars")
def sign(spark, d):
    return daily_bars(spark, d).select("symbol", "ts", scalars.sign(F.col("close") - F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))).alias("s"))


@query("sc02_gain_loss", DAYS + f"SELECT symbol, ts, CASE WHEN d IS NOT NULL THEN round(greatest(d, 0), 3) END AS gain, CASE WHEN d IS NOT NULL THEN round(greatest(-d, 0), 3) END AS loss FROM (SELECT symbol, ts, close - lag(close) OVER ({q.W}) AS d FROM bars)")
def gain_loss(spark, d):
    step = F.col("close") - F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))
    rows = daily_bars(spark, d).select("symbol", "ts", step.alias("d"))
    return rows.select("symbol", "ts", F.round(scalars.positive_part(F.col("d")), 3).alias("gain"), F.round(scalars.positive_part(-F.col("d")), 3).alias("loss"))


@query("sc03_safe_ratio", DAYS + "SELECT symbol, ts, round((close - open) / nullif(high - low, 0), 4) AS body FROM bars")
def safe_ratio(spark, d):
    return rounded(daily_bars(spark, d).select("symbol", "ts", scalars.ratio(F.col("close") - F.col("open"), F.col("high") - F.col("low")).alias("body")))


@query("sc04_finite", DAYS + "SELECT symbol, ts, round(coalesce((close - open) / nullif(high - low, 0), 0), 4) AS body FROM bars")
def finite(spark, d):
    return rounded(daily_bars(spark, d).select("symbol", "ts", scalars.finite(scalars.ratio(F.col("close") - F.col("open"), F.col("high") - F.col("low"))).alias("body")))


@query("sc11_query_urls", "SELECT DISTINCT p_type AS symbol, 'https://news.example.org/search?q=' || url_encode(p_type || ' stock') AS url FROM part")
def query_urls(spark, d):
    named = F.concat(F.lit("https://news.example.org/search?q="), F.replace(F.url_encode(F.concat(F.col("symbol"), F.lit(" stock"))), F.lit("+"), F.lit("%20")))
    return read(spark, d, "part").select(F.col("p_type").alias("symbol")).distinct().withColumn("url", named)


@query("sc12_epoch", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def epoch(spark, d):
    return read(spark, d, "events").select("event_id", F.coalesce(F.unix_timestamp(F.col("ts").cast("timestamp")), F.lit(0)).alias("seconds"))


@query("sc15_required_keys", "SELECT event_id, json_exists(props, '$.k') AS valid FROM events")
def required_keys(spark, d):
    return news.with_json(read(spark, d, "events"), "props", ("k",)).select("event_id", "valid")


@query("kg4_distinct_links", "SELECT page_id, list_sort(list_distinct(list_filter([page_id * 7 % 300, page_id, page_id * 3 % 260, page_id * 7 % 300], lambda x: x <> page_id)))::VARCHAR AS links FROM pages")
def distinct_links(spark, d):
    p = F.col("page_id")
    links = F.array_sort(F.array_distinct(F.filter(F.array(p * 7 % 300, p, p * 3 % 260, p * 7 % 300), lambda x: x != p)))
    return read(spark, d, "pages").select("page_id", F.concat(F.lit("["), F.array_join(links.cast("array<string>"), ", "), F.lit("]")).alias("links"))
