"""Investment returns and the stock screener."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def xirr(flows: Column, steps: int = 200) -> Column:
    """The yearly rate at which an array of (d, amt), in order of time, is worth nothing; null if [-0.9999, 10] holds no change of
    sign. By bisection, inside the JVM."""
    days = lambda f: F.datediff(f["d"], flows[0]["d"]) / 365.0
    worth = lambda rate: F.aggregate(flows, F.lit(0.0), lambda total, f: total + f["amt"] / F.pow(1 + rate, days(f)))
    lo, hi = F.lit(-0.9999), F.lit(10.0)
    start = F.struct(lo.alias("lo"), hi.alias("hi"), worth(lo).alias("at_lo"))

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        value = worth(mid)
        left = s["at_lo"] * value < 0
        return F.struct(F.when(left, s["lo"]).otherwise(mid).alias("lo"), F.when(left, mid).otherwise(s["hi"]).alias("hi"), F.when(left, s["at_lo"]).otherwise(value).alias("at_lo"))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(min(steps, 60))), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when((F.size(flows) >= 2) & (worth(lo) * worth(hi) <= 0), root)


def first_of_month(bars: DataFrame) -> DataFrame:
    month = Window.partitionBy("symbol", F.trunc("ts", "MM")).orderBy("ts")
    return bars.withColumn("_r", F.row_number().over(month)).where("_r = 1").drop("_r")


def flows_of(bars: DataFrame, monthly: float) -> tuple[DataFrame, DataFrame]:
    """(units and sums paid by symbol, the last close and day by symbol)."""
    paid = first_of_month(bars).where("close > 0").groupBy("symbol").agg(
        F.sum(monthly / F.col("close")).alias("units"), (F.count("*") * F.lit(monthly)).alias("invested"), F.count("*").alias("months"),
        F.array_sort(F.collect_list(F.struct(F.to_date("ts").alias("d"), F.lit(-monthly).alias("amt")))).alias("flows"),
    )
    last = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("last"), F.max(F.to_date("ts")).alias("day"), F.count("*").alias("n"))
    return paid, last


def monthly_plan(bars: DataFrame, monthly: float = 10_000.0) -> DataFrame:
    """By symbol: paid in, worth at the last close, return, yearly rate and number of payments on each month's first bar."""
    paid, last = flows_of(bars, monthly)
    rows = paid.join(last.where("n >= 2"), "symbol").withColumn("final_value", F.col("units") * F.col("last"))
    flows = F.concat("flows", F.array(F.struct(F.col("day").alias("d"), F.col("final_value").alias("amt"))))
    return rows.select("symbol", "invested", "final_value", ((F.col("final_value") / F.col("invested") - 1) * 100).alias("abs_return_pct"), (xirr(flows) * 100).alias("xirr_pct"), "months")


def portfolio_plan(bars: DataFrame, monthly: float = 10_000.0) -> DataFrame:
    """The same for all symbols as one portfolio, whose worth is dated at the last bar."""
    paid, last = flows_of(bars, monthly)
    rows = paid.join(last, "symbol")
    pays = rows.select(F.inline("flows")).groupBy("d").agg(F.sum("amt").alias("amt")).agg(F.array_sort(F.collect_list(F.struct("d", "amt"))).alias("flows"))
    end = rows.agg(F.sum(F.col("units") * F.col("last")).alias("final_value"), F.sum("invested").alias("invested"), F.max("day").alias("day"))
    both = end.join(F.broadcast(pays))
    flows = F.concat("flows", F.array(F.struct(F.col("day").alias("d"), F.col("final_value").alias("amt"))))
    return both.select("invested", "final_value", (xirr(flows) * 100).alias("xirr_pct"))


def lump_sum(bars: DataFrame) -> DataFrame:
    growth, years = F.col("last") / F.col("first"), F.datediff("to", "from") / 365.0
    ends = bars.groupBy("symbol").agg(F.min_by("close", "ts").alias("first"), F.max_by("close", "ts").alias("last"), F.min("ts").alias("from"), F.max("ts").alias("to"), F.count("*").alias("n")).where("n >= 2")
    return ends.select("symbol", ((growth - 1) * 100).alias("total_return_pct"), F.coalesce((F.pow(growth, 1 / F.nullif(years, F.lit(0.0))) - 1) * 100, F.lit(0.0)).alias("cagr_pct"), F.round(years, 1).alias("years"))


def snapshot(bars: DataFrame) -> DataFrame:
    """By symbol, as of its last bar: price, returns over 21, 126 and 252 bars (from the first bar if there are fewer), distance from the
    year's high and low, trend, RSI, volatility and setup. ``bars`` has ``rsi``."""
    back = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    rows = bars.withColumns({"b": F.row_number().over(back) - 1, "r": F.col("close") / F.lead("close").over(back) - 1})
    at = lambda k: F.coalesce(F.max(F.when(F.col("b") == k, F.col("close"))), F.min_by("close", "ts"))
    pct = lambda a, b: (a / b - 1) * 100
    wide = rows.groupBy("symbol").agg(
        F.count("*").alias("history"), F.max_by("close", "ts").alias("price"), *(at(k).alias(f"p{k}") for k in (21, 126, 252)),
        F.max(F.when(F.col("b") < 252, F.col("close"))).alias("hi"), F.min(F.when(F.col("b") < 252, F.col("close"))).alias("lo"),
        F.when(F.count("*") >= 200, F.avg(F.when(F.col("b") < 200, F.col("close")))).otherwise(F.avg("close")).alias("usual"),
        F.when(F.count("*") >= 15, F.max_by("rsi", "ts")).otherwise(50.0).alias("rsi"), F.coalesce(F.stddev_samp(F.when(F.col("b") < 252, F.col("r"))) * (252**0.5) * 100, F.lit(0.0)).alias("vol_pct"),
    )
    p = F.col("price")
    out = wide.select("symbol", "history", "price", *(pct(p, F.col(f"p{k}")).alias(f"ret_{n}") for k, n in ((21, "1m"), (126, "6m"), (252, "1y"))), pct(p, F.col("hi")).alias("from_high_pct"), pct(p, F.col("lo")).alias("from_low_pct"), (p > F.col("usual")).alias("trend_up"), "rsi", "vol_pct")
    return out.withColumn("setup", setup())


def setup() -> Column:
    """What a snapshot's rounded figures (the distance to a tenth, the RSI to a whole number) are called."""
    up, high = F.col("trend_up"), F.bround("from_high_pct", 1)
    return (
        F.when(F.col("history") < 60, "insufficient history").when(up & (high >= -3), "near-high uptrend").when(up & (high <= -12), "uptrend pullback")
        .when(up, "uptrend").when(F.bround("rsi", 0) < 35, "oversold downtrend").otherwise("downtrend")
    )


def by_category(rows: DataFrame) -> DataFrame:
    """Gainers, losers (all others, so no change counts as a loss) and symbols of each category."""
    gained = F.sum((F.col("ret_1y") > 0).cast("long"))
    return rows.groupBy("category").agg(F.count("*").alias("symbols"), gained.alias("gainers"), (F.count("*") - gained).alias("losers"))
