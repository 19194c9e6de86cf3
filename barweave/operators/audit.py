"""Auditing a sweep: returns by strategy, overfitting by symmetric cross-validation, deflated Sharpe ratio, family-wise error."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.scalars import EULER, norm_cdf, norm_ppf, ppf
from barweave.functions.windows import forward_return

BLOCKS, SIGNIFICANT, FLAT = 14, 0.95, 1e-12


def strategy_returns(frame: DataFrame, names: list[str], horizon: int = 1, neutral: bool = True) -> DataFrame:
    """(ts, config, ret): stance times forward return a bar, over that of the market at the time if ``neutral``, averaged over symbols;
    configs that never vary are left out."""
    rows = frame.withColumn("_f", forward_return(horizon) / horizon)
    if neutral:
        rows = rows.withColumn("_f", F.col("_f") - F.avg("_f").over(Window.partitionBy("ts")))
    pairs = F.array(*(F.struct(F.lit(n).alias("config"), F.col(f"`{n}`").alias("stance")) for n in names))
    long = rows.where("_f is not null").select("ts", "_f", F.inline(pairs))
    out = long.groupBy("ts", "config").agg(F.avg(F.col("stance") * F.col("_f")).alias("ret"))
    return out.withColumn("_sd", F.stddev_samp("ret").over(Window.partitionBy("config"))).where(F.col("_sd") > FLAT).drop("_sd")


def series_stats(returns: DataFrame, by: str = "config") -> DataFrame:
    """n, Sharpe ratio (0 for flat or single values), skewness and plain kurtosis of each series."""
    sd, pop = F.stddev_samp("ret"), F.stddev_pop("ret")
    flat = (F.count("ret") < 3) | (pop < FLAT)
    return returns.groupBy(by).agg(
        F.count("ret").alias("n"), F.when((F.count("ret") >= 2) & (sd > FLAT), F.avg("ret") / sd).otherwise(0.0).alias("sharpe"),
        F.when(flat, 0.0).otherwise(F.skewness("ret")).alias("skew"), F.when(flat, 3.0).otherwise(F.kurtosis("ret") + 3).alias("kurtosis"),
    )


def overfitting(returns: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """One row: pbo, median_logit, prob_oos_loss, degradation_slope, n_splits, n_configs, over all balanced splits of ``blocks`` runs of time.

    ``returns`` is a matrix: every config has a row at every time. Each run of a config is reduced to count, sum and sum of squares
    (about the config's mean), and a split adds runs up, so the work is splits x configs x blocks whatever the number of rows. Splits
    are bit masks; they number C(blocks, blocks / 2). A config that is flat in half of the runs has ratio 0 there: that is told by its
    least and largest return, since a difference of sums leaves a rounding error, of either sign, in place of no variance.
    """
    series = Window.partitionBy("config")
    place = returns.withColumns({"_i": F.row_number().over(series.orderBy("ts")) - 1, "_t": F.count("*").over(series), "_m": F.avg("ret").over(series)})
    # The block of row i is the last whose lower bound, int(b * t / blocks), is not above i.
    bound = F.array(*(F.floor(F.col("_t") * b / F.lit(blocks)) for b in range(blocks)))
    centred = place.select("config", "_m", (F.col("ret") - F.col("_m")).alias("_c"), (F.size(F.filter(bound, lambda x: x <= F.col("_i"))) - 1).alias("block"))
    runs = centred.groupBy("config", "block").agg(F.count("*").alias("n"), F.sum("_c").alias("s"), F.sum(F.col("_c") * F.col("_c")).alias("q"), F.min("_c").alias("lo"), F.max("_c").alias("hi"), F.first("_m").alias("m"))
    spark = returns.sparkSession
    masks = spark.range(1 << blocks).where(F.bit_count("id") == blocks // 2).withColumnRenamed("id", "mask")
    inside = F.expr("shiftright(mask, block) & 1") == 1
    part = lambda c, flag: F.when(inside == flag, F.col(c))
    halves = (("is", F.lit(True)), ("oos", F.lit(False)))
    sums = [F.sum(F.coalesce(part(c, flag), F.lit(0))).alias(f"{c}_{k}") for c in ("n", "s", "q") for k, flag in halves]
    ranges = [(F.max(part("hi", flag)) - F.min(part("lo", flag))).alias(f"range_{k}") for k, flag in halves]
    cells = runs.join(F.broadcast(masks)).groupBy("mask", "config").agg(*sums, *ranges, F.first("m").alias("m"))

    def sharpe(k: str):
        n, s, q = (F.col(f"{c}_{k}") for c in ("n", "s", "q"))
        sd = F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))
        return F.when((n >= 2) & (F.col(f"range_{k}") > FLAT) & (sd > FLAT), (F.col("m") + s / n) / sd).otherwise(0.0)

    # A split's configs, some sixty at most, meet in one array.
    rated = cells.groupBy("mask").agg(F.collect_list(F.struct(sharpe("is").alias("x"), F.expr("-crc32(config)").alias("tie"), sharpe("oos").alias("y"))).alias("all"))
    ranked = rated.withColumn("best", F.array_max("all")).select("mask", F.size(F.filter("all", lambda c: c["y"] <= F.col("best.y"))).alias("r"), F.size("all").alias("n_configs"), F.col("best.x").alias("x"), F.col("best.y").alias("y"))
    share = F.least(F.greatest(F.col("r"), F.lit(1)), F.col("n_configs")) / (F.col("n_configs") + 1)
    logit = F.log(share / (1 - share))
    return ranked.withColumn("logit", logit).agg(
        F.avg((F.col("logit") <= 0).cast("int")).alias("pbo"), F.percentile("logit", F.lit(0.5)).alias("median_logit"), F.avg((F.col("y") < 0).cast("int")).alias("prob_oos_loss"),
        F.regr_slope("y", "x").alias("degradation_slope"), F.count("*").alias("n_splits"), F.max("n_configs").alias("n_configs"),
    )


def expected_max_sharpe(variance: float, trials: int) -> float:
    """The largest of so many Sharpe ratios without skill."""
    if trials < 2 or variance <= 0:
        return 0.0
    return math.sqrt(variance) * ((1 - EULER) * ppf(1 - 1 / trials) + EULER * ppf(1 - 1 / (trials * math.e)))


def expected_max_sharpe_column(variance, trials):
    luck = (1 - EULER) * norm_ppf(1 - 1 / trials) + EULER * norm_ppf(1 - 1 / (trials * math.e))
    return F.when((trials >= 2) & (variance > 0), F.sqrt(variance) * luck).otherwise(0.0)


def deflated_sharpe(stats: DataFrame, trials: int | None = None) -> DataFrame:
    """One row: of the best series of ``series_stats``, the probability that its ratio beats the luckiest of the trials (null if it
    can't be told): config, sharpe, luck, dsr, n_obs, n_trials, significant."""
    best = stats.agg(F.max_by(F.struct("config", "sharpe", "n", "skew", "kurtosis"), "sharpe").alias("b"), F.coalesce(F.var_samp("sharpe"), F.lit(0.0)).alias("v"), F.count("*").alias("c"))
    n = F.lit(trials) if trials else F.col("c")
    row = best.select("b.*", n.alias("n_trials"), expected_max_sharpe_column(F.col("v"), n).alias("luck"))
    sr = F.col("sharpe")
    spread = 1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4 * sr * sr
    dsr = F.when((F.col("n") >= 2) & (spread > 0), norm_cdf((sr - F.col("luck")) * F.sqrt(F.col("n") - 1) / F.sqrt(spread)))
    return row.select("config", "sharpe", "luck", dsr.alias("dsr"), F.col("n").alias("n_obs"), "n_trials", F.coalesce(dsr > SIGNIFICANT, F.lit(False)).alias("significant"))


def edge_error(edge_pp, signals, trials) -> dict:
    """Columns: error of an edge in points, its error probability alone and among so many trials, the edge that luck alone would show,
    and whether it survives both."""
    se = 100 * F.sqrt(0.25 / F.greatest(signals, F.lit(1)))
    single = 1 - norm_cdf(edge_pp / se)
    error, luck = 1 - F.pow(1 - single, trials), se * expected_max_sharpe_column(F.lit(1.0), trials)
    return {"p_single": single, "p_fwe": error, "luck_edge_pp": luck, "survives": (error < 0.05) & (edge_pp > luck)}


def family_wise(sweep: DataFrame, trials: int | None = None) -> DataFrame:
    """The best row of a sweep with its ``edge_error``; no row without a scored config."""
    best = sweep.where("oos_signals > 0").agg(F.max_by(F.struct("config", "horizon", "oos_signals", "oos_cond_edge_pp"), "oos_cond_edge_pp").alias("b"), F.count("*").alias("c")).where("c > 0")
    n = F.lit(trials) if trials else F.col("c")
    error = edge_error(F.col("b.oos_cond_edge_pp"), F.col("b.oos_signals"), n)
    return best.select("b.config", "b.horizon", F.col("b.oos_cond_edge_pp").alias("edge_pp"), F.col("b.oos_signals").alias("signals"), *(c.alias(k) for k, c in error.items()))


def reading(rows: DataFrame) -> DataFrame:
    """Adds to rows of pbo, dsr, significant, p_fwe and survives, any of them null: robust, summary."""
    percent = lambda c: F.bround(c * 100).cast("long").cast("string")
    said = F.concat_ws(
        " | ",
        F.when(F.col("pbo").isNotNull(), F.concat(F.lit("PBO "), percent(F.col("pbo")), F.lit("% ("), F.when(F.col("pbo") >= 0.5, "overfit").otherwise("robust"), F.lit(")"))),
        F.when(F.col("dsr").isNotNull(), F.concat(F.lit("DSR "), percent(F.col("dsr")), F.lit("% ("), F.when(F.col("significant"), "sig").otherwise("not sig"), F.lit(")"))),
        F.when(F.col("p_fwe").isNotNull(), F.concat(F.lit("FWE p "), F.format_string("%.2f", F.bround("p_fwe", 2)), F.lit(" ("), F.when(F.col("survives"), "survives").otherwise("noise"), F.lit(")"))),
    )
    holds = lambda c: F.coalesce(c, F.lit(False))
    return rows.withColumns({"robust": holds(F.col("pbo") < 0.5) & holds(F.col("significant")) & holds(F.col("survives")), "summary": said})


def verdict(pbo: DataFrame, dsr: DataFrame, fwe: DataFrame) -> DataFrame:
    """One reading of the three, each of one row at most: robust, summary."""
    first = lambda df, *names: df.agg(*(F.first(n).alias(n) for n in names))
    one = first(pbo, "pbo").join(first(dsr, "dsr", "significant")).join(first(fwe, "p_fwe", "survives"))
    return reading(one).select("robust", "summary")


def search_verdict(edge_pp, signals, tried):
    """A column: whether an edge beats the largest of so many chance edges, sqrt(2 ln N) standard errors, by one more."""
    error = 100 * F.sqrt(0.25 / F.greatest(signals, F.lit(1)))
    return edge_pp / error > F.sqrt(2 * F.log(F.greatest(tried, F.lit(2)))) + 1
