"""Scoring stances against forward returns: hit rates, in- and out-of-sample sweeps, cross-sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions import blocks
from barweave.functions.windows import by_symbol, forward_return, lag, lead

# Fixed values of the sweep.
HORIZONS = (1, 3, 5, 10, 20, 40, 60)
TRAIN, MIN_IS, MIN_OOS, TARGET, EDGE_OOS, EDGE_IS = 0.70, 300, 150, 0.60, 2.0, 1.0
MIN_BARS, MIN_BARS_ACCURACY = 260, 220


def long_enough(bars: DataFrame, n: int) -> DataFrame:
    """Bars of the symbols that have at least n."""
    every = Window.partitionBy("symbol")
    return bars.withColumn("_n", F.count("*").over(every)).where(F.col("_n") >= n).drop("_n")


def split(bars: DataFrame, train: float = TRAIN) -> DataFrame:
    """Adds ``slice``: the first int(n * train) bars of a symbol are ``is``, the rest ``oos``."""
    number, total = F.row_number().over(by_symbol()), F.count("*").over(Window.partitionBy("symbol"))
    return bars.withColumn("slice", F.when(number <= F.floor(total * F.lit(train)), "is").otherwise("oos"))


def sweep_counts(frame: DataFrame, names: list[str], horizons=HORIZONS) -> tuple[DataFrame, DataFrame]:
    """(counts by config, horizon and slice; base by horizon and slice) of bars with slice and one stance column a config.

    Forward returns come first, one column a horizon; configs are then rows, and the horizons are conditional sums of one aggregation
    with a partial step before its shuffle.
    """
    move = {h: f"move_{h}" for h in horizons}
    rows = frame.withColumns({m: F.signum(forward_return(h)).cast("int") for h, m in move.items()})
    pairs = F.array(*(F.struct(F.lit(n).alias("config"), F.col(f"`{n}`").alias("stance")) for n in names))
    bets = rows.select("slice", *move.values(), F.inline(pairs)).where("stance <> 0")
    stance = F.col("stance")
    figures = {
        "n": lambda m: F.count(m), "hits": lambda m: F.count_if(m == stance), "up": lambda m: F.count_if(m > 0), "dn": lambda m: F.count_if(m < 0),
        "long": lambda m: F.count_if(m.isNotNull() & (stance == 1)), "short": lambda m: F.count_if(m.isNotNull() & (stance == -1)),
    }
    wide = bets.groupBy("config", "slice").agg(*(f(F.col(m)).alias(f"{c}_{h}") for h, m in move.items() for c, f in figures.items()))
    counts = wide.select("config", "slice", F.inline(F.array(*(F.struct(F.lit(h).alias("horizon"), *(F.col(f"{c}_{h}").alias(c) for c in figures)) for h in horizons)))).where("n > 0")
    base = rows.groupBy("slice").agg(*(x for h, m in move.items() for x in (F.count(m).alias(f"valid_{h}"), F.count_if(F.col(m) > 0).alias(f"base_up_{h}"))))
    base = base.select("slice", F.inline(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"valid_{h}").alias("valid"), F.col(f"base_up_{h}").alias("base_up")) for h in horizons)))).where("valid > 0")
    return counts, base


def slice_stats(counts: DataFrame, base: DataFrame) -> DataFrame:
    """Accuracy, the best constant bet on the same bars, the drift, and the edges over both, in points."""
    up = F.col("base_up") / F.col("valid")
    return counts.join(F.broadcast(base), ["horizon", "slice"]).select(
        "config", "horizon", "slice", F.col("n").alias("signals"), (F.col("n") / F.col("valid")).alias("coverage"), (F.col("hits") / F.col("n")).alias("accuracy"),
        (F.greatest("up", "dn") / F.col("n")).alias("cond_base"), ((F.col("hits") - F.greatest("up", "dn")) / F.col("n") * 100).alias("cond_edge_pp"),
        F.greatest(up, 1 - up).alias("global_base"), ((F.col("hits") / F.col("n") - F.greatest(up, 1 - up)) * 100).alias("global_edge_pp"), "long", "short",
    )


def verdicts(stats: DataFrame, min_is: int = MIN_IS, min_oos: int = MIN_OOS) -> DataFrame:
    """One row a config and horizon with enough signals in both slices: their figures and the flags raw_60, real_edge and
    drift_rider."""
    pick = lambda s, c: F.max(F.when(F.col("slice") == s, F.col(c))).alias(f"{s}_{c}")
    wide = stats.groupBy("config", "horizon").agg(*(pick(s, c) for s in ("is", "oos") for c in ("signals", "accuracy", "cond_edge_pp")))
    rows = wide.where((F.col("is_signals") >= min_is) & (F.col("oos_signals") >= min_oos))
    raw = F.col("oos_accuracy") >= TARGET
    real = (F.col("oos_cond_edge_pp") >= EDGE_OOS) & (F.col("is_cond_edge_pp") >= EDGE_IS)
    return rows.withColumns({"raw_60": raw, "real_edge": real, "drift_rider": raw & ~real})


def sweep(frame: DataFrame, names: list[str], horizons=HORIZONS, min_is: int = MIN_IS, min_oos: int = MIN_OOS) -> DataFrame:
    counts, base = sweep_counts(split(long_enough(frame, MIN_BARS)), names, horizons)
    return verdicts(slice_stats(counts, base), min_is, min_oos)


def hit_rates(frame: DataFrame, names: list[str], horizon: int = 5, busy=None) -> DataFrame:
    """By rule: signals, coverage, accuracy, base, edge_pp; with ``busy`` (a condition) also those of signals where it holds."""
    rows = frame.withColumns({"move": F.signum(forward_return(horizon)).cast("int"), "busy": F.coalesce(busy, F.lit(False)) if busy is not None else F.lit(False)}).where("move is not null")
    pairs = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("stance")) for n in names))
    hit, bet, also = F.col("move") == F.col("stance"), F.col("stance") != 0, F.col("busy")
    total = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    agg = rows.select("move", "busy", F.inline(pairs)).groupBy("rule").agg(F.count("*").alias("bars"), total(F.col("move") > 0).alias("up"), total(bet).alias("signals"), total(bet & hit).alias("hits"), total(bet & also).alias("vol_signals"), total(bet & also & hit).alias("vol_hits"))
    up = F.col("up") / F.col("bars")
    out = agg.withColumns({"coverage": F.col("signals") / F.col("bars"), "accuracy": F.col("hits") / F.nullif("signals", F.lit(0)), "base": F.greatest(up, 1 - up)})
    out = out.withColumn("edge_pp", (F.col("accuracy") - F.col("base")) * 100)
    if busy is None:
        return out.select("rule", "signals", "coverage", "accuracy", "base", "edge_pp")
    vol = F.col("vol_hits") / F.nullif("vol_signals", F.lit(0))
    return out.select("rule", "signals", F.col("accuracy").alias("base_acc"), "vol_signals", vol.alias("vol_acc"), ((vol - F.col("accuracy")) * 100).alias("delta_pp"), ((vol - F.col("base")) * 100).alias("vol_edge_pp"))


def aligned(bars: DataFrame) -> DataFrame:
    """Bars of the times at which every symbol has one: a count a time and a semi-join."""
    symbols = bars.select(F.count_distinct("symbol").alias("symbols"))
    full = bars.groupBy("ts").agg(F.count_distinct("symbol").alias("n")).join(F.broadcast(symbols), F.col("n") == F.col("symbols"), "left_semi").select("ts")
    return bars.join(full, "ts", "left_semi")


def cross_section(bars: DataFrame, lookbacks=(20, 60, 120), horizons=(5, 10, 20), quantile: float = 0.2, train: float = TRAIN) -> DataFrame:
    """Long the strongest and short the weakest symbols at each aligned time: signals, accuracy, mean returns and their spread by
    lookback, horizon and slice. Ties go by the symbol's name. Needs five symbols and 300 aligned times, else no rows."""
    panel = aligned(long_enough(bars, MIN_BARS)).select("symbol", "ts", "close")
    sizes = panel.agg(F.count_distinct("symbol").alias("names"), F.count_distinct("ts").alias("dates"))
    number = F.row_number().over(by_symbol())
    looks = F.array(*(F.struct(F.lit(n).alias("lookback"), (F.col("close") / lag("close", n) - 1).alias("strength")) for n in lookbacks))
    moves = F.array(*(F.struct(F.lit(h).alias("horizon"), forward_return(h).alias("move")) for h in horizons))
    rows = panel.withColumns({"number": number, "looks": looks, "moves": moves}).select("symbol", "ts", "number", "moves", F.inline("looks")).where("strength is not null")
    rank = F.row_number().over(Window.partitionBy("ts", "lookback").orderBy("strength", "symbol"))
    rows = rows.withColumn("rank", rank).join(F.broadcast(sizes.where("names >= 5 and dates >= 300")))
    k = F.greatest(F.lit(1), F.bround(F.col("names") * quantile).cast("int"))
    side = F.when(F.col("rank") > F.col("names") - k, 1).when(F.col("rank") <= k, -1)
    bets = rows.withColumns({"side": side, "slice": F.when(F.col("number") <= F.floor(F.col("dates") * F.lit(train)), "is").otherwise("oos")}).where("side is not null")
    bets = bets.select("lookback", "slice", "side", F.inline("moves")).where("move is not null")
    up, down = (F.avg(F.when(F.col("side") == s, F.col("move"))) * 100 for s in (1, -1))
    return bets.groupBy("lookback", "horizon", "slice").agg(
        F.count("*").alias("signals"), F.avg((F.signum("move") == F.col("side")).cast("int")).alias("accuracy"), up.alias("long_mean_pp"), down.alias("short_mean_pp"), (up - down).alias("spread_pp")
    )


def rotation(bars: DataFrame, lookback: int = 126, top: int = 5, every: int = 21) -> DataFrame:
    """(ts, portfolio, market): returns of holding, from each ``every``-th aligned time on, the ``top`` symbols by trailing return, and
    of holding all. Weights are set with one bar's delay."""
    panel = aligned(bars).select("symbol", "ts", "close")
    panel = panel.withColumns({"number": F.row_number().over(by_symbol()) - 1, "r": F.coalesce(F.col("close") / lag("close") - 1, F.lit(0.0)), "trail": F.col("close") / lag("close", lookback) - 1})
    panel = panel.withColumn("period", F.floor(F.col("number") / every))
    picked = panel.where((F.col("number") % every == 0) & (F.col("number") >= lookback))
    strong = picked.withColumn("place", F.row_number().over(Window.partitionBy("ts").orderBy(F.desc("trail"), "symbol"))).where(F.col("place") <= top).select("symbol", "period", F.lit(1).alias("held"))
    held = panel.join(strong, ["symbol", "period"], "left").withColumn("weight", F.coalesce("held", F.lit(0)) / F.greatest(F.sum(F.coalesce("held", F.lit(0))).over(Window.partitionBy("ts")), F.lit(1)))
    lagged = F.coalesce(F.lag("weight").over(by_symbol()), F.lit(0.0))
    return held.withColumn("gain", lagged * F.col("r")).groupBy("ts").agg(F.sum("gain").alias("portfolio"), F.avg("r").alias("market"))


def curve_stats(returns: DataFrame, column: str, periods: int = 252) -> DataFrame:
    """total_return_pct, cagr_pct, sharpe and max_dd_pct of one series of returns."""
    rows = blocks.curve(returns.select("ts", F.coalesce(column, F.lit(0.0)).alias("_r")), "_r")
    final, n, sd = F.max_by("equity", "ts"), F.count("*"), F.stddev_samp("_r")
    return rows.agg(((final - 1) * 100).alias("total_return_pct"), ((F.pow(final, periods / n) - 1) * 100).alias("cagr_pct"), F.coalesce(F.avg("_r") / F.nullif(sd, F.lit(0.0)) * (periods**0.5), F.lit(0.0)).alias("sharpe"), (F.min("drawdown") * 100).alias("max_dd_pct"))


def hold_trades(frame: DataFrame, horizon: int, cost: float = 0.0) -> DataFrame:
    """A row for each signal held ``horizon`` bars; holds that the data doesn't complete are left out."""
    rows = frame.withColumns({"exit_date": lead("ts", horizon), "gross_ret": F.col("direction") * forward_return(horizon)})
    return rows.where("direction <> 0 and gross_ret is not null").select("symbol", F.col("ts").alias("entry_date"), "exit_date", "direction", "gross_ret", (F.col("gross_ret") - cost).alias("net_ret"))


def daily_pnl(trades: DataFrame, by: tuple = ()) -> DataFrame:
    return trades.groupBy(*by, "exit_date").agg((F.sum("net_ret") * 100).alias("pnl_pct"), F.count("*").alias("trades"))


def hold_by_horizon(frame: DataFrame, horizons, cost: float = 0.0) -> DataFrame:
    """``hold_trades`` of all horizons at once: one pass over the bars."""
    holds = F.array(*(F.struct(F.lit(h).alias("horizon"), lead("ts", h).alias("exit_date"), forward_return(h).alias("move")) for h in horizons))
    rows = frame.withColumn("holds", holds).select("symbol", F.col("ts").alias("entry_date"), "direction", F.inline("holds")).where("move is not null")
    return rows.withColumns({"gross_ret": F.col("direction") * F.col("move"), "net_ret": F.col("direction") * F.col("move") - cost})


def costed_verdict(trades: DataFrame, least: int = 20) -> DataFrame:
    """By symbol: trades, mean and median net return a trade, and whether they are plausible: a gain on average, more won than lost, and
    at least so many."""
    net = F.col("net_ret")
    won, lost = F.sum(F.when(net > 0, net)), F.nullif(-F.sum(F.when(net < 0, net)), F.lit(0.0))
    good = (F.avg(net) > 0) & (F.coalesce(won / lost, F.lit(1e9)) > 1) & (F.count("*") >= least)
    return trades.groupBy("symbol").agg(F.count("*").alias("trades"), (F.avg(net) * 100).alias("avg_trade_pct"), (F.percentile(net, F.lit(0.5)) * 100).alias("median_trade_pct"), good.alias("plausible"))


def horizon_table(frame: DataFrame, horizons=range(1, 13), cost: float = 0.0) -> DataFrame:
    """By symbol and horizon: signals, win rate, winning and losing days, net returns, the base up-rate and the edge over it."""
    rows = hold_by_horizon(frame, horizons, cost)
    keys = ["symbol", "horizon"]
    base = rows.groupBy(*keys).agg(F.avg((F.col("move") > 0).cast("int")).alias("base_up_rate"))
    bets = rows.where("direction <> 0")
    days = daily_pnl(bets, tuple(keys)).groupBy(*keys).agg(F.sum((F.col("pnl_pct") > 0).cast("long")).alias("profit_days"), F.sum((F.col("pnl_pct") < 0).cast("long")).alias("loss_days"))
    mine = bets.groupBy(*keys).agg(F.count("*").alias("signals"), F.avg((F.col("gross_ret") > 0).cast("int")).alias("win_rate"), (F.avg("net_ret") * 100).alias("avg_ret_pct"), (F.sum("net_ret") * 100).alias("total_pnl_pct"))
    out = base.join(mine, keys, "left").join(days, keys, "left").na.fill(0, ["signals", "profit_days", "loss_days"]).na.fill(0.0, ["avg_ret_pct", "total_pnl_pct"])
    return out.withColumn("edge_vs_base", F.col("win_rate") - F.greatest("base_up_rate", 1 - F.col("base_up_rate")))


def pooled_horizons(table: DataFrame) -> DataFrame:
    """Over symbols, rates weighted by signals; total returns summed."""
    pool = lambda c: (F.sum(F.col(c) * F.col("signals")) / F.nullif(F.sum("signals"), F.lit(0))).alias(c)
    return table.groupBy("horizon").agg(F.sum("signals").alias("signals"), pool("win_rate"), pool("avg_ret_pct"), pool("edge_vs_base"), F.sum("total_pnl_pct").alias("total_pnl_pct"))


def trade_metrics(trades: DataFrame, capital: float, by: tuple = (), order: tuple = ("exit_time",)) -> DataFrame:
    """Of trades with a pnl: counts, win rate, expectancy, profit factor (null stands for unlimited), drawdown from the running
    peak after each trade, return and a plain Sharpe ratio."""
    run = Window.partitionBy(*(by or (F.lit(0),))).orderBy(*order)
    run = run.rowsBetween(Window.unboundedPreceding, 0)
    curve = trades.withColumn("_equity", capital + F.sum("pnl").over(run))
    curve = curve.withColumn("_peak", F.max("_equity").over(run)).withColumn("_fall", F.col("_equity") - F.col("_peak"))
    pnl = F.col("pnl")
    won, lost, sd = F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)), F.coalesce(-F.sum(F.when(pnl < 0, pnl)), F.lit(0.0)), F.stddev_pop("pnl")
    return curve.groupBy(*by).agg(
        F.count("*").alias("trades"), F.avg((pnl > 0).cast("int")).alias("win_rate"), F.avg("pnl").alias("expectancy"), F.sum("pnl").alias("total_pnl"),
        F.coalesce(F.avg(F.when(pnl > 0, pnl)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(pnl < 0, pnl)), F.lit(0.0)).alias("avg_loss"),
        F.when(lost > 0, won / lost).when(won > 0, F.lit(None)).otherwise(0.0).alias("profit_factor"), F.min("_fall").alias("max_drawdown"),
        F.when(F.min("_peak") > 0, F.min(F.col("_fall") / F.col("_peak")) * 100).otherwise(0.0).alias("max_drawdown_pct"), (F.sum("pnl") / capital * 100).alias("return_pct"),
        F.when((F.count("*") > 1) & (sd > 0), F.avg("pnl") / sd).otherwise(0.0).alias("sharpe"),
    )
