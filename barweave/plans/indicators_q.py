"""Queries on indicators, patterns and stances."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from barweave.functions import blocks
from barweave.functions import windows as w
from barweave.functions.scalars import ratio
from barweave.operators import patterns, stances
from barweave.operators.folds import ALL, with_folds
from barweave.plans import sqltext as q
from barweave.plans.catalogue import query
from barweave.sources.tables import daily_bars, intraday_bars

DAYS = q.with_(q.DAILY)
FOLDED = q.with_(q.DAILY, q.FOLDS, q.BASE)


def r4(x, name: str):
    return F.round(x, 4).alias(name)


def _simple(name: str, columns: dict, sql: str, intraday: bool = False, plain: tuple = (), reach: tuple[int, int] | None = None):
    """A query of window columns over bars; all but ``plain`` ones are rounded. ``reach``: how many bars back and ahead the columns read,
    for those that are built block by block; the others have windows of a day or a month."""
    rounded = ", ".join(f"{sql_} AS {c}" if c in plain else f"round({sql_}, 4) AS {c}" for c, sql_ in zip(columns, sql.split(";"), strict=True))
    text = (q.with_(q.intraday()) if intraday else DAYS) + f"SELECT symbol, ts, {rounded} FROM bars"

    @query(name, text)
    def run(spark, d):
        bars = intraday_bars(spark, d) if intraday else daily_bars(spark, d)
        ts = F.col("ts").cast("timestamp_ntz").alias("ts")
        if reach:
            rows = blocks.rolling(bars, ["symbol", "ts"], columns, *reach)
            return rows.select("symbol", ts, *(c if c in plain else r4(F.col(c), c) for c in columns))
        return bars.select("symbol", ts, *(f().alias(c) if c in plain else r4(f(), c) for c, f in columns.items()))


C, O, H, L = "close", "open", "high", "low"
_simple("in01_sma", {"sma_5": lambda: w.sma(C, 5), "sma_20": lambda: w.sma(C, 20), "sma_200": lambda: w.sma(C, 200)}, f"{q.sma(5)};{q.sma(20)};{q.sma(200)}", reach=(200, 0))
_simple("in02_bollinger", {"lower": lambda: w.bollinger()[0], "upper": lambda: w.bollinger()[1]}, f"{q.LOWER};{q.UPPER}", reach=(20, 0))
_simple("in03_true_range", {"tr": w.true_range}, f"greatest(high - low, abs(high - {q.lag(C)}), abs(low - {q.lag(C)}))", reach=(1, 0))
VW = "PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts"
_simple("in04_session_vwap", {"vwap": w.session_vwap}, f"sum((high + low + close) / 3 * volume) OVER ({VW}) / nullif(sum(volume) OVER ({VW}), 0)", intraday=True)
_simple("in05_prior_channel", {"top": lambda: w.highest(H, 20, True), "bottom": lambda: w.lowest(L, 20, True)}, f"{q.roll('max', H, 20, True)};{q.roll('min', L, 20, True)}", plain=("top", "bottom"), reach=(20, 0))
_simple("in10_volume_confirm", {"busy": lambda: F.coalesce(stances.busy(1.5), F.lit(False))}, f"coalesce(volume > {q.sma(20, 'volume')} * 1.5, false)", plain=("busy",), reach=(20, 0))
_simple("in11_change", {"r_1": lambda: w.change(1), "r_20": lambda: w.change(20)}, f"close / {q.lag(C)} - 1;close / {q.lag(C, 20)} - 1", reach=(20, 0))
_simple("in12_range_position", {"place": lambda: stances.range_position(14)}, f"(close - ({q.roll('min', L, 14)})) / nullif(({q.roll('max', H, 14)}) - ({q.roll('min', L, 14)}), 0)", reach=(14, 0))
M = "PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts"
_simple("in14_month_place", {"from_start": lambda: stances.month_place()[0].cast("long"), "from_end": lambda: stances.month_place()[1].cast("long")}, f"row_number() OVER ({M}) - 1;row_number() OVER ({M} DESC) - 1", plain=("from_start", "from_end"))
_simple("in15_year_extremes", {"below_high": lambda: ratio(F.col(C), w.highest(H, 252, True)), "above_low": lambda: ratio(F.col(C), w.lowest(L, 252, True))}, f"close / ({q.roll('max', H, 252, True)});close / ({q.roll('min', L, 252, True)})", reach=(252, 0))
_simple("in19_regime", {"regime": stances.regime}, q.REGIME, plain=("regime",), reach=(200, 0))
_simple("cp1_engulfing", {"engulfing": patterns.engulfing}, q.pick(f"{q.lag(C)} < {q.lag(O)} AND close > open AND open <= {q.lag(C)} AND close >= {q.lag(O)}", f"{q.lag(C)} > {q.lag(O)} AND close < open AND open >= {q.lag(C)} AND close <= {q.lag(O)}"), plain=("engulfing",), reach=(1, 0))
_simple("cp2_hammer", {"hammer": patterns.hammer}, q.pick("abs(close - open) > 0 AND least(open, close) - low >= 2 * abs(close - open) AND high - greatest(open, close) <= abs(close - open)", "false"), plain=("hammer",))
_simple("cp3_doji", {"doji": patterns.doji}, "coalesce(abs(close - open) / nullif(high - low, 0), 1.0) <= 0.1", plain=("doji",))
_simple("sc24_forward_return", {"f_5": lambda: w.forward_return(5)}, f"lead(close, 5) OVER ({q.W}) / close - 1", reach=(0, 5))

NIGHT = f"(SELECT *, close - {q.lag(C)} AS d, close / {q.lag(C)} - 1 AS r, open / {q.lag(C)} - 1 AS night, close / open - 1 AS session FROM bars)"


def prepared_in_blocks(bars, columns: dict, back: int):
    """Window columns over what ``stances.prepare`` adds, which reads one bar more."""
    rows = blocks.in_blocks(blocks.number(bars), back + 1)
    with w.keyed("symbol", "_block"):
        rows = rows.withColumns(stances.changes())
        built = [f().alias(c) for c, f in columns.items()]
    return rows.select("symbol", "ts", *built, "_own").where("_own").drop("_own")


@query("in08_zscore", DAYS + f"SELECT symbol, ts, round((r - ({q.roll('avg', 'r', 20)})) / nullif(({q.roll('stddev_pop', 'r', 20)}), 0), 4) AS z FROM {NIGHT}")
def zscore(spark, d):
    return prepared_in_blocks(daily_bars(spark, d), {"z": lambda: stances.zscore(20)}, 20).select("symbol", "ts", r4(F.col("z"), "z"))


@query("in09_streak", DAYS + f"SELECT symbol, ts, {q.rule('streak_fade', {'n': 3})} AS stance FROM {NIGHT}")
def streak(spark, d):
    return prepared_in_blocks(daily_bars(spark, d), {"stance": lambda: stances.streak_fade(3)}, 3)


@query("in13_night_session", DAYS + f"SELECT symbol, ts, round({q.roll('sum', 'night', 5)}, 4) AS night_5, round({q.roll('sum', 'session', 5)}, 4) AS session_5 FROM {NIGHT}")
def night_session(spark, d):
    bars = daily_bars(spark, d).withColumn("session", F.col("close") / F.col("open") - 1)
    rows = prepared_in_blocks(bars, {"night_5": lambda: w.rolling_sum("night", 5), "session_5": lambda: w.rolling_sum("session", 5)}, 5)
    return rows.select("symbol", "ts", r4(F.col("night_5"), "night_5"), r4(F.col("session_5"), "session_5"))


@query("in17_annual_volatility", DAYS + f"SELECT symbol, round(stddev_samp(r) * sqrt(252) * 100, 4) AS vol_pct FROM (SELECT symbol, r, row_number() OVER ({q.W} DESC) AS b FROM {NIGHT}) WHERE b <= 252 GROUP BY symbol")
def volatility(spark, d):
    back = F.row_number().over(w.Window.partitionBy("symbol").orderBy(F.desc("ts")))
    rows = stances.prepare(daily_bars(spark, d)).withColumn("back", back).where("back <= 252")
    return rows.groupBy("symbol").agg(r4(F.stddev_samp("r") * F.sqrt(F.lit(252.0)) * 100, "vol_pct"))


ORB = "PARTITION BY symbol, CAST(ts AS DATE)"


@query("in18_opening_range", q.with_(q.intraday(), f"n AS (SELECT *, row_number() OVER ({ORB} ORDER BY ts) AS rn, count(*) OVER ({ORB}) AS c FROM bars)") + f"SELECT symbol, ts, CASE WHEN c > 6 THEN max(high) FILTER (rn <= 6) OVER ({ORB}) END AS top, CASE WHEN c > 6 THEN min(low) FILTER (rn <= 6) OVER ({ORB}) END AS bottom, rn FROM n")
def opening_range(spark, d):
    hi, lo, number = w.opening_range(6)
    return intraday_bars(spark, d).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), hi.alias("top"), lo.alias("bottom"), number.cast("long").alias("rn"))


@query("st41_opening_range_breakout", q.with_(q.intraday(), f"n AS (SELECT *, row_number() OVER ({ORB} ORDER BY ts) AS rn, count(*) OVER ({ORB}) AS c FROM bars)") + f"SELECT symbol, ts, CASE WHEN c > 6 AND rn > 6 AND close < min(low) FILTER (rn <= 6) OVER ({ORB}) THEN -1 WHEN c > 6 AND rn > 6 AND close > max(high) FILTER (rn <= 6) OVER ({ORB}) THEN 1 ELSE 0 END AS stance FROM n")
def breakout(spark, d):
    return intraday_bars(spark, d).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), stances.opening_range_breakout().alias("stance"))


CURVE = f"c AS (SELECT symbol, ts, exp(sum(ln(1 + coalesce(r, 0))) OVER ({q.W})) AS equity FROM {NIGHT})"


@query("in20_equity_drawdown", q.with_(q.DAILY, CURVE) + f"SELECT symbol, ts, round(equity, 4) AS equity, round(equity / max(equity) OVER ({q.W}) - 1, 4) AS drawdown FROM c")
def equity(spark, d):
    curve = blocks.curve(stances.prepare(daily_bars(spark, d)), "r", ("symbol",))
    return curve.select("symbol", "ts", r4(F.col("equity"), "equity"), r4(F.col("drawdown"), "drawdown"))


def folded(spark, d, want: tuple = ALL):
    return stances.prepare(with_folds(daily_bars(spark, d), want=want))


def _folded(name: str, columns: dict, sql: str, want: tuple, plain: tuple = ()):
    rounded = ", ".join(f"{s} AS {c}" if c in plain else f"round({s}, 4) AS {c}" for c, s in zip(columns, sql.split(";"), strict=True))

    @query(name, FOLDED + f"SELECT symbol, ts, {rounded} FROM base")
    def run(spark, d):
        with w.Shared() as shared:
            built = [f().alias(c) if c in plain else r4(f(), c) for c, f in columns.items()]
        rows = shared.on(folded(spark, d, want))
        return rows.select("symbol", "ts", *built)


_folded("in06_rolling_median", {"usual": lambda: w.quantile("atrp", 100, 0.5)}, q.quant("atrp", 100, 0.5), ("atr",))
_folded("in07_rolling_quantile", {"q10": lambda: w.quantile("rsi", 250, 0.1), "q90": lambda: w.quantile("rsi", 250, 0.9)}, f"{q.quant('rsi', 250, 0.1)};{q.quant('rsi', 250, 0.9)}", ("rsi",))
_folded("in16_gap_atr", {"gap": lambda: ratio(F.col("open") - w.lag("close"), F.col("atr"))}, f"(open - {q.lag('close')}) / nullif(atr, 0)", ("atr",))
_folded("rc1_ema", {f"ema_{n}": partial(F.col, f"ema_{n}") for n in (9, 21, 50, 200)}, "ema_9;ema_21;ema_50;ema_200", ("ema",))
_folded("rc2_rsi", {"rsi": partial(F.col, "rsi")}, "rsi", ("rsi",))
_folded("rc3_atr", {"atr": partial(F.col, "atr")}, "atr", ("atr",))
_folded("rc4_macd", {"macd": partial(F.col, "macd"), "macd_signal": partial(F.col, "macd_signal"), "macd_hist": partial(F.col, "macd_hist")}, "macd;macd_signal;macd_hist", ("macd",))
_folded("rc5_supertrend", {"supertrend": partial(F.col, "supertrend"), "supertrend_dir": partial(F.col, "supertrend_dir")}, "supertrend;supertrend_dir", ("supertrend",), plain=("supertrend_dir",))
BUNDLE = ("ema_9", "ema_21", "atr", "rsi", "supertrend", "supertrend_dir")
_folded("rc6_bundle", {c: partial(F.col, c) for c in BUNDLE} | {"vwap": w.session_vwap}, ";".join(BUNDLE) + f";sum((high + low + close) / 3 * volume) OVER ({VW}) / nullif(sum(volume) OVER ({VW}), 0)", ("ema", "rsi", "atr", "supertrend"), plain=("supertrend_dir",))
_folded("rc7_trend", {"trend": lambda: stances.ema_cross(9, 21)}, q.EMA_CROSS, ("ema",), plain=("trend",))


def _family(number: int, family: str):
    chosen = stances.configs([family])

    @query(f"st{number:02d}_{family}", FOLDED[:-1] + ",\n" + q.stance_rows(chosen) + "\nSELECT symbol, ts, config, stance FROM st")
    def run(spark, d):
        frame = stances.stances(with_folds(daily_bars(spark, d), want=stances.reads([family])), chosen)
        return stances.unpivot(frame, [n for n, _, _ in chosen], ["symbol", "ts"])


for _i, _f in enumerate(stances.GRID):
    _family(_i + 1, _f)


def _named(name: str, rules: dict, sql: dict):
    @query(name, FOLDED[:-1] + ",\n" + q.named_rows(sql) + "\nSELECT symbol, ts, config, stance FROM st")
    def run(spark, d):
        frame = folded(spark, d, ALL if {"supertrend", "triple_trend"} & {*rules} else ("ema", "macd", "rsi", "atr")).select("symbol", "ts", *(f().cast("int").alias(n) for n, f in rules.items()))
        return stances.unpivot(frame, list(rules), ["symbol", "ts"])


for _i, _n in enumerate(stances.INDICATORS):
    _named(f"st{24 + _i}_{_n}", {_n: stances.INDICATORS[_n]}, {_n: q.SINGLE[_n]})
for _i, _n in enumerate(stances.CONFLUENCE):
    _named(f"st{33 + _i}_{_n}", {_n: stances.CONFLUENCE[_n]}, {_n: q.JOINT[_n]})
for _i, _n in zip((38, 39, 40, 43), stances.TRADEABLE, strict=True):
    _named(f"st{_i}_{_n}_signals", {_n: stances.TRADEABLE[_n]}, {_n: q.TRADEABLE[_n]})


@query("st42_signal_frame", FOLDED + f"SELECT symbol, ts, CAST(s AS DOUBLE) AS score, s AS direction, CAST(CASE WHEN s <> 0 THEN 1 ELSE 0 END AS DOUBLE) AS confidence, s <> 0 AS entered FROM (SELECT symbol, ts, {q.boll(20, 2.0)} AS s FROM base)")
def signal_frame(spark, d):
    return stances.signals(daily_bars(spark, d), stances.boll_reversion())


@query("st44_random_control")
def random_control(spark, d):
    return stances.random_signals(daily_bars(spark, d), 0.1, seed=7)


@query("st45_daily_quota")
def quota(spark, d):
    return stances.daily_quota(daily_bars(spark, d), 2, seed=7)
