"""DuckDB SQL for the queries of ``catalogue``, written apart from the Spark operators."""

from __future__ import annotations

W = "PARTITION BY symbol ORDER BY ts"

DAILY = """lines AS (SELECT p_type AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS q, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (SELECT symbol, ts, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(q) AS volume FROM lines GROUP BY symbol, ts)"""


def intraday(minutes: int = 60, name: str = "bars") -> str:
    return f"""{name} AS (SELECT event_type AS symbol, make_timestamp(CAST(floor(epoch(ts) / {60 * minutes}) AS BIGINT) * {60 * minutes} * 1000000) AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS volume FROM events GROUP BY ALL)"""


#: Recursive indicators, one bar a step, over numbered bars.
FOLDS = f"""numbered AS MATERIALIZED (SELECT *, row_number() OVER ({W}) AS rn, close - lag(close) OVER ({W}) AS d, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr FROM bars),
folds AS (
  SELECT symbol, rn, close AS pc, close AS ema_9, close AS ema_12, close AS ema_20, close AS ema_21, close AS ema_26, close AS ema_50, close AS ema_200, CAST(0 AS DOUBLE) AS macd_signal,
    CAST(NULL AS DOUBLE) AS ag, CAST(NULL AS DOUBLE) AS al, tr AS atr, tr AS atr10, (high + low) / 2 + 3 * tr AS fu, (high + low) / 2 - 3 * tr AS fl, 1 AS dir FROM numbered WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, pc, ema_9, ema_12, ema_20, ema_21, ema_26, ema_50, ema_200, macd_signal + (ema_12 - ema_26 - macd_signal) * 0.2, ag, al, atr, atr10,
    CASE WHEN u < fu OR lc > fu THEN u ELSE fu END, CASE WHEN l > fl OR lc < fl THEN l ELSE fl END, CASE WHEN pc > fu THEN 1 WHEN pc < fl THEN -1 ELSE dir END
  FROM (SELECT f.symbol, n.rn, n.close AS pc, f.pc AS lc, {", ".join(f"f.ema_{n} + (n.close - f.ema_{n}) * (2.0::DOUBLE / {n + 1}) AS ema_{n}" for n in (9, 12, 20, 21, 26, 50, 200))}, f.macd_signal,
      CASE WHEN f.ag IS NULL THEN greatest(n.d, 0) ELSE f.ag + (greatest(n.d, 0) - f.ag) / 14 END AS ag, CASE WHEN f.al IS NULL THEN greatest(-n.d, 0) ELSE f.al + (greatest(-n.d, 0) - f.al) / 14 END AS al,
      f.atr + (n.tr - f.atr) / 14 AS atr, f.atr10 + (n.tr - f.atr10) / 10 AS atr10,
      (n.high + n.low) / 2 + 3 * (f.atr10 + (n.tr - f.atr10) / 10) AS u, (n.high + n.low) / 2 - 3 * (f.atr10 + (n.tr - f.atr10) / 10) AS l, f.fu, f.fl, f.dir
    FROM folds f JOIN numbered n ON n.symbol = f.symbol AND n.rn = f.rn + 1)),
ind AS MATERIALIZED (SELECT n.*, {", ".join(f"ema_{n}" for n in (9, 12, 20, 21, 26, 50, 200))}, ema_12 - ema_26 AS macd, macd_signal, ema_12 - ema_26 - macd_signal AS macd_hist,
  coalesce(100 - 100 / (1 + ag / nullif(al, 0)), 100) AS rsi, atr, CASE WHEN n.rn = 1 OR dir = 1 THEN fl ELSE fu END AS supertrend, dir AS supertrend_dir
  FROM numbered n JOIN folds f USING (symbol, rn))"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def over(n: int, prior: bool = False) -> str:
    return f"({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" if prior else f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int, prior: bool = False) -> str:
    w = over(n, prior)
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {f}({x}) OVER {w} END"


def quant(x: str, n: int, q: float) -> str:
    return f"CASE WHEN count({x}) OVER {over(n)} = {n} THEN quantile_cont({x}, {q}) OVER {over(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def pick(a: str, b: str) -> str:
    return f"CASE WHEN {a} THEN 1 WHEN {b} THEN -1 ELSE 0 END"


def sgn(x: str) -> str:
    return f"CAST(coalesce(sign({x}), 0) AS INTEGER)"


def sma(n: int, x: str = "close") -> str:
    return f"({roll('avg', x, n)})"


def boll(n: int, k: float) -> str:
    sd = f"({roll('stddev_pop', 'close', n)})"
    return pick(f"close < {sma(n)} - {k} * {sd}", f"close > {sma(n)} + {k} * {sd}")


def rule(family: str, p: dict) -> str:
    """The stance of a configuration over the rows of ``base``."""
    g = p.get
    busy = f"volume > {sma(20, 'volume')} * {g('vol_mult', 1.0)}"
    if family == "ema_cross":
        return sgn(f"ema_{p['fast']} - ema_{p['slow']}")
    if family == "momentum":
        return sgn(f"close / {lag('close', p['lookback'])} - 1")
    if family == "rsi_reversion":
        return pick(f"rsi < {p['low']}", f"rsi > {p['high']}")
    if family == "rsi_pro_trend":
        above = f"coalesce(close > {sma(200)}, false)"
        return pick(f"{above} AND rsi > {p['mid']}", f"NOT {above} AND rsi < {p['mid']}")
    if family == "boll_reversion":
        return boll(p["period"], p["num_std"])
    if family == "ret_z_fade":
        z = f"(r - ({roll('avg', 'r', p['window'])})) / nullif(({roll('stddev_pop', 'r', p['window'])}), 0)"
        return pick(f"{z} < -{p['k']}", f"{z} > {p['k']}")
    if family == "streak_fade":
        n = p["n"]
        return pick(*(f"sum(CAST(coalesce(d {s} 0, false) AS INT)) OVER {over(n)} = {n}" for s in "<>"))
    if family == "donchian":
        return pick(f"close > ({roll('max', 'high', p['n'], True)})", f"close < ({roll('min', 'low', p['n'], True)})")
    if family == "gap_fade":
        gap = f"(open - {lag('close')}) / nullif(atr, 0)"
        return pick(f"{gap} < -{p['k']}", f"{gap} > {p['k']}")
    if family == "vol_trend":
        return f"CASE WHEN atr / close < ({quant('atrp', p['window'], 0.5)}) THEN {sgn(f'ema_{p["fast"]} - ema_{p["slow"]}')} ELSE 0 END"
    if family == "vol_reversion":
        return f"CASE WHEN atr / close > ({quant('atrp', p['window'], 0.5)}) THEN {boll(p['period'], p['num_std'])} ELSE 0 END"
    if family == "drift_rider":
        return pick(f"close > {sma(p['n'])}", "false")
    if family == "always_long":
        return "1"
    if family == "ensemble":
        votes = f"({sgn('ema_9 - ema_21')} + {sgn('macd_hist')} + supertrend_dir + {sgn(f'close / {lag("close", 20)} - 1')} + {sgn(f'close - {sma(200)}')})"
        return pick(f"{votes} >= {p['k']}", f"{votes} <= -{p['k']}")
    if family == "adaptive_rsi":
        return pick(f"rsi < ({quant('rsi', p['window'], p['q_low'])})", f"rsi > ({quant('rsi', p['window'], p['q_high'])})")
    if family == "range_fade":
        hi, lo = f"({roll('max', 'high', p['n'])})", f"({roll('min', 'low', p['n'])})"
        place = f"(close - {lo}) / nullif({hi} - {lo}, 0)"
        return pick(f"{place} < {p['low']}", f"{place} > {p['high']}")
    if family in ("tri_ma", "tri_ma_vol"):
        f, m, s = (sma(p[k]) for k in ("fast", "mid", "slow"))
        core = pick(f"{f} > {m} AND {m} > {s}", f"{f} < {m} AND {m} < {s}")
        return core if family == "tri_ma" else f"CASE WHEN {busy} THEN {core} ELSE 0 END"
    if family == "rsi_ma_vol":
        a, b = (f"rsi < {p['dip']}", f"rsi > {100 - p['dip']}") if p["style"] == "dip" else (f"rsi > {p['mid']}", f"rsi < {100 - p['mid']}")
        return f"CASE WHEN {busy} THEN {pick(f'close > {sma(p["n"])} AND {a}', f'close < {sma(p["n"])} AND {b}')} ELSE 0 END"
    if family == "overnight":
        return sgn(f"({roll('sum', 'night' if p['mode'] == 'overnight' else 'tug', p['n'])})")
    if family == "turn_of_month":
        m = "PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts"
        return f"CASE WHEN row_number() OVER ({m}) - 1 < {p['after']} OR row_number() OVER ({m} DESC) - 1 < {p['before']} THEN 1 ELSE {-1 if p['rest'] == 'short' else 0} END"
    if family == "low_vol_reversal":
        return f"CASE WHEN volume < {sma(p['vol_window'], 'volume')} * {p['vol_mult']} THEN -{sgn(f'close / {lag("close", p["n"])} - 1')} ELSE 0 END"
    if family == "near_52w":
        return pick(f"close >= ({roll('max', 'high', p['n'], True)}) * (1 - {p['band']})", f"close <= ({roll('min', 'low', p['n'], True)}) * (1 + {p['band']})")
    raise KeyError(family)


BASE = f"""base AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r, open / lag(close) OVER ({W}) - 1 AS night, open / lag(close) OVER ({W}) - 1 - (close / open - 1) AS tug, atr / close AS atrp FROM ind)"""


def stance_rows(configs: list[tuple[str, str, dict]], keep: str = "symbol, ts") -> str:
    """A table ``st`` of (keep, config, stance)."""
    wide = ", ".join(f"{rule(f, p)} AS c{i}" for i, (_, f, p) in enumerate(configs))
    pairs = ", ".join(f"struct_pack(config := '{name}', stance := c{i})" for i, (name, _, _) in enumerate(configs))
    return f"""wide AS MATERIALIZED (SELECT {keep}, {wide} FROM base),
st AS (SELECT {keep}, u.config AS config, u.stance AS stance FROM (SELECT {keep}, unnest([{pairs}]) AS u FROM wide))"""


REGIME = pick(f"close > {sma(50)} AND {sma(50)} > {sma(200)}", f"close < {sma(50)} AND {sma(50)} < {sma(200)}")
MACD = sgn("macd - macd_signal")
EMA_CROSS = sgn("ema_9 - ema_21")
RSI_REV = pick("rsi < 30", "rsi > 70")
SINGLE = {
    "rsi_reversion": RSI_REV, "ema_cross": EMA_CROSS, "sma_cross": sgn(f"{sma(50)} - {sma(200)}"), "macd": MACD, "boll_reversion": boll(20, 2.0), "boll_breakout": f"-({boll(20, 2.0)})",
    "supertrend": "supertrend_dir", "price_vs_sma200": sgn(f"close - {sma(200)}"), "momentum_20": sgn(f"close / {lag('close', 20)} - 1"),
}
SMA_V = sma(20, "volume")
JOINT = {
    "pullback_in_trend": pick(f"({REGIME}) = 1 AND rsi < 40", f"({REGIME}) = -1 AND rsi > 60"),
    "triple_trend": pick(f"{EMA_CROSS} = 1 AND {MACD} = 1 AND supertrend_dir = 1", f"{EMA_CROSS} = -1 AND {MACD} = -1 AND supertrend_dir = -1"),
    "reversion_in_range": f"CASE WHEN ({REGIME}) = 0 THEN {boll(20, 2.0)} ELSE 0 END",
    "rsi_in_range": f"CASE WHEN ({REGIME}) = 0 THEN {RSI_REV} ELSE 0 END",
    "trend_volume": f"CASE WHEN volume > {SMA_V} THEN {pick(f'({REGIME}) = 1 AND {EMA_CROSS} = 1', f'({REGIME}) = -1 AND {EMA_CROSS} = -1')} ELSE 0 END",
}
LOWER, UPPER = f"({sma(20)} - 2.0 * ({roll('stddev_pop', 'close', 20)}))", f"({sma(20)} + 2.0 * ({roll('stddev_pop', 'close', 20)}))"
TRADEABLE = {
    "mean_reversion": pick(f"close < {LOWER} AND rsi < 30", f"close > {UPPER} AND rsi > 70"),
    "rsi": RSI_REV,
    "pullback_in_trend": pick(f"close > {sma(200)} AND {sma(50)} > {sma(200)} AND rsi < 40", f"close < {sma(200)} AND {sma(50)} < {sma(200)} AND rsi > 60"),
    "candidate": rule("rsi_ma_vol", {"style": "dip", "n": 200, "dip": 35, "vol_mult": 1.5}),
}


def named_rows(rules: dict[str, str], keep: str = "symbol, ts") -> str:
    wide = ", ".join(f"{sql} AS c{i}" for i, sql in enumerate(rules.values()))
    pairs = ", ".join(f"struct_pack(config := '{name}', stance := c{i})" for i, name in enumerate(rules))
    return f"""wide AS MATERIALIZED (SELECT {keep}, {wide} FROM base),
st AS (SELECT {keep}, u.config AS config, u.stance AS stance FROM (SELECT {keep}, unnest([{pairs}]) AS u FROM wide))"""
