"""As-of alignment, votes and their weighted score, and the gates of the confluence strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.scalars import choose, ratio, sign
from barweave.functions.windows import by_symbol, lag, session_vwap
from barweave.operators import patterns

# Fixed values of the strategy.
THRESHOLD, UNANIMOUS, MIN_ATR_PCT, OPEN, CLOSE = 0.6, 0.999, 0.15, "09:45", "15:00"
VOTES = ("ema_cross", "supertrend", "vwap", "rsi", "engulfing", "hammer")


def as_of(base: DataFrame, other: DataFrame, value: str, default=0) -> DataFrame:
    """Each base row with the latest ``value`` of ``other`` (symbol, ts, value) at its time or before; ``default`` where there is none
    or where the latest is null (a null is not passed over for an older value).

    Both sides are tagged, merged and swept once by symbol and time: one shuffle and one sort, no join.
    """
    left = base.withColumns({"_row": F.lit(1), "_value": F.lit(None)})
    right = other.select("symbol", "ts", F.lit(0).alias("_row"), F.struct(F.col(value).alias("v")).alias("_value"))
    swept = left.drop("_value").unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy("symbol").orderBy("ts", "_row").rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last("_value", ignorenulls=True).over(order)["v"], F.lit(default))
    return swept.withColumn(value, found).where("_row = 1").select(*base.columns, value)


def completed_trend(bars: DataFrame) -> DataFrame:
    """(symbol, ts, trend): the sign of the averages' difference on the last bar that was complete when this one began."""
    return bars.select("symbol", "ts", lag(sign(F.col("ema_9") - F.col("ema_21"))).alias("trend"))


def votes() -> dict[str, Column]:
    rsi = F.col("rsi")
    return {
        "ema_cross": sign(F.col("ema_9") - F.col("ema_21")), "supertrend": F.col("supertrend_dir"), "vwap": sign(F.col("close") - session_vwap()),
        "rsi": choose((rsi > 50) & (rsi < 70), (rsi > 30) & (rsi < 50)), "engulfing": patterns.engulfing(), "hammer": patterns.hammer(),
    }


def with_votes(bars: DataFrame) -> DataFrame:
    return bars.select("*", *(v.cast("int").alias(f"vote_{n}") for n, v in votes().items()))


def with_score(frame: DataFrame, weights: dict[str, float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (weighted mean vote, missing weights count 1), direction, confidence and entered."""
    w = {n: (weights or {}).get(n, 1.0) for n in VOTES}
    total = sum(w.values()) or 1.0
    score = sum((F.col(f"vote_{n}") * w[n] for n in VOTES), F.lit(0.0)) / total
    return frame.withColumn("score", score).withColumns({"direction": sign(F.col("score")), "confidence": F.abs("score"), "entered": F.abs("score") >= threshold})


def gate(frame: DataFrame, trend: str | None = None, unanimous: bool = False, min_atr_pct: float = 0.0, window: tuple[str, str] | None = None, invert: bool = False) -> DataFrame:
    """The optional conditions of an entry; ``invert`` turns the direction after them."""
    keep = F.col("entered")
    if trend:
        keep = keep & (F.col("direction") == F.col(trend)) & (F.col("direction") != 0)
    if unanimous:
        keep = keep & (F.col("confidence") >= UNANIMOUS)
    if min_atr_pct > 0:
        keep = keep & (F.coalesce(ratio(F.col("atr"), F.col("close")), F.lit(0.0)) * 100 >= min_atr_pct)
    if window:
        keep = keep & F.date_format("ts", "HH:mm:ss").between(f"{window[0]}:00", f"{window[1]}:00")
    out = frame.withColumn("entered", keep)
    return out.withColumn("direction", -F.col("direction")) if invert else out


def latest(frame: DataFrame) -> DataFrame:
    """By symbol: the last bar's signal and the map of its votes."""
    row = F.struct("ts", "score", "direction", "entered", *(f"vote_{n}" for n in VOTES))
    last = frame.groupBy("symbol").agg(F.max_by(row, "ts").alias("s"))
    found = F.map_from_arrays(F.array(*map(F.lit, VOTES)), F.array(*(F.col(f"s.vote_{n}") for n in VOTES)))
    return last.select("symbol", "s.ts", "s.score", "s.direction", "s.entered", found.alias("votes"))


def outcomes(frame: DataFrame, names: list[str], horizon: int = 12, target: float = 1.5, stop: float = 0.75) -> DataFrame:
    """By signal: wins, losses and win_rate (null if none is decided). A signal wins if the target is touched within ``horizon`` bars
    before the stop; the stop comes first within a bar."""
    ahead = by_symbol().rowsBetween(1, horizon)
    bars = frame.withColumn("_next", F.collect_list(F.struct("high", "low")).over(ahead))
    pairs = F.array(*(F.struct(F.lit(n).alias("signal"), F.col(n).alias("side")) for n in names))
    bets = bars.select("close", "_next", F.inline(pairs)).where("side <> 0")
    up, down = 1 + F.lit(target) / 100, 1 - F.lit(target) / 100
    win, lose = F.col("close") * F.when(F.col("side") > 0, up).otherwise(down), F.col("close") * F.when(F.col("side") > 0, 1 - F.lit(stop) / 100).otherwise(1 + F.lit(stop) / 100)
    bets = bets.withColumns({"_win": win, "_lose": lose})
    hit = lambda b: F.when(F.when(F.col("side") > 0, b["low"] <= F.col("_lose")).otherwise(b["high"] >= F.col("_lose")), -1).when(F.when(F.col("side") > 0, b["high"] >= F.col("_win")).otherwise(b["low"] <= F.col("_win")), 1).otherwise(0)
    first = F.try_element_at(F.filter(F.transform("_next", hit), lambda x: x != 0), F.lit(1))
    done = bets.withColumn("outcome", first).groupBy("signal").agg(F.sum((F.col("outcome") == 1).cast("long")).alias("wins"), F.sum((F.col("outcome") == -1).cast("long")).alias("losses"))
    done = done.na.fill(0, ["wins", "losses"])
    return done.withColumn("win_rate", F.col("wins") / F.nullif(F.col("wins") + F.col("losses"), F.lit(0)))


def calibrate(frame: DataFrame, horizon: int = 12, target: float = 1.5, stop: float = 0.75) -> DataFrame:
    """The weight of each vote: how often it wins."""
    return outcomes(frame, [f"vote_{n}" for n in VOTES], horizon, target, stop)
