"""Event-driven replay of bars: a fold over one symbol's bars, or over a whole session where symbols share one account."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.operators.costs import Costs, Risk

TRADES = "symbol string, side string, qty int, entry_time timestamp_ntz, entry_price double, exit_time timestamp_ntz, exit_price double, charges double, pnl double, reason string"


def trip_charges(entry: float, exit_: float, qty: int, side: int, c: Costs) -> float:
    """``costs.charges`` for numbers."""
    buy, sell = (entry, exit_) if side > 0 else (exit_, entry)
    buy, sell = buy * qty, sell * qty
    fees = sum(min(c.brokerage_per_order, c.brokerage_pct * v) for v in (buy, sell))
    taxed = fees + (buy + sell) * (c.exchange_txn_pct + c.sebi_per_crore / 1e7)
    return taxed * (1 + c.gst_pct) + sell * c.stt_sell_pct + buy * c.stamp_buy_pct


@dataclass
class Account:
    """The guards of a trading day: realised loss, trades, open positions."""

    risk: Risk
    lost: float = 0.0
    opened: int = 0
    held: int = 0

    def new_day(self) -> None:
        self.lost, self.opened = 0.0, 0

    def may_open(self) -> bool:
        halt = self.lost <= -self.risk.capital * self.risk.daily_loss_halt_pct / 100
        return not halt and self.opened < self.risk.max_trades_per_day and self.held < self.risk.max_concurrent

    def open(self) -> None:
        self.opened, self.held = self.opened + 1, self.held + 1

    def close(self, pnl: float) -> None:
        self.lost, self.held = self.lost + pnl, max(0, self.held - 1)


@dataclass
class Position:
    side: int
    entry: float
    stop: float
    target: float
    qty: int
    time: object
    atr: float
    bars: int = field(default=0)

    def touched(self, high: float, low: float) -> tuple[float, str] | None:
        """The stop before the target."""
        if (low <= self.stop) if self.side > 0 else (high >= self.stop):
            return self.stop, "stop"
        if (high >= self.target) if self.side > 0 else (low <= self.target):
            return self.target, "target"
        return None

    def trail(self, close: float, atr: float, r: Risk) -> None:
        level = close - self.side * r.trail_atr_mult * atr
        self.stop = max(self.stop, level) if self.side > 0 else min(self.stop, level)


def enter(price: float, atr: float, side: int, time, r: Risk, slip: float) -> Position | None:
    """A position at a price with slippage; None if it can't hold a share."""
    fill = price * (1 + side * slip)
    away = r.atr_stop_mult * atr
    qty = int(r.capital * r.risk_per_trade_pct / 100 // away) if away > 0 else 0
    if not qty:
        return None
    return Position(side, fill, fill - side * away, fill + side * max(fill * r.target_pct / 100, away * r.min_rr), qty, time, atr)


def leave(symbol: str, p: Position, price: float, time, reason: str, c: Costs) -> tuple[dict, float]:
    fill = price * (1 - p.side * c.slippage_pct)
    cost = trip_charges(p.entry, fill, p.qty, p.side, c)
    net = (fill - p.entry) * p.qty * p.side - cost
    row = {"symbol": symbol, "side": "LONG" if p.side > 0 else "SHORT", "qty": p.qty, "entry_time": p.time, "entry_price": round(p.entry, 4), "exit_time": time, "exit_price": round(fill, 4), "charges": round(cost, 2), "pnl": round(net, 2), "reason": reason}
    return row, net


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in TRADES.split(", ")])


def replay_bars(bars: pd.DataFrame, risk: Risk, costs: Costs, trailing: bool = True, square_off: bool = False) -> pd.DataFrame:
    """One symbol's trades: a signal fills at the next bar's open; of a bar's exits the stop comes first, then the target, the end of
    the day (if ``square_off``) and the end of the data. After an exit a new position may open at the same bar's open."""
    bars = bars.sort_values("ts", ignore_index=True)
    n, out, account, held = len(bars), [], Account(risk), None
    if n < 3:
        return _frame(out)
    day = bars["ts"].dt.normalize().to_numpy()
    rows = list(bars[["ts", "open", "high", "low", "close", "atr", "entered", "direction"]].itertuples(index=False))
    for i, b in enumerate(rows):
        if i and day[i] != day[i - 1]:
            account.new_day()
        last = i == n - 1
        ends = last or day[i] != day[i + 1]
        if held:
            done = held.touched(b.high, b.low)
            done = done or ((b.close, "square_off") if square_off and ends else (b.close, "end_of_data") if last else None)
            if done:
                row, net = leave(bars["symbol"].iloc[0], held, done[0], b.ts, done[1], costs)
                out.append(row)
                account.close(net)
                held = None
            elif trailing:
                held.trail(b.close, b.atr, risk)
        if held is None and 0 < i < n - 1 and not (square_off and ends):
            before = rows[i - 1]
            if before.entered and before.direction and before.atr > 0 and account.may_open():
                held = enter(b.open, before.atr, int(before.direction), b.ts, risk, costs.slippage_pct)
                if held:
                    account.open()
    return _frame(out)




def replay(frame: DataFrame, risk: Risk = Risk(), costs: Costs = Costs(), trailing: bool = True, square_off: bool = False) -> DataFrame:
    """Trades of every symbol on its own: one group a symbol. ``frame`` has bars, atr, entered and direction. Daily bars are not
    squared off at the end of the day, or nothing could ever open."""
    rows = frame.select("symbol", "ts", "open", "high", "low", "close", "atr", "entered", "direction")
    return rows.groupBy("symbol").applyInPandas(lambda bars: replay_bars(bars, risk, costs, trailing, square_off), TRADES)


def session_bars(bars: pd.DataFrame, risk: Risk, costs: Costs, max_hold: int) -> pd.DataFrame:
    """A paper session: one account, symbols one after the other, stops trailed by the range at entry, forced exit after
    ``max_hold`` bars and on a symbol's last bar, on which nothing opens."""
    account, out, today = Account(risk), [], None
    for symbol, own in bars.sort_values(["symbol", "ts"]).groupby("symbol", sort=True):
        held, rows = None, list(own.itertuples(index=False))
        for i, b in enumerate(rows):
            if b.ts.normalize() != today:
                today = b.ts.normalize()
                account.new_day()
            last = i == len(rows) - 1
            if held:
                held.bars += 1
                done = held.touched(b.high, b.low) or ((b.close, "square_off") if last else (b.close, "max_hold") if held.bars >= max_hold else None)
                if done:
                    row, net = leave(symbol, held, done[0], b.ts, done[1], costs)
                    out.append(row)
                    account.close(net)
                    held = None
                else:
                    held.trail(b.close, held.atr, risk)
            before = rows[i - 1] if i and not last else None
            if held is None and before and before.entered and before.direction and before.atr > 0 and account.may_open():
                held = enter(b.open, before.atr, int(before.direction), b.ts, risk, costs.slippage_pct)
                if held:
                    account.open()
    return _frame(out)


def sessions(rows: DataFrame) -> DataFrame:
    """(_account, symbol, _session). Symbols are taken in order, and guards start anew on every change of date, so a symbol depends on
    the one before it only if it starts on the date on which that one ends; such symbols share a session."""
    day = F.to_date("ts")
    dates = rows.groupBy("_account", "symbol").agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    order = Window.partitionBy("_account").orderBy("symbol")
    anew = F.when(F.col("_first") == F.lag("_last").over(order), 0).otherwise(1)
    return dates.withColumn("_anew", anew).select("_account", "symbol", F.sum("_anew").over(order).alias("_session"))


def paper_session(frame: DataFrame, risk: Risk = Risk(), costs: Costs = Costs(), max_hold: int = 20, account: str | None = None) -> DataFrame:
    """Trades of paper accounts. ``account`` names the column that tells accounts apart (all rows are one account without it). The
    symbols of an account share its guards within a date, so only those that meet on a date are one group; see ``sessions``."""
    rows = frame.select("symbol", "ts", "open", "high", "low", "close", "atr", "entered", "direction", (F.col(account) if account else F.lit(0)).alias("_account"))
    own = sessions(rows).withColumnsRenamed({"_account": "_account_2", "symbol": "symbol_2"})
    met = rows.join(own, F.col("_account").eqNullSafe(F.col("_account_2")) & (F.col("symbol") == F.col("symbol_2"))).drop("_account_2", "symbol_2")
    return met.groupBy("_account", "_session").applyInPandas(lambda bars: session_bars(bars.drop(columns=["_account", "_session"]), risk, costs, max_hold), TRADES)


def walk_forward_folds(bars: DataFrame, splits: int = 4, min_train: int = 50, min_test: int = 20) -> DataFrame:
    """Adds fold (1 …) and part (train, test): anchored folds, in which a test slice follows all the bars before it."""
    every = Window.partitionBy("symbol")
    numbered = bars.withColumns({"_i": F.row_number().over(every.orderBy("ts")) - 1, "_n": F.count("*").over(every)})
    numbered = numbered.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(splits))))
    edge = lambda k: F.bround(F.col("_n") * k / (splits + 1)).cast("int")
    start, end = edge(F.col("fold")), edge(F.col("fold") + 1)
    kept = numbered.where((start >= min_train) & (end - start >= min_test) & (F.col("_i") < end))
    return kept.withColumn("part", F.when(F.col("_i") < start, "train").otherwise("test")).drop("_i", "_n")


def walk_forward(bars: DataFrame, signal, risk: Risk = Risk(), costs: Costs = Costs()) -> DataFrame:
    """Trades on the test slices, on which indicators start afresh. ``signal`` turns bars (by fold as symbol) into a frame for ``replay``."""
    tests = walk_forward_folds(bars).where("part = 'test'").withColumn("symbol", F.concat_ws("#", "symbol", "fold")).drop("fold", "part")
    return replay(signal(tests), risk, costs).withColumn("fold", F.substring_index("symbol", "#", -1).cast("int")).withColumn("symbol", F.substring_index("symbol", "#", 1))
