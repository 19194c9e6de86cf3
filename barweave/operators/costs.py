"""Charges, sizes, stops and targets as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F


class _Known:
    @classmethod
    def from_config(cls, config: dict | None):
        """Unknown keys are left out."""
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (config or {}).items() if k in names})


@dataclass(frozen=True)
class Costs(_Known):
    """Charges of one order or of its value, and slippage a side."""

    brokerage_per_order: float = 20.0
    brokerage_pct: float = 0.0003
    stt_sell_pct: float = 0.00025
    exchange_txn_pct: float = 0.0000297
    gst_pct: float = 0.18
    sebi_per_crore: float = 10.0
    stamp_buy_pct: float = 0.00003
    slippage_pct: float = 0.0005


@dataclass(frozen=True)
class Risk(_Known):
    """Capital, shares of it in per cent, and multiples of the range."""

    capital: float = 100_000.0
    risk_per_trade_pct: float = 0.5
    target_pct: float = 1.5
    atr_stop_mult: float = 1.5
    min_rr: float = 1.5
    trail_atr_mult: float = 2.0
    daily_loss_halt_pct: float = 1.0
    max_concurrent: int = 3
    max_trades_per_day: int = 10


def charges(entry: Column, exit_: Column, qty: Column, side: Column, c: Costs = Costs()) -> Column:
    """All charges of a round trip."""
    first, last = entry * qty, exit_ * qty
    buy, sell = F.when(side > 0, first).otherwise(last), F.when(side > 0, last).otherwise(first)
    fee = lambda v: F.least(F.lit(c.brokerage_per_order), v * c.brokerage_pct)
    taxed = fee(buy) + fee(sell) + (buy + sell) * (c.exchange_txn_pct + c.sebi_per_crore / 1e7)
    return taxed * (1 + c.gst_pct) + sell * c.stt_sell_pct + buy * c.stamp_buy_pct


def round_trip_pct(c: Costs = Costs()) -> float:
    """The share of a round trip's value that it costs, without fixed fees."""
    return (2 * c.brokerage_pct + 2 * c.exchange_txn_pct) * (1 + c.gst_pct) + c.stt_sell_pct + c.stamp_buy_pct + 2 * c.slippage_pct


def position_size(entry: Column, stop: Column, r: Risk = Risk()) -> Column:
    away = F.abs(entry - stop)
    return F.when(away > 0, F.floor(F.lit(r.capital * r.risk_per_trade_pct / 100) / away)).otherwise(0).cast("int")


def stop_and_target(entry: Column, atr: Column, side: Column, r: Risk = Risk()) -> tuple[Column, Column]:
    away = atr * r.atr_stop_mult
    return entry - side * away, entry + side * F.greatest(entry * r.target_pct / 100, away * r.min_rr)


def order_params(symbol: Column, side: Column, qty: Column) -> Column:
    """What a live order would say; nothing here places one."""
    return F.struct(symbol.alias("tradingsymbol"), F.when(side > 0, "BUY").otherwise("SELL").alias("transaction_type"), qty.alias("quantity"), F.lit("MIS").alias("product"), F.lit("MARKET").alias("order_type"))
