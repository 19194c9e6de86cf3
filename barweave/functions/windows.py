"""Rolling windows over a symbol's bars; a frame of n rows is null until it holds n values."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

_keys = ["symbol"]


@contextmanager
def keyed(*keys: str):
    """While it is open, windows are built over these keys instead of the symbol; see ``blocks``."""
    before, _keys[:] = list(_keys), keys
    try:
        yield
    finally:
        _keys[:] = before


def by_symbol():
    return Window.partitionBy(*_keys).orderBy("ts")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


class Shared:
    """Rolling columns that several expressions use. While it is open, rolling functions give the name of a column instead of a new
    window; ``on`` adds these columns to the bars, each of them computed once."""

    open: "Shared | None" = None

    def __init__(self):
        self.columns: dict[tuple, tuple[str, Column]] = {}
        self.quantiles: dict[tuple, str] = {}

    def __enter__(self) -> "Shared":
        Shared.open = self
        return self

    def __exit__(self, *_) -> None:
        Shared.open = None

    def name(self, key: tuple, make) -> Column:
        if key not in self.columns:
            self.columns[key] = (f"_w{len(self.columns)}", make())
        return F.col(self.columns[key][0])

    def quantile(self, x: str, n: int, q: float) -> Column:
        return F.col(self.quantiles.setdefault((x, n, q), f"_q{len(self.quantiles)}"))

    def on(self, bars):
        if self.quantiles:
            from barweave.functions import blocks  # it builds on this module

            bars = blocks.rolling_quantiles(bars, [(*key, name) for key, name in self.quantiles.items()])
        return bars.select("*", *(c.alias(n) for n, c in self.columns.values())) if self.columns else bars


def _shared(key: tuple, make) -> Column:
    return Shared.open.name(key, make) if Shared.open else make()


def _guarded(agg, x, n: int, prior: bool = False) -> Column:
    frame = lambda: by_symbol().rowsBetween(-n, -1) if prior else by_symbol().rowsBetween(-(n - 1), 0)
    full = _shared(("count", str(x), n, prior), lambda: F.count(col(x)).over(frame())) == n
    return F.when(full, _shared((agg.__name__, str(x), n, prior), lambda: agg(col(x)).over(frame())))


def sma(x, n: int) -> Column:
    return _guarded(F.avg, x, n)


def rolling_sum(x, n: int) -> Column:
    return _guarded(F.sum, x, n)


def rolling_std(x, n: int) -> Column:
    """Of the population."""
    return _guarded(F.stddev_pop, x, n)


def highest(x, n: int, prior: bool = False) -> Column:
    return _guarded(F.max, x, n, prior)


def lowest(x, n: int, prior: bool = False) -> Column:
    return _guarded(F.min, x, n, prior)


def quantile(x: str, n: int, q: float) -> Column:
    """A column that ``Shared.on`` adds: the quantile of the last n bars, exact, interpolated between neighbours."""
    if Shared.open is None:
        raise ValueError("quantiles are columns of blocks.rolling_quantiles or of an open Shared")
    return Shared.open.quantile(x, n, q)


def lag(x, n: int = 1) -> Column:
    return _shared(("lag", str(x), n), lambda: F.lag(col(x), n).over(by_symbol()))


def lead(x, n: int = 1) -> Column:
    return F.lead(col(x), n).over(by_symbol())


def change(n: int = 1, x="close") -> Column:
    """The relative change over n bars."""
    return col(x) / lag(x, n) - 1


def forward_return(h: int) -> Column:
    return lead("close", h) / F.col("close") - 1


def bollinger(n: int = 20, k: float = 2.0) -> tuple[Column, Column]:
    """The lower and the upper band."""
    mid, sd = sma("close", n), rolling_std("close", n)
    return mid - k * sd, mid + k * sd


def true_range() -> Column:
    before = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def session_vwap() -> Column:
    """Volume-weighted average price since the start of the day; null while no volume has come."""
    day = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return F.sum(typical * F.col("volume")).over(day) / F.nullif(F.sum("volume").over(day), F.lit(0.0))


def opening_range(k: int) -> tuple[Column, Column, Column]:
    """High and low of the day's first k bars, and the bar's number in its day; null on days without more bars."""
    day = Window.partitionBy("symbol", F.to_date("ts"))
    number = F.row_number().over(day.orderBy("ts"))
    ranked = F.when(F.count("*").over(day) > k, F.lit(1))
    first = F.slice(F.collect_list(F.struct("ts", "high", "low")).over(day.orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 1, k)
    return ranked * F.array_max(F.transform(first, lambda s: s["high"])), ranked * F.array_min(F.transform(first, lambda s: s["low"])), number
