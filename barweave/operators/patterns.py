"""Candlestick patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barweave.functions.scalars import choose, ratio
from barweave.functions.windows import lag


def _column(name: str):
    return lambda: F.col(name)


O, H, L, C = map(_column, ("open", "high", "low", "close"))



def engulfing() -> Column:
    """The body covers a body of the opposite sign before it."""
    o, c = lag("open"), lag("close")
    return choose((c < o) & (C() > O()) & (O() <= c) & (C() >= o), (c > o) & (C() < O()) & (O() >= c) & (C() <= o))


def hammer() -> Column:
    body = F.abs(C() - O())
    return choose((body > 0) & (F.least(O(), C()) - L() >= 2 * body) & (H() - F.greatest(O(), C()) <= body), F.lit(False))


def doji(share: float = 0.1) -> Column:
    """A body of at most ``share`` of the range; a bar without a range is none."""
    return F.coalesce(ratio(F.abs(C() - O()), H() - L()), F.lit(1.0)) <= share


PATTERNS = {"engulfing": engulfing, "hammer": hammer}


def detect(name: str) -> Column:
    """The stance of a named pattern; KeyError for an unknown one."""
    return PATTERNS[name]()
