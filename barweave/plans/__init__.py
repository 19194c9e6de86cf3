"""Named queries and their SQL."""

from barweave.plans import evaluate_q, extra_q, indicators_q, live_q, misc_q, more_q, store_q, strategy_q
from barweave.plans.catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "evaluate_q", "extra_q", "indicators_q", "live_q", "misc_q", "more_q", "store_q", "strategy_q"]
