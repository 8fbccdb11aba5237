"""Operators that Spark has no single call for, as compositions of DataFrame operations."""
from tessera.operators.graphs import reach
from tessera.operators.joins import asof_join, inequality_join, interval_join, not_in, salted_join
from tessera.operators.quantiles import exact_quantiles
from tessera.operators.ranges import interval_totals
from tessera.operators.sketches import added, daily_sketches, over_spans
from tessera.operators.windows import sessions, top_k_per_group, whole_ranks

__all__ = [
    "added", "asof_join", "daily_sketches", "exact_quantiles", "inequality_join", "interval_join", "interval_totals", "not_in", "over_spans", "reach", "salted_join",
    "sessions", "top_k_per_group", "whole_ranks",
]
