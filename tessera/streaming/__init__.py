"""Structured Streaming forms of the event queries."""
from tessera.streaming.events import (
    abandoned, deal_in_time, distinct_events, event_stream, follow_ups, lateness_seconds, run_available, run_deliveries, run_in_batches, session_counts, tumbling_counts,
)

__all__ = [
    "abandoned", "deal_in_time", "distinct_events", "event_stream", "follow_ups", "lateness_seconds", "run_available", "run_deliveries", "run_in_batches", "session_counts",
    "tumbling_counts",
]
