"""Sketches that are kept: one small table by day, merged for any span of days without going back to the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the buckets of a distinct-count sketch; 4 KB a sketch at most.
LG_BUCKETS = 12
#: Relative standard error of its estimates (of a single sketch and of a merged one).
STANDARD_ERROR = 0.8 / (1 << LG_BUCKETS) ** 0.5


def daily_sketches(df: DataFrame, at: str, by: list[str], values: dict[str, Column]) -> DataFrame:
    """``(day, by..., n, <name>...)``: the rows of each day, and a sketch of the different values of each named expression.

    Sketches are merged in each task before they are shuffled. Nulls are no values; rows without a time are left out.
    """
    sketches = [F.hll_sketch_agg(v.cast("string"), LG_BUCKETS).alias(name) for name, v in values.items()]
    return df.where(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day"), *by).agg(F.count("*").alias("n"), *sketches)


def added(kept: DataFrame, fresh: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Two tables of daily sketches as one: days that both have are merged, so late rows are added by sketching them alone."""
    return _merged(kept.unionByName(fresh), ["day", *by], names)


def over_spans(kept: DataFrame, spans: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """``(span columns, by..., n, <name>...)`` for ``spans`` with ``first_day`` and ``last_day``: estimates from the sketches of their days.

    A span becomes its days, so the join is one by equality; the rows are days, not what was sketched.
    """
    days = spans.withColumn("day", F.explode(F.sequence("first_day", "last_day")))
    merged = _merged(days.join(kept, "day"), [*spans.columns, *by], names)
    return merged.withColumns({name: F.hll_sketch_estimate(name) for name in names})


def _merged(sketches: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.hll_union_agg(name).alias(name) for name in names])
