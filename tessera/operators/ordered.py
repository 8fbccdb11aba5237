"""Tables dealt to tasks in order, so that work along an order needs neither one task a table nor one task a key.

A part holds a run of the order, of about equal length whatever the keys: equal rows are told apart by a number, so a hot
key is spread over as many parts as it needs. What one part must know of those before it is a row a part; these few rows
are put together on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessera.session import Scratch

PART, SALT = "_part", "_salt"
#: Rows of one key that a task may sort; keys with more are dealt to several tasks.
KEY_ROWS = 4_000_000


def ordered_parts(df: DataFrame, order: list[Column], label: str, parts: int | None = None) -> DataFrame:
    """``df`` in the shared folder with ``_part``: rows of a part stand before those of the next in ``order``.

    Parts are written before they are used, so a lost task can't deal rows anew. ``_salt`` is a different number in each row.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = df.withColumn(SALT, F.monotonically_increasing_id())
    return Scratch(df.sparkSession, label).table(numbered.repartitionByRange(n, *order, SALT).withColumn(PART, F.spark_partition_id()))


def largest_key(df: DataFrame, by: list[str]) -> int:
    """Rows of the most frequent key; counted in all tasks before the shuffle."""
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def same(a: Iterable, b: Iterable) -> bool:
    """Whether two keys are equal as Spark groups them: nulls are equal, NaNs too."""
    nan = lambda x: isinstance(x, float) and math.isnan(x)
    return all(x == y or nan(x) and nan(y) for x, y in zip(a, b, strict=True))


def edges(parts: DataFrame, *aggregates: Column) -> list[Row]:
    """A row a part, in order."""
    return sorted(parts.groupBy(PART).agg(*aggregates).collect(), key=lambda r: r[PART])
