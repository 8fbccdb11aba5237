"""What intervals hold, without pairs of points and intervals."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.ordered import PART, SALT, edges, ordered_parts
from tessera.session import Scratch

#: Points and interval ends that one task holds, about.
PART_ROWS = 200_000
NONE = np.iinfo(np.int64).min


def largest_tables(values: np.ndarray) -> list[np.ndarray]:
    """At ``[k][i]`` the largest of the ``2 ** k`` values from ``i`` on."""
    tables = [values]
    while 2 << len(tables) - 1 <= len(values):
        half = 1 << len(tables) - 1
        tables.append(np.maximum(tables[-1][:-half], tables[-1][half:]))
    return tables


def largest_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The largest of ``values[lo:hi]`` for each pair of places, ``NONE`` where that is empty."""
    tables, out = largest_tables(values), np.full(len(lo), NONE)
    level = np.frexp(np.maximum(hi - lo, 1))[1] - 1  # of the largest power of two in it
    for k, table in enumerate(tables):
        at = np.flatnonzero((level == k) & (hi > lo))
        out[at] = np.maximum(table[lo[at]], table[hi[at] - (1 << k)])
    return out


def interval_totals(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, value: str, count: str, largest: str, part_rows: int = PART_ROWS) -> DataFrame:
    """``intervals`` that hold a point (``start <= point < end``), each with the ``count`` of its points and the ``largest`` whole-number ``value`` of these.

    Points and both ends of all intervals are dealt to parts in order. An interval is the rest of the part in which it starts, the beginning of the part
    in which it ends, and whole parts between: each is known within its part, whole parts by tables over a row a part. So work grows with rows, not with pairs.
    Nulls are in no interval; null values count but are never the largest (nor is the smallest long). Equal intervals each have their row.
    """
    spark = points.sparkSession
    held = Scratch(spark, "interval-totals").table(intervals.where(F.col(start) < F.col(end)).withColumn("_id", F.monotonically_increasing_id()))
    # Ends stand before points at the same place: a start takes these in, an end leaves them out.
    rows = points.where(F.col(point).isNotNull()).select(F.col(point).alias("_at"), F.lit(2).alias("_kind"), F.lit(-1).cast("long").alias("_id"), F.col(value).cast("long").alias("_value"))
    for kind, c in enumerate((start, end)):
        rows = rows.unionAll(held.select(F.col(c).alias("_at"), F.lit(kind).alias("_kind"), "_id", F.lit(None).cast("long").alias("_value")))
    order = [F.col("_at"), (F.col("_kind") == 2)]
    n_parts = max(1, math.ceil((points.count() + 2 * held.count()) / part_rows))
    parts = ordered_parts(rows, order, "interval-ends", n_parts)
    about = {e[PART]: e for e in edges(parts, F.count_if(F.col("_kind") == 2).alias("n"), F.max("_value").alias("largest"))}

    def totals(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("_row")
        kind, ids = t["_kind"].to_numpy(), t["_id"].to_numpy()
        is_point = kind == 2
        before = np.cumsum(is_point)  # points up to here; an end is none itself
        values = t["_value"].fill_null(int(NONE)).to_numpy()[is_point]
        ends = [np.flatnonzero(kind == k) for k in (0, 1)]
        ends = [e[np.argsort(ids[e])] for e in ends]
        _, first, second = np.intersect1d(*[ids[e] for e in ends], assume_unique=True, return_indices=True)
        only = [np.delete(e, x) for e, x in zip(ends, (first, second))]
        # Both ends here, the start alone, the end alone.
        lo = np.concatenate([before[ends[0][first]], before[only[0]], np.zeros(len(only[1]), np.int64)])
        hi = np.concatenate([before[ends[1][second]], np.full(len(only[0]), len(values)), before[only[1]]])
        none = lambda n: np.full(n, -1)
        here = lambda n: np.full(n, key[0].as_py())
        sizes = len(first), len(only[0]), len(only[1])
        most = largest_between(values, lo, hi)
        columns = [np.concatenate([ids[ends[0][first]], ids[only[0]], ids[only[1]]]), hi - lo, most]
        columns += [np.concatenate([none(sizes[0]), here(sizes[1]), none(sizes[2])]), np.concatenate([none(sizes[0]), none(sizes[1]), here(sizes[2])])]
        return pa.table([pa.array(c, pa.int64(), mask=c == NONE) for c in columns], names=["_id", "_n", "_largest", "_from", "_to"])

    numbered = parts.withColumn("_row", F.row_number().over(Window.partitionBy(PART).orderBy(*order, SALT))).select(PART, "_row", "_kind", "_id", "_value")
    pieces = numbered.groupBy(PART).applyInArrow(totals, "_id long, _n long, _largest long, _from long, _to long")
    known = pieces.groupBy("_id").agg(F.sum("_n").alias("_n"), F.max("_largest").alias("_largest"), (F.max("_from") + 1).alias("_from"), F.max("_to").alias("_to"))

    # Whole parts from ``_from`` up to ``_to``: a difference of sums, and two tables' entries that overlap.
    size = max(about, default=0) + 2
    counts = np.array([about[i]["n"] if i in about else 0 for i in range(size)], np.int64)
    best = np.array([about[i]["largest"] if i in about and about[i]["largest"] is not None else NONE for i in range(size)], np.int64)
    upto = [(i, int(x)) for i, x in enumerate(np.append(0, np.cumsum(counts)))]
    spans = [(k, i, int(x) if x != NONE else None) for k, table in enumerate(largest_tables(best)) for i, x in enumerate(table)]
    sums = lambda i: F.broadcast(spark.createDataFrame(upto, f"_at{i} long, _upto{i} long"))  # noqa: E731  # a row a part
    entries = lambda i: F.broadcast(spark.createDataFrame(spans, f"_level{i} int, _first{i} long, _most{i} long"))  # noqa: E731  # a row a part and level
    whole = F.col("_to") > F.col("_from")
    known = known.withColumn("_level", F.when(whole, F.length(F.bin(F.col("_to") - F.col("_from"))) - 1)).withColumn("_second", F.col("_to") - F.expr("shiftleft(1L, _level)"))
    known = known.join(sums(0), whole & (F.col("_from") == F.col("_at0")), "left").join(sums(1), whole & (F.col("_to") == F.col("_at1")), "left")
    known = known.join(entries(0), (F.col("_level") == F.col("_level0")) & (F.col("_from") == F.col("_first0")), "left")
    known = known.join(entries(1), (F.col("_level") == F.col("_level1")) & (F.col("_second") == F.col("_first1")), "left")
    n = F.col("_n") + F.coalesce(F.col("_upto1") - F.col("_upto0"), F.lit(0))
    found = known.select("_id", n.alias(count), F.greatest("_largest", "_most0", "_most1").alias(largest)).where(F.col(count) > 0)
    return held.join(found, "_id").drop("_id")
