"""Joins beyond plain equality."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, NumericType, StructField, StructType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

from tessera.operators.ordered import KEY_ROWS, PART, edges, largest_key, ordered_parts, same
from tessera.session import Scratch


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], key_rows: int = KEY_ROWS) -> DataFrame:
    """Each left row with ``values`` of the last right row of the same ``by`` at or before its time; null if none.

    Both sides are put in one time-ordered stream per key and the last seen right row is carried
    forward, so each side is shuffled once and no pairs are made. Right rows at equal times: the one
    with the largest values. ``by`` columns have the same names on both sides; null keys equal each other.

    If some key has more than ``key_rows`` rows, both sides are dealt to parts in the order of key and time instead: rows are carried
    forward within a part, and into each part goes the last right row before it, if that has the key of the part's first rows.
    """
    rows = left.select(*by, F.lit(1).alias("_side"), F.col(left_time).alias("_at"), F.struct(*left.columns).alias("_left"))
    seen = right.select(*by, F.lit(0).alias("_side"), F.col(right_time).alias("_at"), F.struct(*values).alias("_right"))
    both = rows.unionByName(seen, allowMissingColumns=True)
    order = [F.col("_at"), F.col("_side"), F.col("_right").asc_nulls_first()]
    out = ["_left.*", *[F.col(f"_last.{v}").alias(v) for v in values]]
    before = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_right", ignorenulls=True)
    if largest_key(both, by) <= key_rows:
        return both.withColumn("_last", last.over(before(*by))).where("_side = 1").select(*out)

    parts = ordered_parts(both, [*map(F.col, by), *order], "asof")
    key, carried, rows_in = F.struct(*by), None, []
    for e in edges(parts, F.max(F.when(F.col("_side") == 0, F.struct(key.alias("_key"), "_at", "_right"))).alias("_tail")):
        if carried:
            rows_in.append((e[PART], carried["_key"], carried["_right"]))
        carried = e["_tail"] or carried
    kinds = {f.name: f for f in both.schema.fields}
    schema = StructType([parts.schema[PART], StructField("_key", StructType([kinds[b] for b in by])), StructField("_into", kinds["_right"].dataType)])
    into = F.broadcast(both.sparkSession.createDataFrame(rows_in, schema))  # a row a part
    held = parts.withColumn("_last", last.over(before(PART, *by))).where("_side = 1").join(into, PART, "left")
    fits = F.lit(True)
    for b in by:
        fits &= F.col(b).eqNullSafe(F.col(f"_key.{b}"))
    return held.withColumn("_last", F.coalesce("_last", F.when(fits, F.col("_into")))).select(*out)


#: Cells are numbered within these bounds; what lies beyond is in the outermost cells.
OUTERMOST = 1 << 61


def _axis(df: DataFrame, column: str) -> Column:
    """A column as doubles that never decrease where it increases; seconds, for times."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, TimestampType):
        return F.unix_micros(c) / F.lit(1e6)
    if isinstance(kind, (TimestampNTZType, DateType)):  # by the calendar, so that no time zone plays a part
        days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")) * F.lit(86400.0)
        return days if isinstance(kind, DateType) else days + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    if not isinstance(kind, NumericType):
        raise TypeError(f"{column} is {kind.simpleString()}; numbers, dates and timestamps can be ranged over")
    return c.cast("double")


def _cell(df: DataFrame, column: str, width: float) -> Column:
    """Number of the cell of ``width`` that a value lies in; NaN counts as the largest value, as in comparisons."""
    at = _axis(df, column) / F.lit(float(width))
    edge = float(OUTERMOST)
    return F.when(F.isnan(at) | (at >= edge), F.lit(OUTERMOST - 1)).when(at <= -edge, F.lit(-OUTERMOST)).otherwise(F.floor(at)).cast("long")


def dyadic_cover(first: str, end: str) -> Column:
    """The fewest aligned blocks that make up the cells ``first .. end - 1``, as ``(level, block)``: two a level at most.

    At level ``i`` blocks hold ``2 ** i`` cells. What is left there of the run begins at ``ceil(first / 2 ** i)`` and ends at ``floor(end / 2 ** i)``;
    an odd beginning and an odd end have no room in a block of the next level and are taken here.
    """
    lo, hi = f"-shiftright(-{first}, i)", f"shiftright({end}, i)"
    odd = lambda side, block: f"transform(sequence(0, 62), i -> if({lo} < {hi} and ({side} & 1) = 1, struct(i as level, {block} as block), null))"
    left, right = odd(lo, lo), odd(hi, f"{hi} - 1")
    return F.expr(f"filter(concat({left}, {right}), b -> b is not null)")


#: Candidate pairs that a task of an interval join looks at, about.
TASK_PAIRS = 4_000_000
#: Blocks that are dealt to several tasks, and tasks of an interval join, at most; beyond, a task has more pairs.
MOST_DEALT = 10_000


def interval_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, width: float, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Pairs with ``start <= point < end``, for intervals of any length, by an equality join.

    The axis (numbers, dates or timestamps; seconds, for times) is cut into cells of ``width``. An interval is taken apart into aligned blocks
    of 1, 2, 4, ... cells, at most two of each size, and a point has one block of each size that some interval uses: so an interval
    over ``n`` cells makes ``2 log n`` rows, a point no more than there are sizes, and each pair meets once. ``width`` should be near the
    shortest common length: it decides only how many candidates are looked at in vain.

    Candidates are counted before. If there are more than ``task_pairs``, there are as many more tasks, and a block with more deals its longer side
    to several of them, each with all of its shorter side. The counts stand for rows, so small tables with very many pairs are spread too.
    """
    names = lambda df: [F.col(c) for c in df.columns]
    reach = intervals.where(F.col(start) < F.col(end)).select(*names(intervals), _cell(intervals, start, width).alias("_lo"), (_cell(intervals, end, width) + 1).alias("_hi"))
    blocks = reach.select(*names(intervals), F.inline(dyadic_cover("_lo", "_hi")).alias("_level", "_block"))
    levels = [r[0] for r in blocks.select("_level").distinct().collect()]  # 63 at most
    if not levels:
        levels = [0]
    own = points.where(F.col(point).isNotNull()).select(*names(points), _cell(points, point, width).alias("_cell"), F.explode(F.array(*[F.lit(i) for i in sorted(levels)])).alias("_level"))
    own = own.withColumn("_block", F.expr("shiftright(_cell, _level)")).drop("_cell")
    keys, fits = ["_level", "_block"], (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    counted = own.groupBy(*keys).agg(F.count("*").alias("_n")).join(blocks.groupBy(*keys).agg(F.count("*").alias("_m")), keys)
    met = Scratch(points.sparkSession, "interval-blocks").table(counted.withColumn("_pairs", F.col("_n").cast("double") * F.col("_m")))
    total = met.agg(F.sum("_pairs")).first()[0] or 0
    if total <= task_pairs:
        return own.join(blocks, keys).where(fits).drop(*keys)

    most = max(task_pairs, total / MOST_DEALT)
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / most))
    deals = F.least(F.ceil(F.col("_pairs") / most), F.greatest("_n", "_m")).cast("int")
    hot = F.broadcast(met.where(F.col("_pairs") > most).select(*keys, deals.alias("_deals"), (F.col("_n") >= F.col("_m")).alias("_points_dealt")))  # MOST_DEALT rows at most

    def dealt(rows: DataFrame, long_side: Column) -> DataFrame:
        one = F.array(F.pmod(F.monotonically_increasing_id(), F.col("_deals")).cast("int"))
        to = F.when(F.col("_deals").isNull(), F.array(F.lit(0))).when(long_side, one).otherwise(F.sequence(F.lit(0), F.col("_deals") - 1))
        return rows.join(hot, keys, "left").withColumn("_deal", F.explode(to)).drop("_deals", "_points_dealt").repartition(tasks, *keys, "_deal")

    ours, theirs = dealt(own, F.col("_points_dealt")), dealt(blocks, ~F.col("_points_dealt"))
    # A merge join of both sides' parts: one that sends a side to all tasks would leave the pairs to the few tasks that read the other.
    return ours.join(theirs.hint("merge"), [*keys, "_deal"]).where(fits).drop(*keys, "_deal")


def not_in(left: DataFrame, column: str, right: DataFrame, right_column: str) -> DataFrame:
    """SQL's ``NOT IN`` with its null rules: nothing passes if the right side holds a null, and null passes only an empty one."""
    other = right.select(F.col(right_column).alias("_value"))
    state = other.agg(F.count("*").alias("_n"), F.count_if(F.col("_value").isNull()).alias("_nulls"))
    kept = left.join(other, left[column] == F.col("_value"), "left_anti").crossJoin(F.broadcast(state))  # one row
    return kept.where((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(column).isNotNull())).select(*left.columns)


def salted_join(facts: DataFrame, keys: DataFrame, on: str, salts: int = 16) -> DataFrame:
    """An inner equality join whose hot keys are dealt to ``salts`` tasks; ``keys`` is multiplied by as many."""
    dealt = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int"))
    copied = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, [on, "_salt"]).drop("_salt")


#: For each comparison ``left op right``: the end of a sorted right side that passes, and on which side of equal values it begins.
_PASSES = {"<": ("above", "right"), "<=": ("above", "left"), ">": ("below", "left"), ">=": ("below", "right")}


#: Pairs that a task of an inequality join holds before it hands them on, about.
HELD_PAIRS = 1 << 16


def inequality_pairs(left_x: np.ndarray, left_y: np.ndarray, right_x: np.ndarray, right_y: np.ndarray, x_op: str, y_op: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs with ``left_x x_op right_x`` and ``left_y y_op right_y``."""
    found = [*pairs_in_steps(left_x, left_y, right_x, right_y, x_op, y_op), (np.zeros(0, np.int64),) * 2]
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def pairs_in_steps(left_x: np.ndarray, left_y: np.ndarray, right_x: np.ndarray, right_y: np.ndarray, x_op: str, y_op: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same, ``HELD_PAIRS`` and the pairs of one left row at most at once.

    The right side is sorted by x, and a permutation tells where the rows of its y order stand there. Left rows come in the y order in which
    more and more right rows pass the second comparison; each of these sets its bit, and a left row reads the bits of those that pass the first.
    """
    by_x, by_y = np.argsort(right_x, kind="stable"), np.argsort(right_y, kind="stable")
    place = np.empty(len(by_x), np.int64)
    place[by_x] = np.arange(len(by_x))
    (x_end, x_side), (y_end, y_side) = _PASSES[x_op], _PASSES[y_op]
    at_x, at_y = np.searchsorted(right_x[by_x], left_x, x_side), np.searchsorted(right_y[by_y], left_y, y_side)
    lo, hi = (at_x, np.full(len(at_x), len(by_x))) if x_end == "above" else (np.zeros(len(at_x), np.int64), at_x)
    entering = place[by_y[::-1] if y_end == "above" else by_y]
    passing = len(by_y) - at_y if y_end == "above" else at_y
    bits, entered, out_left, out_right, held = np.zeros(len(by_x), bool), 0, [], [], 0
    for row in np.argsort(passing, kind="stable"):
        if passing[row] > entered:
            bits[entering[entered : passing[row]]] = True
            entered = passing[row]
        found = np.flatnonzero(bits[lo[row] : hi[row]]) + lo[row]
        if len(found):
            out_left.append(np.full(len(found), row))
            out_right.append(by_x[found])
            held += len(found)
        if held >= HELD_PAIRS:
            yield np.concatenate(out_left), np.concatenate(out_right)
            out_left, out_right, held = [], [], 0
    if held:
        yield np.concatenate(out_left), np.concatenate(out_right)


def _comparable(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers as they are, dates and times as whole numbers."""
    column = column.combine_chunks()
    if pa.types.is_temporal(column.type):
        column = column.cast(pa.int32()) if pa.types.is_date32(column.type) else column
        column = column.cast(pa.int64())
    return column.to_numpy(zero_copy_only=False)


def nullable(df: DataFrame) -> list[StructField]:
    return [StructField(f.name, f.dataType) for f in df.schema.fields]


def inequality_join(left: DataFrame, right: DataFrame, x: tuple[str, str, str], y: tuple[str, str, str], rows_per_part: int = 4096) -> DataFrame:
    """Pairs that pass two comparisons ``(left column, op, right column)``, op one of ``< <= > >=``, without an equality and without a nested loop.

    Both sides are dealt to parts of about ``rows_per_part`` rows in the order of ``x``. Only parts whose ranges of both columns allow a pair meet, and there
    pairs are found by a sorted permutation and a bit array (:func:`inequality_pairs`). Columns are whole or floating numbers, dates or
    timestamps, of one type a comparison; nulls pass none, NaN is the largest value. The sides must not share a column's name. A meeting of two
    parts holds their rows and hands its pairs on ``HELD_PAIRS`` at a time, however many it makes.
    """
    if shared := set(left.columns) & set(right.columns):
        raise ValueError(f"both sides have {sorted(shared)}")
    for a, op, b in (x, y):
        if op not in _PASSES or left.schema[a].dataType != right.schema[b].dataType or isinstance(left.schema[a].dataType, DecimalType):
            raise TypeError(f"{a} {op} {b} compares {left.schema[a].dataType.simpleString()} with {right.schema[b].dataType.simpleString()}")

    def dealt(df: DataFrame, a: str, b: str, label: str) -> tuple[DataFrame, list]:
        there = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        parts = ordered_parts(there, [F.col(a), F.col(b)], label, max(1, -(-there.count() // rows_per_part)))
        ends = [f(_axis(df, c)).alias(name) for c, names in ((a, "ab"), (b, "cd")) for f, name in zip((F.min, F.max), names)]
        return parts, edges(parts, *ends)

    (held, mine), (other, theirs) = dealt(left, x[0], y[0], "inequality-left"), dealt(right, x[2], y[2], "inequality-right")
    least_x, most_x, least_y, most_y = (np.array([r[k] for r in theirs], np.float64) for k in "abcd")
    # Doubles round, so ranges that just touch meet, whatever the comparison; NaN touches all.
    touches = lambda op, lo, hi, least, most: ~(lo > most) if op[0] == "<" else ~(hi < least)
    meetings = []
    for r in mine:
        both = touches(x[1], r["a"], r["b"], least_x, most_x) & touches(y[1], r["c"], r["d"], least_y, most_y)
        meetings += [(r[PART], theirs[j][PART]) for j in np.flatnonzero(both)]
    met = lambda: left.sparkSession.createDataFrame(meetings, "_mine int, _theirs int")
    mine_rows = held.withColumnRenamed(PART, "_mine").join(met(), "_mine").select(*left.columns, "_mine", "_theirs")
    their_rows = other.withColumnRenamed(PART, "_theirs").join(met(), "_theirs").select(*right.columns, "_mine", "_theirs")
    mine_names, their_names = left.columns, right.columns

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        one, two = rows.filter(rows["_left"]).select(mine_names).combine_chunks(), rows.filter(pc.invert(rows["_left"])).select(their_names).combine_chunks()
        columns = [_comparable(t[c]) for t, c in ((one, x[0]), (one, y[0]), (two, x[2]), (two, y[2]))]
        for i, j in pairs_in_steps(*columns, x[1], y[1]):
            found = pa.table([*one.take(pa.array(i)).columns, *two.take(pa.array(j)).columns], names=[*mine_names, *their_names])
            yield from found.combine_chunks().to_batches()

    # Both sides in one table, told apart by a flag: groups of one table can be handed on in steps, those of two can't.
    both = mine_rows.withColumn("_left", F.lit(True)).unionByName(their_rows.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    return both.groupBy("_mine", "_theirs").applyInArrow(pairs, StructType([*nullable(left), *nullable(right)]))
