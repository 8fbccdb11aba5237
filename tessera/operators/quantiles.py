"""Exact quantiles of groups of any size, by histogram refinement.

Spark's ``percentile`` and ``median`` hold all different values of a group in one task. Here each pass counts the values of the range that
holds a wanted rank in ``BINS`` bins, in all tasks and before any shuffle, and goes on with the least and the greatest value of the bin where the rank
lies. So a task holds bins, never a group. The first pass narrows a range to a power of two, each further one a thousandfold, so seven are the most that
doubles can need; once few values are left in a range they are ranked as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import Scratch

BINS = 1024
#: Values of a range that are ranked directly.
FEW = 10_000


def _bin(bins: int) -> Column:
    """Number of the bin of ``x`` between ``lo`` and ``hi``; never decreases with ``x``, and the ends lie in different bins.

    A range over many powers of two is cut at these, any other into ``bins`` equal parts: so any range is narrowed to a factor of two first.
    """
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    wide = ~(((lo > 0) & (hi / bins <= lo)) | ((hi < 0) & (lo / bins >= hi)))
    power = F.when(x == 0, 0).otherwise(F.signum(x) * (2000 + F.floor(F.log2(F.abs(x)))))
    span = hi / 2 - lo / 2  # halves, as the difference itself may overflow
    equal = F.when(x >= hi, bins - 1).when((span <= 0) | (x <= lo), 0).otherwise(F.least(F.floor((x / 2 - lo / 2) / span * bins), F.lit(bins - 1)))
    return F.when(wide, power).otherwise(equal).cast("int")


def exact_quantiles(df: DataFrame, by: list[str], column: str, quantiles: list[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """``(by..., q, value)``: the interpolated quantiles of a numeric column, as ``percentile`` and SQL's ``percentile_cont`` give them.

    Nulls don't count, a group of nulls only has null quantiles; null keys are a group; NaN is the largest value. Between an infinity and another value the lower one is taken.
    """
    if not all(0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles lie between 0 and 1")
    scratch = Scratch(df.sparkSession, "quantiles")
    keys = [f"_g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(column).cast("double").alias("x"))
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    inner = F.when(finite, F.col("x"))
    groups = rows.groupBy(*keys).agg(
        F.count("x").alias("n"), F.count(inner).alias("held"), F.count_if(F.col("x") == float("-inf")).alias("below"), F.count_if(F.col("x") == float("inf")).alias("above"),
        F.min(inner).alias("lo"), F.max(inner).alias("hi"),
    )
    at = (F.col("n") - 1) * F.col("q")
    asked = groups.select("*", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q"))
    asked = scratch.table(asked.withColumns({"first": F.floor(at), "second": F.ceil(at), "part": at - F.floor(at)}))
    one = asked.where("n > 0").select(*keys, "held", "below", "above", "lo", "hi", F.explode(F.array("first", "second")).alias("rank")).distinct()
    inside = F.col("rank") - F.col("below")
    beyond = F.when(inside < 0, float("-inf")).when(inside >= F.col("held") + F.col("above"), float("nan")).when(inside >= F.col("held"), float("inf"))
    done = [scratch.table(one.where(beyond.isNotNull()).select(*keys, "rank", beyond.alias("value")))]
    # The value of rank ``rank`` is between lo and hi, and ``before`` values of the group are smaller than lo.
    state = scratch.table(one.where(beyond.isNull()).select(*keys, "rank", "lo", "hi", F.col("below").alias("before"), F.col("held").alias("count")))
    rows = rows.where(finite)
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]

    def within(ranges: DataFrame) -> DataFrame:
        """The values of each range, a range once."""
        r = ranges.select(*keys, "lo", "hi").distinct()
        if not keys:  # one group: its ranges, two a quantile at most, are sent to all tasks
            return rows.join(F.broadcast(r), (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        return rows.join(r, [*same(rows, r), F.col("x") >= F.col("lo"), F.col("x") <= F.col("hi")]).select(*[r[k] for k in keys], "lo", "hi", "x")

    while True:
        found = F.col("lo") == F.col("hi")
        done.append(state.where(found).select(*keys, "rank", F.col("lo").alias("value")))
        short, state = state.where(~found & (F.col("count") <= few)), state.where(~found & (F.col("count") > few))
        if not short.isEmpty():
            place = Window.partitionBy(*keys, "lo", "hi").orderBy("x")
            ranked = within(short).withColumn("place", F.row_number().over(place) - 1)
            done.append(scratch.table(_joined(short, ranked, keys).where(F.col("rank") == F.col("before") + F.col("place")).select(*keys, "rank", F.col("x").alias("value"))))
        if state.isEmpty():
            break
        counted = within(state).groupBy(*keys, "lo", "hi", _bin(bins).alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        upto = Window.partitionBy(*keys, "lo", "hi").orderBy("bin")  # of bins
        counted = counted.withColumn("upto", F.sum("n").over(upto))
        holds = (F.col("rank") < F.col("before") + F.col("upto")) & (F.col("rank") >= F.col("before") + F.col("upto") - F.col("n"))
        further = _joined(state, counted, keys).where(holds)
        state = scratch.table(further.select(*keys, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("before") + F.col("upto") - F.col("n")).alias("before"), F.col("n").alias("count")))

    values = done[0]
    for more in done[1:]:
        values = values.unionByName(more)
    values = scratch.table(values)
    end = lambda rank: values.select(*[F.col(k).alias(f"{rank}{k}") for k in keys], F.col("rank").alias(rank), F.col("value").alias(f"{rank}_value"))
    for rank in ("first", "second"):
        other = end(rank).withColumnRenamed(rank, f"{rank}_rank")
        asked = asked.join(other, [*[asked[k].eqNullSafe(other[f"{rank}{k}"]) for k in keys], asked[rank] == other[f"{rank}_rank"]], "left")
    low, high = F.col("first_value"), F.col("second_value")
    between = F.when((F.col("part") == 0) | (low == high) | (F.abs(low) == float("inf")) | (F.abs(high) == float("inf")), low).otherwise(low + (high - low) * F.col("part"))
    return asked.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], "q", between.alias("value"))


def _joined(state: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted ranks with what was found in their ranges."""
    other = counted.withColumnsRenamed({k: f"_of{k}" for k in keys} | {"lo": "_lo", "hi": "_hi"})
    on = [*[state[k].eqNullSafe(other[f"_of{k}"]) for k in keys], state["lo"] == other["_lo"], state["hi"] == other["_hi"]]
    return state.join(other, on)
