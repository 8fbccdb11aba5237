"""Work along an order that is dealt to parts, against plain windows and nested loops on small tables."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import asof_join, inequality_join, interval_join, sessions, whole_ranks
from tessera.operators.joins import inequality_pairs
from tessera.operators.ordered import PART, edges, ordered_parts

rows_of = lambda df, *columns: sorted(repr(tuple(r)) for r in df.select(*(columns or df.columns)).collect())


def hot(seed, n, keys=(1, 1, 1, 1, 2, 3, None), span=400):
    """Rows of (key, other key, time), most of one key, many at equal times."""
    r = random.Random(seed)
    return [(r.choice(keys), r.choice(["a", "a", "a", None]), r.choice([None, *range(span)]) if i % 50 == 0 else r.randrange(span), r.randrange(5)) for i in range(n)]


def test_parts_are_even_whatever_the_keys(spark):
    df = spark.range(20_000).select(F.lit(7).alias("k"), F.lit("same").alias("v"))
    parts = ordered_parts(df, [F.col("k"), F.col("v")], "even", 10)
    sizes = [e["n"] for e in edges(parts, F.count("*").alias("n"))]
    assert len(sizes) == 10 and sum(sizes) == 20_000 and max(sizes) < 4_000


def test_a_hot_key_is_spread_and_its_largest_task_does_not_grow_with_its_rows(spark):
    largest = []
    for n in (10_000, 40_000):
        df = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") % 1000).alias("t"))
        largest.append(max(e["n"] for e in edges(ordered_parts(df, [F.col("k"), F.col("t")], "hot", n // 1000), F.count("*").alias("n"))))
    assert max(largest) < 4_000


@pytest.mark.parametrize("seed, n", [(1, 600), (2, 40), (3, 3)])
def test_asof_of_hot_keys_is_that_of_plain_windows(spark, seed, n):
    left = spark.createDataFrame([(*x[:3], i) for i, x in enumerate(hot(seed, n))], "k int, o string, t int, row int")
    right = spark.createDataFrame([(*x[:3], x[3]) for x in hot(seed + 10, n // 3)], "k int, o string, rt int, v int")
    plain = asof_join(left, right, ["k", "o"], "t", "rt", ["rt", "v"])
    spread = asof_join(left, right, ["k", "o"], "t", "rt", ["rt", "v"], key_rows=1)
    assert spread.columns == plain.columns and rows_of(spread) == rows_of(plain)
    assert plain.count() == n
    assert rows_of(asof_join(left, right.limit(0), ["k", "o"], "t", "rt", ["v"], key_rows=0)) == rows_of(left.withColumn("v", F.lit(None).cast("int")))
    assert asof_join(left.limit(0), right.limit(0), ["k", "o"], "t", "rt", ["v"], key_rows=-1).count() == 0


@pytest.mark.parametrize("seed, n, span", [(1, 500, 4000), (2, 500, 50), (3, 60, 600), (4, 2, 10)])
def test_sessions_of_hot_keys_are_those_of_plain_windows(spark, seed, n, span):
    rows = spark.createDataFrame(hot(seed, n, span=span), "u int, o string, m int, v int")
    rows = rows.select("u", "o", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, m)").alias("ts"))
    for gap in (60, 600, 3600):
        plain, spread = sessions(rows, ["u", "o"], "ts", gap), sessions(rows, ["u", "o"], "ts", gap, key_rows=1)
        assert rows_of(spread, *plain.columns) == rows_of(plain)
    assert sessions(rows.limit(0), ["u"], "ts", 60, key_rows=-1).count() == 0


def plain_ranks(df, by, ascending, tiles):
    w = Window.orderBy(*[F.col(c).asc() if a else F.col(c).desc() for c, a in zip(by, ascending)])
    return df.select(
        "*", F.row_number().over(w).cast("long").alias("row_number"), F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense_rank"),
        F.ntile(tiles).over(w).cast("long").alias("ntile"), F.percent_rank().over(w).alias("percent_rank"), F.cume_dist().over(w).alias("cume_dist"),
    )


@pytest.mark.parametrize("seed, n, parts", [(1, 300, 7), (2, 300, 60), (3, 5, 4), (4, 1, 3)])
def test_whole_ranks_are_those_of_one_window(spark, seed, n, parts):
    r = random.Random(seed)
    rows = [(r.choice([1.5, 1.5, 1.5, 2.0, float("nan"), None, -0.0, 7.25]), r.choice(["x", None, "y"]), i) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b string, id int")
    for by, up in ((["a"], [False]), (["a", "b"], [True, False]), (["b", "id"], [True, True]), (["id"], [False])):
        for tiles in (4, 7)[: 1 + (by == ["a"])]:
            got, want = whole_ranks(df, by, up, tiles, parts), plain_ranks(df, by, up, tiles)
            ties = ["rank", "dense_rank", "percent_rank", "cume_dist"]
            assert rows_of(got, "id", *ties) == rows_of(want, "id", *ties)
            numbered = [*map(F.col, by), "row_number", "ntile"]
            assert rows_of(got, *numbered) == rows_of(want, *numbered)
    assert whole_ranks(df.limit(0), ["a"]).count() == 0


def test_whole_ranks_use_no_single_task(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("v"))
    plan = whole_ranks(df, ["v"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


INF, NAN = float("inf"), float("nan")


def test_intervals_of_any_length(spark):
    r = random.Random(5)
    points = [(i, x) for i, x in enumerate([None, NAN, INF, -INF, 0.0, -0.0, 1e300, -1e300, 2.5e18, *[r.uniform(-50, 1050) for _ in range(200)]])]
    spans = [(-1e9, 1e9), (-INF, INF), (0.0, NAN), (5.0, 5.0), (7.0, 3.0), (None, 1.0), (1e299, INF), (-INF, -1e250), *[(a, a + 2 ** r.uniform(-3, 10)) for a in (r.uniform(-20, 1000) for _ in range(100))]]
    p = spark.createDataFrame(points, "id int, p double")
    s = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "span int, a double, b double")
    want = rows_of(p.join(s, (p.p >= s.a) & (p.p < s.b)), "id", "span")
    for width in (1.0, 1e-6, 1e7):
        assert rows_of(interval_join(p, s, "p", "a", "b", width), "id", "span") == want
    assert interval_join(p, s.limit(0), "p", "a", "b", 1.0).count() == interval_join(p.limit(0), s, "p", "a", "b", 1.0).count() == 0


def test_a_very_long_interval_makes_few_rows(spark):
    from tessera.operators.joins import dyadic_cover

    for lo, hi in ((0, 10**9), (1, 10**9 + 1), (-(2**61), 2**61), (3, 4), (-7, 9), (5, 5)):
        blocks = spark.sql(f"select {lo}L as lo, {hi}L as hi").select(dyadic_cover("lo", "hi").alias("b")).first().b
        assert len(blocks) <= 2 * max(1, math.ceil(math.log2(max(2, hi - lo))))
        covered = sorted((b.block << b.level, (b.block + 1) << b.level) for b in blocks)
        assert all(a[1] == b[0] for a, b in itertools.pairwise(covered))
        assert (not covered and hi == lo) or (covered[0][0], covered[-1][1]) == (lo, hi)


def test_intervals_of_times(spark):
    p = spark.sql("select id, timestamp_ntz'2024-03-31 00:30:00' + make_dt_interval(0, 0, cast(id as int) * 7, 0.25) as p from range(60)")
    s = spark.sql("select id as span, timestamp_ntz'2024-03-31 00:00:00' + make_dt_interval(0, 0, cast(id as int) * 11) as a, timestamp_ntz'2024-03-31 00:00:00' + make_dt_interval(0, 0, cast(id as int) * 11 + cast(pow(2, id % 9) as int)) as b from range(40)")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # an hour of that night is left out there
    try:
        want = rows_of(p.join(s, (p.p >= s.a) & (p.p < s.b)), "id", "span")
        assert want and rows_of(interval_join(p, s, "p", "a", "b", 60.0), "id", "span") == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 30), st.integers(0, 30), st.integers(1, 12), st.sampled_from(sorted(OPS)), st.sampled_from(sorted(OPS)), st.integers(0, 10**6))
def test_inequality_pairs(n, m, spread, x_op, y_op, seed):
    g = np.random.default_rng(seed)
    lx, ly, rx, ry = (g.integers(0, spread, k) for k in (n, n, m, m))
    i, j = inequality_pairs(lx, ly, rx, ry, x_op, y_op)
    assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(n) for b in range(m) if OPS[x_op](lx[a], rx[b]) and OPS[y_op](ly[a], ry[b])]


@pytest.mark.parametrize("x_op, y_op", [("<", "<="), (">", ">="), ("<=", ">"), (">=", "<")])
def test_inequality_join(spark, x_op, y_op):
    r = random.Random(x_op + y_op)
    value = lambda: r.choice([None, NAN, 2.0**60 + 1, *map(float, range(10))])
    left = spark.createDataFrame([(i, r.choice([None, 2**60, 2**60 + 1, *range(12)]), value()) for i in range(60)], "l int, lx long, ly double")
    right = spark.createDataFrame([(i, r.choice([None, 2**60, 2**60 + 1, *range(12)]), value()) for i in range(50)], "r int, rx long, ry double")
    got = inequality_join(left, right, ("lx", x_op, "rx"), ("ly", y_op, "ry"), rows_per_part=9)
    want = left.join(right, F.expr(f"lx {x_op} rx and ly {y_op} ry"))
    assert got.columns == want.columns and rows_of(got) == rows_of(want)


def test_inequality_join_of_nothing_and_its_plan(spark):
    left, right = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "c int, d int")
    assert inequality_join(left.limit(0), right, ("a", "<", "c"), ("b", "<", "d")).count() == 0
    got = inequality_join(left, right, ("a", "<", "c"), ("b", "<", "d"))
    assert got.count() == 1 and "NestedLoop" not in got._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        inequality_join(left, left, ("a", "<", "a"), ("b", "<", "b"))
    with pytest.raises(TypeError):
        inequality_join(left, right.select(F.col("c").cast("string"), "d"), ("a", "<", "c"), ("b", "<", "d"))


def test_pairs_of_an_interval_join_are_dealt_to_tasks_by_their_number(spark):
    """One crowded block with more points, one with more intervals, and others."""
    points = spark.range(3000).select("id", F.when(F.col("id") < 2500, 5.0).when(F.col("id") < 2510, 45.0).otherwise(F.col("id") / 10).alias("p"))
    spans = spark.range(900).select(F.col("id").alias("span"), F.when(F.col("id") < 60, 4.0).when(F.col("id") < 850, 44.0).otherwise(F.col("id") / 3).alias("a")).withColumn("b", F.col("a") + 3)
    want = points.join(spans, (F.col("p") >= F.col("a")) & (F.col("p") < F.col("b")))
    got = interval_join(points, spans, "p", "a", "b", 3.0, task_pairs=10_000)
    assert got.columns == want.columns and rows_of(got, "id", "span") == rows_of(want, "id", "span")
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) > 150_000 and max(sizes) < 50_000  # of one block with 150,000 pairs


def test_pairs_of_inequalities_come_in_steps(spark, monkeypatch):
    from tessera.operators import joins

    monkeypatch.setattr(joins, "HELD_PAIRS", 1000)
    r = np.random.default_rng(3)
    lx, ly, rx, ry = r.integers(0, 50, 400), r.integers(0, 50, 400), r.integers(0, 50, 300), r.integers(0, 50, 300)
    steps = list(joins.pairs_in_steps(lx, ly, rx, ry, "<", ">="))
    want = {(i, j) for i in range(400) for j in range(300) if lx[i] < rx[j] and ly[i] >= ry[j]}
    assert sum(len(i) for i, _ in steps) == len(want) and {p for i, j in steps for p in zip(i.tolist(), j.tolist())} == want
    assert len(steps) > 10 and max(len(i) for i, _ in steps) < 1000 + 300
    a, b = (spark.createDataFrame([(k, int(x), int(y)) for k, (x, y) in enumerate(zip(*xy))], f"{n} int, {n}x int, {n}y int") for n, xy in (("a", (lx, ly)), ("b", (rx, ry))))
    got = inequality_join(a, b, ("ax", "<", "bx"), ("ay", ">=", "by"))
    assert {(p.a, p.b) for p in got.collect()} == want and got.count() == len(want)
    assert "CoGroup" not in got._jdf.queryExecution().toString()  # that hands on all pairs of a meeting at once
