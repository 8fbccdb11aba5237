"""What intervals hold, against all pairs on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import interval_totals
from tessera.operators.ranges import NONE, largest_between
from tessera.plans import catalog

NAN = float("nan")


def test_largest_between():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64, 100):
        values = r.integers(-50, 50, n)
        lo, hi = (x.ravel() for x in np.meshgrid(np.arange(n + 1), np.arange(n + 1)))
        assert largest_between(values, lo, hi).tolist() == [max(values[a:b].tolist(), default=NONE) for a, b in zip(lo, hi)]


@pytest.mark.parametrize("part_rows", [7, 100, 100_000])
def test_totals_are_those_of_all_pairs(spark, part_rows):
    r = random.Random(part_rows)
    points = [(r.choice([None, NAN, 0.0, -0.0, 5.0, 5.0, r.uniform(0, 40)]), r.choice([None, r.randrange(-9, 1000)])) for _ in range(300)]
    spans = [(i % 70, *r.choice([(None, 1.0), (5.0, 5.0), (0.0, NAN), (-1.0, 0.0), (0.0, 5.0), (90.0, 99.0)])) if i % 3 == 0 else (i % 70, a := r.uniform(-1, 40), a + r.choice([0.01, 1, 9])) for i in range(150)]
    p, s = spark.createDataFrame(points, "p double, v long"), spark.createDataFrame(spans, "span int, a double, b double")
    rows_of = lambda df: sorted(map(repr, map(tuple, df.collect())))
    ids = s.withColumn("row", F.monotonically_increasing_id()).localCheckpoint()
    want = ids.join(p, (p.p >= ids.a) & (p.p < ids.b)).groupBy("row", "span", "a", "b").agg(F.count("*").alias("n"), F.max("v").alias("most")).drop("row")
    got = interval_totals(p, s, "p", "a", "b", "v", "n", "most", part_rows)
    assert got.columns == want.columns and rows_of(got) == rows_of(want) != []
    assert interval_totals(p.limit(0), s, "p", "a", "b", "v", "n", "most").count() == interval_totals(p, s.limit(0), "p", "a", "b", "v", "n", "most").count() == 0


def test_windows_of_any_length_make_no_pairs(spark, tmp_path):
    spark.range(4000).select(F.col("id").alias("event_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.when(F.col("id") % 2 == 0, "click").otherwise("error").alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    df = catalog.QUERIES["join_interval_any_length"](spark, str(tmp_path))
    assert df.agg(F.count("*"), F.min("clicks"), F.min("last_id")).first()[:] == (2000, 2000, 3998)
    assert "_block" not in df._jdf.queryExecution().toString()
