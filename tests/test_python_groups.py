"""Python functions by group, on groups that are many, large, null or empty."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.plans import catalog


def test_rows_of_many_small_users_and_one_large_share_groups(spark, tmp_path, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, F.lit(7)).when(F.col("id") % 51 == 0, F.lit(None)).otherwise(F.col("id")).cast("long").alias("user_id"))
    rows = rows.withColumn("value", F.when(F.col("event_id") % 10 > 0, F.col("event_id") / 4))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    by_user = defaultdict(list)
    for r in rows.collect():
        by_user[r.user_id].append((r.event_id, None if r.value is None else r.event_id * 25))
    want = {}
    for own in by_user.values():
        total = sum(c for _, c in own if c is not None)
        want |= {e: None if c is None else (c * len(own) - total) / (100 * len(own)) for e, c in own}
    monkeypatch.setattr(catalog, "GROUP_ROWS", 500)
    df = catalog.QUERIES["python_grouped"](spark, str(tmp_path))
    assert {r.event_id: r.off for r in df.collect()} == want
    # A group is no user: there are as many as the rows ask for.
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow [part" in plan


def test_geometric_means_come_from_sums_of_batches(spark):
    from tessera.functions import geometric_means

    rows = [(g, 1.0 + i % 17 if g != "none" else None) for i, g in enumerate(["a", "a", "b", None, "none"] * 400)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = geometric_means(df, ["g"], "v", "typical")
    want = {}
    for g in {g for g, _ in rows}:
        logs = [math.log(v) for x, v in rows if x == g and v is not None]
        want[g] = math.exp(math.fsum(logs) / len(logs)) if logs else None
    found = {r.g: r.typical for r in got.collect()}
    assert found.keys() == want.keys() and all(v is None and found[g] is None or math.isclose(v, found[g], rel_tol=1e-12) for g, v in want.items())
    assert geometric_means(df.limit(0), ["g"], "v", "typical").count() == 0
    # No task is handed a group: Python comes before the exchange.
    assert "AggregateInPandas" not in got._jdf.queryExecution().toString() and "ArrowAggregate" not in got._jdf.queryExecution().toString()
