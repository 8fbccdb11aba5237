"""Exact quantiles, reach, kept sketches and semi-structured columns against brute force."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import semistructured
from tessera.operators import added, daily_sketches, exact_quantiles, over_spans, reach

INF, NAN = float("inf"), float("nan")


def brute_quantile(values, q):
    values = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    if not values:
        return None
    at = (len(values) - 1) * q
    lo, hi = values[math.floor(at)], values[math.ceil(at)]
    return lo if at == math.floor(at) or lo == hi or INF in (abs(lo), abs(hi)) else lo + (hi - lo) * (at - math.floor(at))


@pytest.mark.parametrize("bins, few", [(64, 20), (1024, 10_000)])
def test_exact_quantiles(spark, bins, few):
    r = random.Random(bins)
    groups = {
        "even": [r.uniform(-5, 5) for _ in range(500)], "ties": [r.choice([1.0, 1.0, 2.5]) for _ in range(300)], "steep": [10.0 ** r.uniform(-300, 300) * r.choice([1, -1]) for _ in range(200)],
        "ends": [INF, -INF, NAN, None, 0.0, -0.0, 1.7e308, -1.7e308, 5e-324, 1e-323] * 3, "one": [7.0], "none": [None, None], None: [3.0, 1.0, None], "same": [2.0] * 100, "nan": [NAN, NAN, 1.0],
    }
    rows = [(k, v) for k, values in groups.items() for v in values]
    r.shuffle(rows)
    qs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {(x.g, x.q): x.value for x in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", qs, bins, few).collect()}
    want = {(k, q): brute_quantile(values, q) for k, values in groups.items() for q in qs}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == v or v is not None and (math.isnan(v) and math.isnan(got[k]) or math.isclose(v, got[k], rel_tol=1e-12)), (k, v, got[k])


def test_quantiles_of_a_whole_table_and_of_nothing(spark):
    df = spark.range(10_001).select(F.col("id").alias("lo"))  # a name of its own
    assert [r.value for r in exact_quantiles(df, [], "lo", [0.25, 0.5], few=10).orderBy("q").collect()] == [2500.0, 5000.0]
    assert exact_quantiles(df.limit(0).withColumn("g", F.lit(1)), ["g"], "lo", [0.5]).count() == 0
    with pytest.raises(ValueError):
        exact_quantiles(df, [], "lo", [1.5])


def brute_reach(links, seeds, most=None):
    steps, frontier, n = {s: 0 for s in seeds if s is not None}, {s for s in seeds if s is not None}, 0
    while frontier and (most is None or n < most):
        n += 1
        frontier = {b for a, b in links if a in frontier and b is not None} - steps.keys()
        steps |= dict.fromkeys(frontier, n)
    return sorted(steps.items())


def test_reach(spark):
    r = random.Random(1)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(90)] + [(5, 5), (5, 5), (None, 3), (7, None)] + [(i, 1000) for i in range(60)] + [(2000 + i, 2001 + i) for i in range(12)] + [(2012, 2000)]
    df = spark.createDataFrame(links, "source int, target int")
    for seeds, most in (([3, 3, None, 2000], None), ([2000, 5], 4), ([], None)):
        start = spark.createDataFrame([(s,) for s in seeds], "node int")
        assert sorted(map(tuple, reach(df, start, most).collect())) == brute_reach(links, seeds, most)


def test_sketches_of_any_span_are_near_the_exact_counts(spark):
    r = np.random.default_rng(4)
    n = 60_000
    day, user, kind = r.integers(0, 40, n), r.integers(0, 20_000, n), r.integers(0, 2, n)
    df = spark.createDataFrame(list(zip(day.tolist(), user.tolist(), kind.tolist())), "d int, u int, kind int").withColumn("ts", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).cast("timestamp_ntz"))
    values = {"users": F.col("u"), "d": F.col("d")}
    # The second half comes later and is added to what is kept.
    kept = added(daily_sketches(df.where("u % 2 = 0"), "ts", ["kind"], values), daily_sketches(df.where("u % 2 = 1"), "ts", ["kind"], values), ["kind"], list(values))
    spans = [(0, 0), (0, 39), (3, 17), (30, 39), (50, 60)]
    asked = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "span int, a int, b int").select("span", *[F.date_add(F.lit("2024-01-01").cast("date"), F.col(c)).alias(name) for c, name in (("a", "first_day"), ("b", "last_day"))])
    got = {(x.span, x.kind): x for x in over_spans(kept, asked, ["kind"], list(values)).collect()}
    assert set(got) == {(i, k) for i in range(4) for k in (0, 1)}
    for (i, k), x in got.items():
        inside = (day >= spans[i][0]) & (day <= spans[i][1]) & (kind == k)
        exact = len(set(user[inside]))
        assert x.n == inside.sum() and abs(x.users - exact) <= max(2, 0.05 * exact) and x.d == spans[i][1] - spans[i][0] + 1


DOCUMENTS = [
    '{"user": {"name": "A", "tags": ["x", "y", null, {"deep": 1}]}, "n": 1}', '{"user": {"tags": []}, "n": "two"}', '{"n": 2.5, "user": null}', "[1, 2, 3]", "7", '"text"', "null",
    "{broken", "", None, '{"n": 9223372036854775808}', '{"user": {"tags": "no list"}, "n": true}',
]


def test_documents_of_any_shape(spark):
    df = spark.createDataFrame(list(enumerate(DOCUMENTS)), "id int, text string")
    good, bad = semistructured.parsed(df, "text")
    assert sorted(r.id for r in bad.collect()) == [7, 8] and bad.columns == df.columns
    got = {r.id: (r.name, r.n, r.tag) for r in good.select("id", semistructured.at("document", "$.user.name", "string").alias("name"), semistructured.at("document", "$.n", "long").alias("n"), semistructured.at("document", "$.user.tags[1]", "string").alias("tag")).collect()}
    assert got[0] == ("A", 1, "y") and got[1] == (None, None, None) and got[9] == (None, None, None) and got[3] == (None, None, None)
    assert got[10] == (None, None, None)  # past what the type holds: null, not an error
    tags = semistructured.elements(good, "document", "$.user.tags", "tag").select("id", "place", F.to_json("tag").alias("tag")).collect()
    assert sorted((r.id, r.place, r.tag) for r in tags if r.id == 0) == [(0, i, x if x is None else json.dumps(x, separators=(",", ":"))) for i, x in enumerate(["x", "y", None, {"deep": 1}])] or sorted((r.id, r.place) for r in tags if r.id == 0) == [(0, i) for i in range(4)]
    assert {r.id for r in tags} <= {0, 11}
    shapes = {r.kind: r.n for r in semistructured.kinds(good.where("text is not null"), "document", []).collect()}
    assert shapes["ARRAY<BIGINT>"] == 1 and shapes["STRING"] == 1 and sum(shapes.values()) == 9
    assert semistructured.parsed(df.limit(0), "text")[0].count() == 0
