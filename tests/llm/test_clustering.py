import hashlib
import math

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int"
LONG = 2**63 - 1


def brute(rows, k, rounds, dims):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), e) for i, e in good if i is not None)[:k]
    centres = [e for _, e in starts]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(e, c)), n) for n, c in enumerate(centres)) for _, e in good]

    for _ in range(rounds):
        took = assign()
        for n in range(len(centres)):
            own = [e for (_, e), (_, m) in zip(good, took) if m == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own)]
    took = assign()
    sums = {n: sum(min(d, LONG) for d, m in took if m == n) for _, n in took}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    out = [(i, n, min(d, LONG), min(sums[n], LONG), min(sum(sums.values()), LONG), sha[n]) for (i, _), (d, n) in zip(good, took)]
    return sorted(out, key=str)


def check(spark, rows, k=40, rounds=5, dims=64):
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).repartition(4)
    got = sorted(map(tuple, clustering.clusters(df, k, rounds, dims).collect()), key=str)
    assert got == brute(rows, k, rounds, dims)


def made(seed, n, dims, groups=None):
    g = np.random.default_rng(seed)
    if groups is None:
        x = g.normal(0, 0.2, (n, dims))
    else:
        x = g.normal(0, 1, (groups, dims))[g.integers(0, groups, n)] + g.normal(0, 0.01, (n, dims))
    return [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]


def test_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 70)
    rows = made(1, 300, 64, 12) + [(1000 + i, made(1, 1, 64, 12)[0][1]) for i in range(150)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, None), (2000, None), (2001, [1.0] * 63), (2002, [1.0] * 63 + [None]), (2003, [float("nan")] * 64), (2004, [float("-inf")] * 64), (2005, []), (2006, [0.0] * 64)]
    check(spark, rows)


def test_few_vectors_and_an_empty_table(spark):
    check(spark, made(2, 5, 64))
    check(spark, [(1, [0.5] * 64)] * 3)
    assert clustering.clusters(spark.createDataFrame([], SCHEMA)).count() == 0
    assert clustering.clusters(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0


def test_large_components(spark):
    rows = [(i, [(-1.0) ** i * 10.0 ** (i % 30), float(i), 3e38 if i % 13 == 0 else -0.25]) for i in range(60)]
    check(spark, rows, 6, 3, 3)


def test_clashing_columns(spark):
    rows = made(3, 200, 64, 5)
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    for name in ("id", "vec", "hash", "cluster", "distance", "ids", "points", "inertia"):
        df = df.withColumn(name, F.lit("own"))
    assert sorted(map(tuple, clustering.clusters(df).collect()), key=str) == brute(rows, 40, 5, 64)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 4), st.integers(1, 30), st.integers(1, 40), st.integers(0, 10**6))
def test_dual_trees_find_what_all_pairs_find(n, dims, k, spread, seed):
    g = np.random.default_rng(seed)
    points, centres = g.integers(-spread, spread + 1, (n, dims)).astype(float), g.integers(-spread, spread + 1, (k, dims)).astype(float)
    tree = clustering.CoverTree.build(points, 3)
    number, best = clustering.nearest(tree, clustering.CoverTree.build(centres, 2))
    d = ((tree.points[:, None] - centres[None]) ** 2).sum(-1)
    assert (best == d.min(axis=1)).all() and (number == d.argmin(axis=1)).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.integers(1, 3), st.integers(1, 60), st.integers(0, 10**6))
def test_cover_tree_invariants(n, dims, spread, seed):
    points = np.random.default_rng(seed).integers(-spread, spread + 1, (n, dims)).astype(float)
    tree = clustering.CoverTree.build(points, 2)
    assert (tree.points == points[tree.order]).all() and sorted(tree.order) == list(range(n))
    for i in range(len(tree.start)):
        own = tree.points[tree.start[i] : tree.end[i]]
        assert tree.start[i] <= tree.centre[i] < tree.end[i]
        assert math.isclose(np.sqrt(((own - tree.points[tree.centre[i]]) ** 2).sum(1)).max(), tree.radius[i])
        below = range(tree.first[i], tree.first[i] + tree.count[i])
        if below:
            assert tree.start[below[0]] == tree.start[i] and tree.end[below[-1]] == tree.end[i]
            assert tree.centre[i] in [tree.centre[j] for j in below]
            centres = tree.points[[tree.centre[j] for j in below]]
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(-1))[~np.eye(len(below), dtype=bool)]
            assert all(tree.radius[j] <= tree.radius[i] / 2 for j in below) and (apart > tree.radius[i] / 2).all()


def test_clustered_vectors_are_pruned(monkeypatch):
    rows = np.array([v for _, v in made(4, 2000, 64, 20)])
    points, seen = clustering.whole(rows), []
    real = clustering.squares
    tree, centres = clustering.CoverTree.build(points, 16), clustering.CoverTree.build(points[:20], 2)
    monkeypatch.setattr(clustering, "squares", lambda p, c: seen.append(len(p)) or real(p, c))
    clustering.nearest(tree, centres)
    assert sum(seen) < 0.35 * len(points) * 20


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(clustering.OP13_SQL)
    assert sorted(map(tuple, clustering.op13_centroid_clusters(spark, sf).select([d[0] for d in want.description]).collect())) == sorted(want.fetchall())
