import math
import random
import tracemalloc

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import topk


def brute(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_awkward_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_CELL", 90)
    monkeypatch.setattr(topk, "QUERY_CELL", 3)
    monkeypatch.setattr(topk, "BLOCK", 40)
    r = random.Random(2)
    rows = [(i, [float(np.float32(r.gauss(0, 0.2))) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(7, rows[7][1]), (100, rows[100][1])]
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 8), (2150, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (2200, []), (2250, [1.0, 2.0]), (2251, [3.0, -2.0]), (-50, [0.1] * 8)]
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame([(i, v, None) for i, v in rows], schema).repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, topk.op9_top_k(spark, str(tmp_path)).collect()))
    want = brute(rows)
    # The doubled query gives its rows twice.
    assert sorted(x for x in got if x[0] != 100) == [x for x in want if x[0] != 100]
    assert len([x for x in got if x[0] == 100]) == 10
    assert topk.top_k(spark.createDataFrame([], schema), topk.F.col("vec_id") % 50 == 0).count() == 0


def test_large_values(spark):
    rows = [(i, [(-1.0) ** i * 10.0 ** (i % 17), float(i)]) for i in range(120)] + [(200, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, topk.F.col("vec_id") % 50 == 0).collect()))
    small = [x for x in brute(rows) if abs(x[3]) < 2**62]
    assert [x for x in got if abs(x[3]) < 2**62] == small


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, topk.op9_top_k(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(topk.OP9_SQL).fetchall())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 6), st.integers(1, 4), st.integers(0, 10**6))
def test_block_search(n, dims, spread, seed):
    g = np.random.default_rng(seed)
    rows, ids = g.integers(-spread, spread + 1, (n, dims)).astype(float), g.permutation(n)
    for i, (best, scores) in enumerate(topk.search_cell(rows[:9], ids[:9], rows, ids, 5, block=110)):
        want = sorted((-int(rows[j] @ rows[i]), int(ids[j])) for j in range(n) if j != i)[:5]
        assert [(-int(s), int(b)) for s, b in zip(scores, best)] == want


def test_reading_stops_before_the_end():
    g = np.random.default_rng(1)
    rows = np.floor(256 * (lambda x: x / np.linalg.norm(x, axis=1)[:, None])(g.normal(size=(2000, 64))))
    lists = topk.Lists(rows, np.arange(2000))
    read = []
    for i in range(0, 2000, 100):
        best, scores, share = lists.search(rows[i], i, 5)
        want = sorted((-int(rows[j] @ rows[i]), j) for j in range(2000) if j != i)[:5]
        assert [(-int(s), int(b)) for s, b in zip(scores, best)] == want
        # A floor that others have reached lets a block stop earlier, and loses nothing at or above it.
        more, high, less = lists.search(rows[i], i, 5, float(scores[0]))
        assert less <= share and scores[0] in high.tolist()
        read.append(share)
    assert np.mean(read) < 0.85


def test_clashing_names(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = sorted(map(tuple, topk.top_k(df, topk.F.col("vec_id") % 50 == 0).collect()))
    for name in ("id", "vec", "asks", "row", "dim", "rank", "score"):
        df = df.withColumn(name, topk.F.lit("own"))
    assert sorted(map(tuple, topk.top_k(df, topk.F.col("vec_id") % 50 == 0).collect())) == want


def test_long_vectors_take_bounded_memory():
    g = np.random.default_rng(3)
    rows, queries = np.floor(g.normal(0, 30, (1500, 4096))), np.floor(g.normal(0, 30, (20, 4096)))
    assert topk.vectors_in(topk.CELL_BYTES, topk.CANDIDATE_CELL, 4096) * 8 * 4096 <= topk.CELL_BYTES and topk.vectors_in(topk.CELL_BYTES, topk.CANDIDATE_CELL, 64) == 1 << 16
    assert topk.vectors_in(1, 10, 4096) == topk.vectors_in(1, 10, 0) == 1
    tracemalloc.start()
    found = topk.search_cell(queries, np.full(20, -1), rows, np.arange(1500), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20  # besides the cell's own vectors, whose bytes are bounded; a single block of all would take 600 MB
    scores = rows @ queries.T
    for i, (ids, best) in enumerate(found):
        assert best.tolist() == sorted(scores[:, i].tolist(), reverse=True)[:5] and scores[ids, i].tolist() == best.tolist()


def test_lengths_have_cells_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_BYTES", 8 * 40)
    r = random.Random(7)
    rows = [(i, [float(r.randrange(-3, 4)) for _ in range((1, 4, 40, 90)[i % 4])]) for i in range(260)]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), topk.F.col("vec_id") % 50 == 0).collect()))
    assert got == brute(rows)


def test_an_early_look_ends_a_search_that_is_decided():
    # One candidate in each direction: a quarter of the lists tells that no outsider qualifies.
    g = np.random.default_rng(1)
    rows = np.zeros((2000, 64))
    rows[np.arange(2000), np.arange(2000) % 64] = g.integers(1, 1000, 2000)
    ids, scores, share = topk.Lists(rows, np.arange(2000)).search(rows[70], -1, 3)
    assert share == 0.25 and scores.tolist() == sorted((rows @ rows[70]).astype(int).tolist(), reverse=True)[:3]
