"""Operator 13, centroid clustering: Lloyd's rounds by dual trees.

Vectors are whole numbers (``floor(256 x)``). Each run of ``BLOCK`` vectors that a task reads becomes a cover tree, once: a node's
children are centred on points of the node, its own centre first, more than half its radius apart, and every point of the node is
within half its radius of the child that takes it. Trees are written to the shared folder, and all rounds read them there.

In each round the centroids, which are few, become a cover tree of their own in every task. Pairs of a vector node and a
centroid node are followed from both roots: a pair is dropped when the least distance between a point of the one and a centroid of
the other exceeds the most that the node's points can be from the nearest centroid known (a centroid node's centre is a centroid).
The wider side of the pairs is opened first. Where vector leaves and centroid leaves are left, their points are compared exactly, in whole
numbers; a node that is left with a single centroid takes it whole. Tasks send only sums and counts by centroid.

Work: where vectors have clusters, most pairs go at the upper levels; where all vectors are about equally far from each other,
as random ones are in many dimensions, nothing can be pruned, and a round costs what comparing all vectors with all centroids does.

Defined cases: vectors that are null, have another number of components, or hold a null, NaN or infinity take no part; a row without
an id is clustered but never a start; repeated rows are vectors of their own, starts too; starts with equal hashes are taken by their components;
fewer vectors than centroids give fewer centroids, no start at all no rows; equal distances go to the smaller centroid number; a centroid that
loses all its vectors stays where it is; components past 2^136 are held there, distances and sums of them past 64
bits at the limit; an empty table gives an empty table; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import columns as C
from tessera.session import Scratch

SCALE = 256.0
DIMS, CENTROIDS, ROUNDS = 64, 40, 5
#: Vectors of a tree, and points of a leaf (of vectors, of centroids).
BLOCK, LEAF, FEW_CENTROIDS = 2048, 16, 2
#: Trees of a file: a reader holds a few files' rows at most.
TREES_A_FILE = 64
#: Differences of components below this have exact squared distances as doubles in 64 dimensions.
EXACT = 2.0**52
LARGEST = 2.0**136
LONG = 2**63 - 1
#: Room for the rounding of roots and sums when bounds are compared.
SLACK = 1e-9


def squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of points to one centre; exact while they stay below :data:`EXACT`."""
    away = points - centre
    return np.einsum("ij,ij->i", away, away)


class CoverTree:
    """Points in the tree's order and its nodes, children of a node side by side.

    ``start:end`` are a node's points, ``centre`` one of them, ``radius`` the largest distance of a point to it, ``first`` and ``count`` its children.
    """

    FIELDS = ("start", "end", "centre", "first", "count")

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray):
        self.points, self.order, self.nodes = points, order, nodes
        for i, name in enumerate(self.FIELDS):
            setattr(self, name, nodes[i].astype(np.int64))
        self.radius = nodes[len(self.FIELDS)]

    @classmethod
    def build(cls, points: np.ndarray, leaf: int) -> CoverTree:
        order = np.arange(len(points))
        nodes = [[0, len(points), 0, 0, 0, 0.0]]
        away = [np.sqrt(squares(points, points[0]))]  # of each open node's points to its centre
        at = 0
        while at < len(nodes):
            start, end, centre, _, _, _ = nodes[at]
            near, away[at] = away[at], None
            radius = nodes[at][5] = float(near.max())
            if end - start > leaf and radius > 0:
                members = order[start:end]
                own = points[members]
                centres, owner = [centre], np.zeros(len(members), np.int64)
                while near[far := int(near.argmax())] > radius / 2:
                    d = np.sqrt(squares(own, own[far]))
                    closer = d < near
                    owner[closer], near = len(centres), np.minimum(near, d)
                    centres.append(int(members[far]))
                by = np.argsort(owner, kind="stable")
                order[start:end], near = members[by], near[by]
                bounds = np.searchsorted(owner[by], np.arange(len(centres) + 1))
                nodes[at][3:5] = len(nodes), len(centres)
                for c, lo, hi in zip(centres, bounds[:-1].tolist(), bounds[1:].tolist()):
                    nodes.append([start + lo, start + hi, c, 0, 0, 0.0])
                    away.append(near[lo:hi])
            at += 1
        table = np.array(nodes, np.float64).T
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        table[2] = place[table[2].astype(np.int64)]
        return cls(points[order], order, table)


def _children(tree: CoverTree, nodes: np.ndarray, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes with ``opened`` ones replaced by their children, and from which place each comes."""
    stay, go = np.flatnonzero(~opened), np.flatnonzero(opened)
    count = tree.count[nodes[go]]
    return np.append(nodes[stay], C.ragged(tree.first[nodes[go]], count)), np.append(stay, np.repeat(go, count))


def nearest(tree: CoverTree, centres: CoverTree) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact squared distance of the nearest centroid of every point, in the tree's order; ties: the smaller number."""
    number, best = np.full(len(tree.points), len(centres.points)), np.full(len(tree.points), np.inf)
    nodes, others, alive = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones((1, 1), bool)
    while len(nodes):
        gap = np.full(alive.shape, np.inf)
        for j, other in enumerate(others):
            rows = np.flatnonzero(alive[:, j])
            gap[rows, j] = np.sqrt(squares(tree.points[tree.centre[nodes[rows]]], centres.points[centres.centre[other]]))
        radius, wide = tree.radius[nodes], centres.radius[others]
        most = gap.min(axis=1) + radius
        alive &= gap - radius[:, None] - wide[None] <= (most * (1 + SLACK) + SLACK)[:, None]
        closed = centres.count[others] == 0
        alone = (alive.sum(axis=1) == 1) & alive[:, closed & (centres.end[others] - centres.start[others] == 1)].any(axis=1)
        done = alone | (tree.count[nodes] == 0) & ~alive[:, ~closed].any(axis=1)
        for j in np.flatnonzero(alive[done].any(axis=0)):
            rows = nodes[done & alive[:, j]]
            points = C.ragged(tree.start[rows], tree.end[rows] - tree.start[rows])
            for c in range(centres.start[others[j]], centres.end[others[j]]):
                away, own = squares(tree.points[points], centres.points[c]), centres.order[c]
                nearer = (away < best[points]) | (away == best[points]) & (own < number[points])
                best[points[nearer]], number[points[nearer]] = away[nearer], own
        nodes, alive = nodes[~done], alive[~done]
        there = alive.any(axis=0)
        others, alive, wide, closed = others[there], alive[:, there], wide[there], closed[there]
        if not len(nodes):
            break
        able = tree.count[nodes] > 0
        widest = tree.radius[nodes[able]].max(initial=-1.0)
        opened = ~closed & (wide >= widest)
        if opened.any():
            others, came = _children(centres, others, opened)
            alive = alive[:, came]
        else:
            nodes, came = _children(tree, nodes, able)
            alive = alive[came]
    return number, best


class Centroids:
    """The centroids of one round, as whole numbers of any size."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.values = np.array([[float(x) for x in r] for r in rows]).reshape(len(rows), -1)
        self.largest = float(np.abs(self.values).max(initial=0))
        self.tree = None

    def assign(self, tree: CoverTree) -> tuple[np.ndarray, list[int] | np.ndarray]:
        """Number and squared distance of every point's nearest centroid."""
        reach = 2 * max(self.largest, float(np.abs(tree.points).max(initial=0)))
        if tree.points.shape[1] * reach * reach < EXACT:
            self.tree = self.tree or CoverTree.build(self.values, FEW_CENTROIDS)
            return nearest(tree, self.tree)
        number, best = [], []
        for point in tree.points:  # beyond what doubles hold exactly
            p = [int(x) for x in point]
            away, c = min((sum((a - b) ** 2 for a, b in zip(p, r)), i) for i, r in enumerate(self.rows))
            number.append(c)
            best.append(away)
        return np.array(number, np.int64), best

    def moved(self, sums: dict[int, tuple[int, list[int]]]) -> Centroids:
        """``floor(sum / count)`` where there are vectors."""
        return Centroids([[s // sums[i][0] for s in sums[i][1]] if i in sums else row for i, row in enumerate(self.rows)])

    def digest(self, i: int) -> str:
        return hashlib.sha256(",".join(map(str, self.rows[i])).encode()).hexdigest()


def whole(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * values), -LARGEST, LARGEST)


TREES = "ids array<long>, points binary, nodes binary"
DECIMAL = pa.decimal128(38, 0)


def trees_of(kept: DataFrame, dims: int) -> DataFrame:
    """Cover trees over runs of ``BLOCK`` rows of ``(id, vec)``, all vectors of ``dims`` components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                points = whole(np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(part), dims))
                tree = CoverTree.build(points, LEAF)
                ids = part.column(0).take(pa.array(tree.order)).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([tree.points.astype("<f8").tobytes()]), pa.array([tree.nodes.astype("<f8").tobytes()])], names=["ids", "points", "nodes"])

    return kept.mapInArrow(run, TREES)


def held_trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, CoverTree]]:
    for batch in batches:
        for i in range(len(batch)):
            points = np.frombuffer(batch.column(1)[i].as_buffer(), "<f8").reshape(-1, dims)
            nodes = np.frombuffer(batch.column(2)[i].as_buffer(), "<f8").reshape(len(CoverTree.FIELDS) + 1, -1)
            yield batch.column(0)[i].values, CoverTree(points, np.arange(len(points)), nodes)


def sums(trees: DataFrame, centroids: Centroids, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Count and sums of each centroid's vectors: ``centroids x dims`` rows come back."""
    sent = trees.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(sent.value.rows)
        total, n = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for _, tree in held_trees(batches, dims):
            number, _ = sent.value.assign(tree)
            n += np.bincount(number, minlength=k)
            if np.abs(tree.points).max(initial=0) * len(tree.points) < EXACT:
                held = np.zeros((k, len(number)))
                held[number, np.arange(len(number))] = 1
                total += (held @ tree.points).astype(np.int64).astype(object)
            else:
                for c, point in zip(number, tree.points):
                    total[c] += np.array([int(x) for x in point], object)
        flat = total.ravel().tolist()
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(k, dtype=np.int32), dims)), pa.array(np.tile(np.arange(dims, dtype=np.int32), k)),
            pa.array([Decimal(x >> 64) for x in flat], DECIMAL), pa.array([Decimal(x & (1 << 64) - 1) for x in flat], DECIMAL), pa.array(np.repeat(n, dims)),
        ], names=["cluster", "dim", "high", "low", "n"])

    parts = trees.mapInArrow(run, "cluster int, dim int, high decimal(38, 0), low decimal(38, 0), n long")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cluster", "dim").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).where("n > 0").collect():
        out.setdefault(r["cluster"], (r["n"], [0] * dims))[1][r["dim"]] = (int(r["high"]) << 64) + int(r["low"])
    return out


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, salt: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector that takes part.

    The first centroids are the vectors whose ``salt:id`` has the smallest SHA-256.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "clusters")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("vec")).where((F.size("vec") == dims) & finite)
    path = f"{scratch.root}/trees"
    trees_of(kept, dims).write.option("compression", "zstd").option("maxRecordsPerFile", TREES_A_FILE).parquet(path)
    trees = spark.read.schema(TREES).parquet(path)
    first = kept.where("id is not null").select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256).alias("hash"), "vec").orderBy("hash", "vec").limit(k).collect()
    schema = "vec_id long, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = Centroids([[int(x) for x in whole(np.array(r["vec"], np.float64))] for r in first])
    for _ in range(rounds):
        centroids = centroids.moved(sums(trees, centroids, dims))
    sent = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in held_trees(batches, dims):
            number, away = sent.value.assign(tree)
            away = away.astype(np.int64) if isinstance(away, np.ndarray) else np.array([min(x, LONG) for x in away], np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(away)], names=["vec_id", "cluster", "distance"])

    assigned = scratch.table(trees.mapInArrow(run, schema))
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("s")).collect()}
    whole_inertia = min(LONG, sum(inertia.values()))
    about = [(i, min(LONG, s), whole_inertia, centroids.digest(i)) for i, s in inertia.items()]
    known = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    """The clusters of all embeddings."""
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _sql() -> str:
    near = """a{i} AS (SELECT row, vec_id, e, c, d FROM (SELECT v.*, m.c, list_sum(list_transform(list_zip(v.e, m.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v CROSS JOIN m{i} m)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)"""
    move = """m{j} AS (SELECT m.c, coalesce(n.e, m.e) AS e FROM m{i} m LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM
  (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, unnest(range(1, {dims} + 1)) AS i FROM a{i}) GROUP BY c, i) GROUP BY c) n ON m.c = n.c)"""
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1 AS c, e FROM v WHERE vec_id IS NOT NULL QUALIFY c < {CENTROIDS})"]
    for i in range(ROUNDS + 1):
        parts.append(near.format(i=i).replace(" AS (SELECT row,", " AS MATERIALIZED (SELECT row,"))
        if i < ROUNDS:
            parts.append(move.format(i=i, j=i + 1, dims=DIMS).replace(" AS (SELECT m.c", " AS MATERIALIZED (SELECT m.c"))
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.e, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN m{ROUNDS} m ON a.c = m.c"""


OP13_SQL = _sql()
