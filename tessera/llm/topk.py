"""Operator 9, exact top-k search by no-random-access aggregation.

Queries and candidates meet in cells of bounded size; a cell's candidates are held as lists, one a dimension, in blocks.
A query reads each list of a block in order, step by step: from the top where its own component is positive, from the bottom
where it is negative, and not at all where it is zero. What has been read adds to a candidate's score; what hasn't
lies between the last value read in its list and the list's far end, and all of it together is no more than what
the candidate's length leaves (Cauchy-Schwarz). So every candidate has a lower and an upper bound. Reading stops as
soon as few candidates have an upper bound that reaches the k-th best lower bound, or the k-th best score of
the blocks before, as no outsider can qualify then; the scores of those left are resolved by reading the rest of their
entries. At the latest all is read, so nothing is approximate.

Queries of a cell read a block's lists together, so that each step's entries are taken up once for many queries; each
query keeps its own bounds and stops for itself.

A candidate is copied once for each cell of queries (65,536 of them, fewer where vectors are long: cells and blocks are bounded in bytes), and each cell
sends its k best a query on.

Defined cases: rows whose vector is null or holds a null, NaN or infinity take no part, nor do rows
without an id; rows with a query's own id are not among its candidates; repeated rows are candidates
(and queries) of their own; ties go to the smaller id; vectors of another dimension than a query's are not compared with
it, however long; an empty vector scores 0; an empty table gives an empty table; scores past 64 bits are held at the limit;
further columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType
from pyspark.sql.window import Window

from tessera.session import Scratch

K = 5
SCALE = 256.0
EVERY = 50
QUERY_CELL = 1 << 16  # queries of a cell, at most
CANDIDATE_CELL = 1 << 16  # candidates of a cell, at most
CELL_BYTES = 32 << 20  # of a cell's queries, and of its candidates, at most (65,536 vectors of 64 components)
BLOCK = 4096  # candidates of a cell whose lists are held at once, at most
BLOCK_BYTES = 8 << 20  # of a block's vectors; with lists, orders and sums a block takes about twelve times as much
#: Shares of the lists at which bounds are looked at. In many dimensions they rarely decide before half is read, and each look costs as
#: much as a step, so the early ones are few.
LOOKS = (0.25, *(0.5 + 0.0625 * i for i in range(9)))
#: A query with so many candidates left, besides the k, is resolved.
FEW = 64
#: Queries that read a block's lists together.
TOGETHER = 128
#: Whole numbers below these are exact as doubles and as single floats, with room for a sum.
WHOLE, WHOLE_SINGLE = 2.0**52, 2.0**22


def quantised(embedding: Column | str, scale: float = SCALE) -> Column:
    """``floor(scale * x)`` of every component as little-endian doubles; null for vectors that take no part."""

    @F.arrow_udf(BinaryType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lists = batch if batch.null_count == 0 else pc.fill_null(batch, pa.scalar([], batch.type))
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.flatten()
            values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)  # nulls become NaN
            bad = np.append(0, np.cumsum(~np.isfinite(values)))
            offsets -= offsets[0]
            wrong = (bad[offsets[1:]] > bad[offsets[:-1]]) | batch.is_null().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(scale * values).astype("<f8")
            held = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((8 * offsets).astype(np.int32)), pa.py_buffer(np.append(whole, 0.0))])
            yield pc.if_else(pa.array(wrong), pa.scalar(None, pa.binary()), held)

    return run(embedding)


def ranked(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score first, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Lists:
    """A block's candidates as one sorted list a dimension; all values whole numbers."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids = rows, ids
        n, dims = rows.shape
        order = np.argsort(-rows, axis=0, kind="stable")
        values = np.take_along_axis(rows, order, 0)
        # From the top and from the bottom, each dimension's list in one piece.
        self.order = np.ascontiguousarray(order.T), np.ascontiguousarray(order[::-1].T)
        self.values = np.ascontiguousarray(values.T), np.ascontiguousarray(values[::-1].T)
        self.squares = np.einsum("ij,ij->i", rows, rows)
        self.largest = float(np.abs(rows).max(initial=0))

    def search(self, query: np.ndarray, own: int, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, float]:
        """Ids and scores of the k best but ``own`` (of scores under ``floor`` any may lack), and the share of the entries that was read."""
        return self.search_all(query[None], np.array([own]), k, np.array([floor]))[0]

    def search_all(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """:meth:`search` for several queries, which read the lists together; each leaves as soon as its bounds allow."""
        n, dims = self.rows.shape
        out: list = [None] * len(queries)
        reach = np.abs(queries).max(axis=1, initial=0) * self.largest * max(1, dims)
        going = []
        for i, query in enumerate(queries):
            if not reach[i] < WHOLE:  # beyond what doubles hold exactly
                out[i] = *self.exact(query, self.ids != own[i], k), 1.0
            elif n <= FEW + k or not query.any():
                out[i] = *self.resolved(query, np.flatnonzero(self.ids != own[i]), k), 1.0
            else:
                going.append(i)
        going = np.array(going, np.int64)
        # Each dimension has two lists, from the top and from the bottom; a query weighs one of them, or none.
        top = max(self.largest, float(np.abs(queries).max(initial=0)))
        squared = top * top * max(1, dims)
        by_length, kind = squared < WHOLE, np.float32 if squared < WHOLE_SINGLE else np.float64
        weight = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)[going].astype(kind)
        far = np.concatenate([values[:, -1] for values in self.values]).astype(kind) if n else np.zeros(2 * dims, kind)
        score, squares, beyond, rest = (np.zeros((len(going), n), kind) for _ in range(4))
        seen = np.zeros((2 * dims, n), kind)
        lengths = self.squares.astype(kind)
        read = 0
        for to in [int(n * share) for share in LOOKS]:
            if to <= read:
                continue
            if not len(going) or to >= n:
                break
            got, fresh = np.zeros((2, 2 * dims, n), kind)
            last = np.zeros(2 * dims, kind)
            for side, (order, values) in enumerate(zip(self.order, self.values)):
                lists = np.arange(side * dims, (side + 1) * dims)[:, None]
                got[lists, order[:, read:to]] = values[:, read:to]
                fresh[lists, order[:, read:to]] = 1
                last[lists[:, 0]] = values[:, to - 1]
            seen += fresh
            score += weight @ got
            squares += (weight != 0).astype(kind) @ (got * got)
            beyond += (weight * far) @ fresh
            rest += (weight * weight) @ fresh
            high = (weight @ last)[:, None] - (weight * last) @ seen
            low = (weight @ far)[:, None] - beyond
            if by_length:
                left = np.maximum((weight * weight).sum(axis=1)[:, None] - rest, 0) * np.maximum(lengths - squares, 0)
                most = np.sqrt(left) * kind(1 + 1e-6) + kind(1)  # with room for the rounding of product and root
                high, low = np.minimum(high, most), np.maximum(low, -most)
            others = self.ids[None] != own[going][:, None]
            lower = np.where(others, score + low, -np.inf)
            kth = np.maximum(floors[going], np.partition(lower, n - k, axis=1)[:, n - k])
            able = (score + high >= kth[:, None]) & others
            few = able.sum(axis=1) <= FEW + k
            for at in np.flatnonzero(few):
                out[going[at]] = *self.resolved(queries[going[at]], np.flatnonzero(able[at]), k), to / n
            going, weight, score, squares, beyond, rest = (x[~few] for x in (going, weight, score, squares, beyond, rest))
            read = to
        for i in going:
            out[i] = *self.resolved(queries[i], np.flatnonzero(self.ids != own[i]), k), 1.0
        return out

    def resolved(self, query: np.ndarray, able: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Final scores of those that can still qualify, and the k best."""
        scores = self.rows[able] @ query
        best = ranked(scores, self.ids[able], k)
        return self.ids[able][best], scores[best].astype(np.int64)

    def exact(self, query: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best in whole numbers of any size."""
        whole = [int(x) for x in query]
        scores = np.array([min(max(sum(a * int(b) for a, b in zip(whole, r)), -(2**63)), 2**63 - 1) for r in self.rows], np.int64)
        other = np.flatnonzero(others)
        best = other[np.lexsort((self.ids[other], [-int(x) for x in scores[other]]))[:k]]
        return self.ids[best], scores[best]


def vectors_in(size: int, most: int, dims: int) -> int:
    """How many vectors of ``dims`` components ``size`` bytes hold, one at least and ``most`` at most."""
    return max(1, min(most, size // (8 * max(1, dims))))


def search_cell(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(ids, scores)`` of the k best of a cell's candidates for each query."""
    none = np.zeros(0, np.int64)
    best = [(none, none)] * len(queries)
    block = vectors_in(BLOCK_BYTES, block, rows.shape[1])
    for at in range(0, len(rows), block):
        lists = Lists(rows[at : at + block], ids[at : at + block])
        for first in range(0, len(queries), TOGETHER):
            asked = slice(first, first + TOGETHER)
            floors = np.array([float(scores[-1]) if len(scores) == k else -np.inf for _, scores in best[asked]])
            for i, (found, more, _) in enumerate(lists.search_all(queries[asked], query_ids[asked], k, floors), first):
                held, scores = np.append(best[i][0], found), np.append(best[i][1], more)
                order = np.lexsort((held, [-int(x) for x in scores]))[:k]
                best[i] = held[order], scores[order]
    return best


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best by whole-number inner product."""
    scratch = Scratch(vectors.sparkSession, "top-k")
    rows = vectors.select(vectors[id_col].alias("id"), quantised(vectors[vector_col]).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.table(rows.where("vec is not null and id is not null"))
    spread = lambda salt, size: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(size)).cast("int")
    # Cells as large as memory allows, as each candidate goes to every query cell; but enough of them for all tasks.
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = lambda most: F.greatest(F.lit(1), F.least(F.lit(most), F.floor(CELL_BYTES / F.greatest(F.lit(1), F.col("dim")))))
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
    sizes = rows.groupBy(F.octet_length("vec").alias("dim")).agg(F.count("*").alias("n"), F.count_if("asks").alias("n_queries"))
    blocks = scratch.table(sizes.select("dim", parts("n_queries", held(QUERY_CELL)).alias("q_blocks"), F.greatest(parts("n", held(CANDIDATE_CELL)), F.least(parts("n", F.lit(BLOCK)), F.lit(tasks))).alias("c_blocks")))
    rows = rows.withColumn("dim", F.octet_length("vec")).join(blocks, "dim")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    queries = rows.where("asks").select("id", "row", "vec", "dim", spread(1, "q_blocks").alias("qb"), every("c_blocks").alias("cb"))
    candidates = rows.select(*[F.col(c).alias(c) for c in ("id", "vec", "dim")], spread(2, "c_blocks").alias("cb"), every("q_blocks").alias("qb"))

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = {"row": [], "query_id": [], "vec_id": [], "score": []}
        if len(asked) and len(held):
            matrix = lambda f: np.frombuffer(b"".join(f["vec"]), "<f8").reshape(len(f), -1)
            ids, own, asking = held["id"].to_numpy(np.int64), asked["id"].to_numpy(np.int64), asked["row"].to_numpy(np.int64)
            for i, (best, scores) in enumerate(search_cell(matrix(asked), own, matrix(held), ids, k)):
                out["row"] += [asking[i]] * len(best)
                out["query_id"] += [own[i]] * len(best)
                out["vec_id"] += best.tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out)

    keys = ["dim", "qb", "cb"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(run, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark, sf_dir: str) -> DataFrame:
    """The five best of every vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % EVERY == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
