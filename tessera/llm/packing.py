"""Operator 2, best-fit packing with certified bounds.

Documents become token ids with an end id; only longer ones are cut into pieces of the capacity, the
remainder first. Pieces are dealt to partitions of bounded size, and each is packed by best-fit
decreasing. Dual-feasible functions of the lengths give a lower bound on each partition's bins: where
it equals the bins made, the partition is certified. Partitions with a gap, and every partition's
loosest bins, put the documents of their unfilled bins into an exchange, are dealt anew and packed
again; a round's result stands only where it saves bins. Rounds end when the exchanged bins are as few as their
volume allows, when nothing is saved, or after ``rounds``.

Only ids' digests and lengths are shuffled, not texts or ids; :func:`sequences` joins the ids on.

Defined cases: a null or empty text is the end id alone; null ids and repeated rows are pieces of
their own; between pieces of equal length and bins of equal gap either may come first, as sequences have any numbers; a long text is cut into as many
pieces as it needs; an empty table gives an empty table; further columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import columns as C
from tessera.llm import tokenizing
from tessera.session import Scratch

CAPACITY = 1024
END_ID = 2
#: Pieces of a partition; a bound on the memory and time of one packing task at any size of input.
PARTITION = 8192
ROUNDS = 3
ENCODE_BYTES = 16 << 20

PIECES = "piece int, start long, length long, ids binary"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, rank_file: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: every document's pieces; ids are little-endian unsigned 32-bit."""
    rank_file = rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizing.byte_bpe(rank_file)
        for batch in batches:
            at = 0
            for texts in C.steps(C.filled(batch.column(1)), ENCODE_BYTES):
                yield cut(batch.column(0).slice(at, len(texts)), *encoder.encode(texts), capacity, end_id)
                at += len(texts)

    return rows.mapInArrow(run, f"{rows.select('doc_id').schema.simpleString()[7:-1].replace(':', ' ')}, {PIECES}")


def cut(doc_ids: pa.Array, ids: np.ndarray, starts: np.ndarray, capacity: int, end_id: int) -> pa.RecordBatch:
    """Append the end id to each document and cut it, remainder first."""
    n = len(doc_ids)
    sizes = np.diff(starts) + 1
    flat = np.empty(len(ids) + n, "<u4")
    ends = np.cumsum(sizes)
    body = np.ones(len(flat), bool)
    body[ends - 1] = False
    flat[body], flat[~body] = ids, end_id
    count = -(-sizes // capacity)
    doc = np.repeat(np.arange(n), count)
    piece = C.ragged(np.zeros(n, np.int64), count)
    first = sizes - (count - 1) * capacity
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
    length = np.where(piece == 0, first[doc], capacity)
    # Pieces lie on end in the flat ids, in order.
    offsets = pa.py_buffer(np.append(0, np.cumsum(length * 4)).astype(np.int32))
    held = pa.Array.from_buffers(pa.binary(), len(doc), [None, offsets, pa.py_buffer(flat)])
    columns = [doc_ids.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), held]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each item by best-fit decreasing; ties go to the bin opened last at that room."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    full = int(np.count_nonzero(lengths[order] >= capacity))
    bins[order[:full]] = np.arange(full)
    made, rooms, open_mask = full, [[] for _ in range(capacity + 1)], 0
    for i in order[full:].tolist():
        size = int(lengths[i])
        fitting = open_mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_mask ^= 1 << room
        else:
            room, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            rooms[left].append(b)
            open_mask |= 1 << left
    return bins, offsets


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Bins that items of these lengths (``histogram[length]`` of each) need at least, by dual-feasible functions."""
    held = np.flatnonzero(histogram[: capacity + 1])
    held = held[held > 0]
    if not len(held):
        return 0
    n = histogram[held].astype(object)
    best = -(-sum(int(x) for x in n * held) // capacity)
    # U(e): items over capacity - e count whole, those under e not at all.
    for e in np.unique(np.append(held, capacity - held + 1)).tolist():
        if 0 < e <= capacity // 2:
            value = np.where(held > capacity - e, capacity, np.where(held >= e, held, 0))
            best = max(best, -(-sum(int(a) * int(b) for a, b in zip(value, n)) // capacity))
    # u(k): (k + 1) x / capacity if whole, else its floor over k; all in units of 1 / (k (k + 1)).
    for k in range(1, 33):
        scaled = held * (k + 1)
        value = np.where(scaled % capacity == 0, held * k * (k + 1), (scaled // capacity) * capacity * (k + 1))
        best = max(best, -(-sum(int(a) * int(b) for a, b in zip(value, n)) // (capacity * k * (k + 1))))
    return best


PLACED = "bin long, offset long, bins long, bound long, room long"


def packed(items: DataFrame, capacity: int) -> DataFrame:
    """Pack each group of ``items(grp, length, ...)``; adds the bin, the place in it, its room, and the group's bins and bound."""

    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy().astype(np.int64)
        bins, offsets = best_fit(lengths, capacity)
        n = int(bins.max()) + 1 if len(bins) else 0
        room = capacity - np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        for name, values in (("bin", bins), ("offset", offsets), ("bins", np.full(len(bins), n)), ("bound", np.full(len(bins), bound)), ("room", room[bins])):
            group = group.append_column(name, pa.array(values, pa.int64()))
        return group

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return items.groupBy("grp").applyInArrow(run, f"{schema}, {PLACED}")


def pack(items: DataFrame, capacity: int = CAPACITY, partition: int = PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """``items`` (with a ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset`` added."""
    scratch = Scratch(items.sparkSession, "packing")
    kept = items.columns
    own = [F.col(c).alias(f"_{i}") for i, c in enumerate(kept)]  # names of its own, whatever they are
    rows = scratch.table(items.select(*own, F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("item")))
    total = rows.count()
    done: list[DataFrame] = []

    def deal(df: DataFrame, n: int, salt: int) -> DataFrame:
        groups = max(1, -(-n // partition))
        return df.withColumn("grp", F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(groups)))

    names = [f"_{i}" for i in range(len(kept))]
    # A sequence is named by its round, partition and bin; a round's partitions number far under 2**36.
    named = lambda df, r: df.withColumn("sequence_id", F.lit(r) * F.lit(1 << 56) + F.col("grp") * F.lit(1 << 20) + F.col("bin"))
    state = scratch.table(named(packed(deal(rows, total, 0).select(*names, "item", "length", "grp"), capacity), 0))
    shape = [*names, "item", "length", "grp", "offset", "sequence_id"]
    for r in range(1, rounds + 1):
        groups = state.groupBy("grp").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"), F.max("room").alias("loosest"))
        made = groups.agg(F.sum("bins"), F.count_if(F.col("bins") > F.col("bound")), F.count("*")).first()
        if not total or (made[2] == 1 and not made[1]):
            break
        # Into the exchange: unfilled bins of partitions with a gap, and each partition's loosest bins.
        limits = groups.select("grp", F.when(F.col("bins") > F.col("bound"), F.lit(1)).otherwise(F.greatest(F.col("loosest"), F.lit(1))).alias("least"))
        # One row a partition of thousands of pieces: the join is left to the planner's size checks.
        marked = scratch.table(state.join(limits, "grp").withColumn("given", F.col("room") >= F.col("least")))
        given = marked.where("given")
        n, w, bins = given.agg(F.count("*"), F.sum("length"), F.count_distinct("sequence_id")).first()
        if not n or bins <= -(-w // capacity):
            break
        again = scratch.table(named(packed(deal(given.select(*names, "item", "length"), n, r), capacity), r))
        if again.select("sequence_id").distinct().count() >= bins:
            break
        done.append(marked.where("not given").select(*shape))
        state = again
    done.append(state.select(*shape))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(kept)], "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the packed token sequences, from placed pieces that carry their ``ids``."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its digest and its place."""
    found = pieces(docs, id_col, text_col, capacity)
    digests = found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digests, capacity)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
