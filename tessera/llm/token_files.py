"""Operator 7, token-id files as directly addressable codes.

Documents are put in ascending id order by a range shuffle, encoded, and written as segments of whole
documents. A segment's payload is this binary format, all numbers little-endian::

    "TDAC" | u8 version | u8 levels | u16 0 | u32 documents | u64 values | u64 first value of each document (and the end)
    then for each level, on 8-byte boundaries:
    u64 codes | codes, one byte each | continuation bitmap | rank directory: u32 ones before each block of 512 bits

An id is split into chunks of 8 bits, the lowest on level 0. A set continuation bit says that the id goes on
at the next level, at the place that the bit's rank names, so any id is read by one step a level with
the rank directory, and no block is decoded. Segments are rows of a Parquet table, so that any store
that Spark writes to can hold them; payloads are stored plain, neither compressed nor coded again. The table's other
columns say which documents a segment holds and between which ids they lie, so that a reader only opens the segments
that it needs.

Defined cases: a null or empty text is the end id alone; rows without an id come first; rows with equal
ids are in the order of their text's hash (repeated rows tie, and are the same); a long text is a segment of its own; an
empty table gives files without segments; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import columns as C
from tessera.llm import tokenizing
from tessera.session import Scratch

END_ID = 1
FILE = "word_bpe_49k.json"
SEGMENT_VALUES = 1 << 20
ENCODE_BYTES = 16 << 20
#: Segments whose places are sent to all tasks (24 bytes each); beyond, they are joined by a shuffle.
SENT_SEGMENTS = 1 << 18
BLOCK = 512  # bits of a rank directory's block
HEAD = struct.Struct("<4sBBHIQ")


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def pack(values: np.ndarray, starts: np.ndarray) -> bytes:
    """One segment of ``values``; ``starts`` are the documents' first values and the end."""
    levels, left = [], values.astype(np.uint32)
    while True:
        more = left > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.append(bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8))
        ones = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        codes = (left & 0xFF).astype(np.uint8)
        levels.append(_padded(struct.pack("<Q", len(codes)) + codes.tobytes()) + bits.tobytes() + _padded(ranks.tobytes()))
        if not more.any():
            break
        left = left[more] >> 8
    head = HEAD.pack(b"TDAC", 1, len(levels), 0, len(starts) - 1, len(values)) + starts.astype("<u8").tobytes()
    return _padded(head) + b"".join(levels)


class Segment:
    """A segment's ids, read in place."""

    def __init__(self, payload: bytes):
        magic, version, n_levels, _, n_docs, self.n = HEAD.unpack_from(payload)
        if magic != b"TDAC" or version != 1:
            raise ValueError("not a token segment")
        self.starts = np.frombuffer(payload, "<u8", n_docs + 1, HEAD.size).astype(np.int64)
        at = HEAD.size + 8 * (n_docs + 1)
        at += -at % 8
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            codes = np.frombuffer(payload, np.uint8, n, at + 8)
            at += 8 + n
            at += -at % 8
            blocks = -(-n // BLOCK)
            bits = np.frombuffer(payload, np.uint8, blocks * BLOCK // 8, at)
            at += len(bits)
            ranks = np.frombuffer(payload, "<u4", blocks, at)
            at += 4 * blocks
            at += -at % 8
            self.levels.append((codes, bits, ranks))

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, each by one step a level."""
        places = np.asarray(places, np.int64)
        if len(places) and (places.min() < 0 or places.max() >= self.n):
            raise IndexError("no such token")
        out = np.zeros(len(places), np.uint32)
        going = np.arange(len(places))
        for depth, (codes, bits, ranks) in enumerate(self.levels):
            out[going] |= codes[places].astype(np.uint32) << np.uint32(8 * depth)
            on = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            going, places = going[on], places[on]
            # Ones before a place: its block's directory entry and the bits of the block before it.
            block = places // BLOCK
            held = bits.reshape(-1, BLOCK // 8)[block]
            byte = (places % BLOCK) >> 3
            before = np.arange(BLOCK // 8)[None, :] < byte[:, None]
            inside = np.bitwise_count(np.where(before, held, 0)).sum(axis=1, dtype=np.int64)
            last = np.bitwise_count(bits[places >> 3] & ((1 << (places & 7)) - 1).astype(np.uint8))
            places = ranks[block].astype(np.int64) + inside + last
        return out

    def all(self) -> np.ndarray:
        """All ids in order."""
        out = np.zeros(0, np.uint32)
        for codes, bits, _ in reversed(self.levels):
            values = codes.astype(np.uint32)
            on = np.unpackbits(bits, count=len(codes), bitorder="little").astype(bool)
            values[on] |= out << np.uint32(8)
            out = values
        return out


def write_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file: str | None = None) -> None:
    """Encode all texts and write their ids at ``path``, in ascending order of id."""
    file = file or public_tokenizers.path(FILE)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("tie"))
    # Equal ids are dealt by their texts' hashes, so that no id needs a task of its own.
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seg = tokenizing.word_bpe(file), TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for texts in C.steps(C.filled(batch.column(1)), ENCODE_BYTES):
                ids, starts = encoder.encode(texts)
                n = len(texts)
                starts = starts + np.arange(n + 1)
                flat = np.empty(starts[-1], np.uint32)
                body = np.ones(len(flat), bool)
                body[starts[1:] - 1] = False
                flat[body], flat[~body] = ids, end_id
                first = 0
                while first < n:
                    to = max(first + 1, int(np.searchsorted(starts, starts[first] + SEGMENT_VALUES, side="right")) - 1)
                    payload = pack(flat[starts[first] : starts[to]], starts[first : to + 1] - starts[first])
                    held = pa.ListArray.from_arrays(pa.array([0, to - first], pa.int32()), batch.column(0).slice(at + first, to - first))
                    ends = pc.min_max(held.values)
                    values = [pa.array([part], pa.int64()), pa.array([seg], pa.int64()), pa.array([int(starts[to] - starts[first])], pa.int64())]
                    values += [pa.array([ends[k].as_py()], held.values.type) for k in ("min", "max")] + [held, pa.array([payload], pa.binary())]
                    yield pa.RecordBatch.from_arrays(values, names=["part", "seg", "n_values", "first_id", "last_id", "doc_ids", "payload"])
                    first, seg = to, seg + 1
                at += n

    schema = f"part long, seg long, n_values long, first_id {id_type}, last_id {id_type}, doc_ids array<{id_type}>, payload binary"
    found = ordered.select("doc_id", "text").mapInArrow(run, schema)
    found.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments at ``path`` with ``base``, the number of ids before each."""
    files = spark.read.parquet(path)
    # One row a written partition: its total, and all before it. Only these counts meet in one task.
    totals = files.groupBy("part").agg(F.sum("n_values").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    seg = files.select("part", "seg", F.coalesce(F.sum("n_values").over(inside), F.lit(0)).alias("seg_base"))
    bases = Scratch(spark, "bases").table(seg.join(parts, "part").select("part", "seg", (F.col("part_base") + F.col("seg_base")).alias("base")))
    # A few bytes for each segment of a million ids; sent to all tasks up to a bound, so that payloads need no shuffle.
    return files.join(F.broadcast(bases) if bases.count() <= SENT_SEGMENTS else bases, ["part", "seg"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document, read back from ``path``; ids little-endian, 32 bits."""
    found = segments(spark, path).select("doc_ids", "base", "payload")
    id_type = found.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                s = Segment(batch.column(2)[i].as_py())
                offsets = pa.py_buffer((4 * s.starts).astype(np.int32))
                ids = pa.Array.from_buffers(pa.binary(), len(s.starts) - 1, [None, offsets, pa.py_buffer(s.all().astype("<u4"))])
                starts = s.starts[:-1] + batch.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(starts), pa.array(np.diff(s.starts)), ids], names=["doc_id", "start", "n_tokens", "ids"])

    return found.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids binary")


def opened(spark: SparkSession, path: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which segment holds each of ``wanted(doc_id, place)`` (with its ``nth`` document), and the payloads of these segments only."""
    low, high = wanted.agg(F.min("doc_id"), F.max("doc_id")).first()
    # The scan skips what lies outside; payloads are read after that, of segments that are named.
    files = spark.read.parquet(path).where((F.col("last_id") >= F.lit(low)) & (F.col("first_id") <= F.lit(high)))
    held = files.select(F.col("part").alias("of_part"), F.col("seg").alias("of_seg"), F.posexplode("doc_ids").alias("nth", "doc_id")).join(wanted.select("doc_id", "place"), "doc_id")
    held = Scratch(spark, "asked").table(held)
    named = held.select(F.col("of_part").alias("part"), F.col("of_seg").alias("seg")).distinct()
    named = F.broadcast(named) if named.count() <= SENT_SEGMENTS else named
    return held, files.select("part", "seg", "payload").join(named, ["part", "seg"], "left_semi")


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``(doc_id, place, token)`` for ``wanted(doc_id, place)``, by random access; places outside a document are left out."""
    held, payloads = opened(spark, path, wanted)

    def run(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(found):
            return pd.DataFrame({"doc_id": [], "place": [], "token": []})
        s = Segment(bytes(found["payload"].iloc[0]))
        nth, place = asked["nth"].to_numpy(), asked["place"].to_numpy()
        inside = (place >= 0) & (place < s.starts[nth + 1] - s.starts[nth])
        out = asked.loc[inside, ["doc_id", "place"]].copy()
        out["token"] = s.at(s.starts[nth[inside]] + place[inside]).astype(np.int64)
        return out

    both = held.groupBy("of_part", "of_seg").cogroup(payloads.groupBy("part", "seg"))
    return both.applyInPandas(run, f"doc_id {held.schema['doc_id'].dataType.simpleString()}, place long, token long")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document's place, size and digest in the files written from all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{Scratch(spark, 'token-files').root}/ids"
    write_files(docs, path)
    return read_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
