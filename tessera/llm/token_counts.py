"""Operator 3, token counts, with overlap resynchronisation for huge texts.

Texts up to ``long_bytes`` are counted whole. A longer one is cut into overlapping chunks that other tasks encode with
the library, which gives each token's offsets. A chunk tells the boundaries in its overlaps: token starts
right after white space, with the number of tokens before each and a digest of the ids and offsets of the ``RUN`` tokens
that follow. Neighbours are spliced at the first boundary that both name with the same digest. Such a boundary is
stable: no token, special string or normal form of this vocabulary's files crosses white space, so what either chunk
counts on its own side of it is what the whole text has there; the digest shows that both see the same text behind it.
Where two neighbours share no such boundary (a word longer than the overlap), the text is cut again with chunks and
overlaps four times as long, until all align; at the latest a chunk holds the whole text.

Defined cases: a null or empty text has no bytes and tokens; null ids and repeated rows each give their own
row (the chunks of equal huge texts are encoded once); no result depends on which of equal boundaries is taken; an
empty table gives an empty table; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tokenizers import Tokenizer

from tessera.llm import columns as C
from tessera.llm import tokenizing
from tessera.session import Scratch

LIMIT = 2048
LONG_BYTES = 1 << 15
CHUNK = 1 << 14  # characters
OVERLAP = 1 << 8
WIDEN = 4
FILE = "word_bpe_49k.json"
RUN = 4  # tokens behind a boundary that must agree
#: Characters of chunks that a task encodes, so that tasks grow in number and not in size.
TASK_CHARS = 1 << 20
ENCODE_BYTES = 16 << 20

CUTS = "key string, idx long, start long, size long, overlap long, ended boolean, chunk string"
PLACES = "array<struct<pos:long,digest:long,before:long>>"
TOLD = f"key string, idx long, ended boolean, n long, head {PLACES}, tail {PLACES}"


def count_whole(text: Column | str, file: str | None = None) -> Column:
    """Tokens of a text column, each text encoded whole."""
    file = file or public_tokenizers.path(FILE)

    @F.arrow_udf(LongType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = tokenizing.word_bpe(file)
        for batch in batches:
            counts = [np.diff(encoder.encode(texts)[1]) for texts in C.steps(C.filled(batch), ENCODE_BYTES)]
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))

    return run(text)


def chunks(texts: DataFrame, size: int, overlap: int, tasks: int) -> DataFrame:
    """Overlapping chunks of the different texts of ``texts(key, text)``; those of one text go to different tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key in seen:
                    continue
                seen.add(key)
                text = text.as_py()
                n = max(1, -(-max(0, len(text) - overlap) // size))
                for at in range(0, n, 64):
                    idx = range(at, min(n, at + 64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key] * len(idx)), pa.array(idx, pa.int64()), pa.array([i * size for i in idx], pa.int64()), pa.array([size] * len(idx), pa.int64()),
                            pa.array([overlap] * len(idx), pa.int64()), pa.array([i == n - 1 for i in idx]), pa.array([text[i * size : (i + 1) * size + overlap] if i < n - 1 else text[i * size :] for i in idx], pa.string()),
                        ],
                        names=["key", "idx", "start", "size", "overlap", "ended", "chunk"],
                    )

    # A number of tasks by the chunks' size: adaptive execution would merge small ones that Python works on for long.
    return texts.select("key", "text").mapInArrow(cut, CUTS).repartition(tasks, "key", "idx").dropDuplicates(["key", "idx"])


@functools.cache
def library(file: str) -> Tokenizer:
    """The library's tokenizer, one a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work
    return Tokenizer.from_file(file)


def is_space(c: str) -> bool:
    """White space by every library's reckoning."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


def boundaries(chunk: str, ids: np.ndarray, offsets: np.ndarray, low: int, high: int) -> list[dict]:
    """Boundaries at ``low <= place < high`` of a chunk: their place, digest, and the tokens before them."""
    out = []
    starts = offsets[:, 0]
    for i in range(int(np.searchsorted(starts, max(low, 1))), len(ids) - RUN + 1):
        at = int(starts[i])
        if at >= high:
            break
        if is_space(chunk[at - 1]) and starts[i - 1] < at if i else is_space(chunk[at - 1]):
            run = np.column_stack([ids[i : i + RUN], offsets[i : i + RUN] - at]).astype("<i8")
            out.append({"pos": at, "digest": zlib.crc32(run.tobytes()), "before": i})
    return out


def encode_chunks(cuts: DataFrame, file: str | None = None) -> DataFrame:
    """What each chunk tells of its tokens and of the places in its overlaps."""
    file = file or public_tokenizers.path(FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library(file).encode
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found = encode(r["chunk"], add_special_tokens=False)
                ids, offsets = np.array(found.ids, np.int64), np.array(found.offsets, np.int64).reshape(-1, 2)
                told = lambda low, high: [x | {"pos": x["pos"] + r["start"]} for x in boundaries(r["chunk"], ids, offsets, low, high)]  # noqa: B023, E731
                head = told(0, r["overlap"]) if r["idx"] else []
                tail = [] if r["ended"] else told(r["size"], len(r["chunk"]))
                rows.append({"key": r["key"], "idx": r["idx"], "ended": r["ended"], "n": len(ids), "head": head, "tail": tail})
            place = pa.list_(pa.struct([("pos", pa.int64()), ("digest", pa.int64()), ("before", pa.int64())]))
            schema = pa.schema([("key", pa.string()), ("idx", pa.int64()), ("ended", pa.bool_()), ("n", pa.int64()), ("head", place), ("tail", place)])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return cuts.mapInArrow(run, TOLD)


def splice(told: DataFrame) -> DataFrame:
    """``(key, n_tokens, aligned)`` of each text, from its chunks' places."""
    bare = lambda c: F.transform(c, lambda x: F.struct(x["pos"].alias("pos"), x["digest"].alias("digest")))
    ahead = told.select("key", (F.col("idx") - 1).alias("idx"), F.col("head").alias("next_head"))
    met = told.join(ahead, ["key", "idx"], "left")
    met = met.withColumn("common", F.get(F.array_intersect(bare("tail"), bare("next_head")), F.lit(0)))
    before = lambda c: F.get(F.filter(c, lambda x: x["pos"] == F.col("common.pos")), F.lit(0))["before"]
    # A chunk counts its tokens before the splice with the next one, less those before the splice with the last.
    until = F.when(F.col("ended"), F.col("n")).otherwise(before("tail"))
    over = F.when(F.col("ended"), F.lit(0)).otherwise(before("next_head"))
    tokens = met.select("key", (until - over).alias("own"))
    return tokens.groupBy("key").agg(F.sum("own").alias("n_tokens"), F.every(F.col("own").isNotNull()).alias("aligned"))


def count_long(texts: DataFrame, sizes: DataFrame, scratch: Scratch, size: int = CHUNK, overlap: int = OVERLAP, file: str | None = None) -> DataFrame:
    """``(key, n_tokens)`` of every distinct key of ``texts(key, text)``, whose characters ``sizes(key, n_chars)`` counts."""
    done = []
    while True:
        tasks = max(1, -(-(sizes.agg(F.sum("n_chars")).first()[0] or 0) // TASK_CHARS))
        # Written down, as the splice reads what chunks tell twice.
        told = scratch.table(encode_chunks(chunks(texts, size, overlap, tasks), file))
        counts = scratch.table(splice(told))
        done.append(counts.where("aligned").select("key", "n_tokens"))
        failed = counts.where("not aligned").select("key")
        if failed.isEmpty():
            break
        texts, sizes = texts.join(failed, "key", "left_semi"), scratch.table(sizes.join(failed, "key", "left_semi"))
        size, overlap = size * WIDEN, overlap * WIDEN
    out = done[0]
    for df in done[1:]:
        out = out.union(df)
    return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_bytes: int = LONG_BYTES, size: int = CHUNK, overlap: int = OVERLAP, file: str | None = None) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` for every row."""
    if not 0 < overlap < size:
        raise ValueError("the overlap must be shorter than a chunk")
    scratch = Scratch(docs.sparkSession, "token-counts")
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = rows.where(F.col("n_bytes") <= long_bytes).select("id", "n_bytes", count_whole("text", file).alias("n_tokens"))
    huge = rows.where(F.col("n_bytes") > long_bytes).withColumn("key", F.md5("text"))
    keyed = scratch.table(huge.select("id", "n_bytes", "key", F.length("text").alias("n_chars")))
    if keyed.isEmpty():
        return short
    sizes = scratch.table(keyed.groupBy("key").agg(F.first("n_chars").alias("n_chars")))
    counts = count_long(huge.select("key", "text"), sizes, scratch, size, overlap, file)
    return short.union(keyed.join(counts, "key").select("id", "n_bytes", "n_tokens"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = token_counts(docs)
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
