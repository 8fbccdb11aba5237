"""Operator 5, byte-level BPE encoding and decoding with padded numpy matrices.

Distinct pieces of a step (matches of the pattern) are put into matrices by length, one row a piece.
Every round each row merges its leftmost pair of minimum rank: ranks of pairs come from a hash table
held in arrays, the row is compacted, and only the two pairs beside the merge are looked up anew. Rows
without a mergeable pair leave the matrix. Pieces over ``LONGEST_ROW`` bytes go one by one and merge the
occurrences of their minimum pair from the left in one round, up to the first whose merge makes a pair of lower or equal rank
(as rank files allow): that pair comes first in one-by-one merging too.

Defined cases: a null or empty text has no ids; repeated rows and null ids each give their own row; of pairs of equal rank the leftmost merges
first; long texts are encoded whole, piece by piece; an empty table gives an empty table; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tessera.llm import columns as C
from tessera.llm.tokenizing import CLASSES, ByteBPE, distinct, gather, load_ranks, unsettled, unsettled_class

LONGEST_ROW = 256
ROWS = 1 << 16  # rows of one matrix
NONE = np.int32(0x7FFFFFFF)
STEP_BYTES = 4 << 20  # bytes of text that a step encodes, or of ids that it decodes
RANK_FILE = "byte_bpe_50k.tiktoken"


class PairTable:
    """``(left id, right id) -> rank of their join`` by open addressing in numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs: dict[int, int] = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, (2 * len(keys)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(1 << self.bits, NONE)
        slot, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):  # all keys at once; of those that meet in a free slot, one stays
            self.probes += 1
            free = self.keys[slot] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.keys[slot[free]] = keys[left[free]]
            stays = self.keys[slot] == keys[left]
            self.values[slot[stays]] = values[left[stays]]
            slot, left = (slot[~stays] + 1) & (len(self.keys) - 1), left[~stays]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the joins; ``NONE`` where a pair doesn't join or a side is padding (negative)."""
        shape = a.shape
        a, b = a.ravel(), b.ravel()
        keys = (a.astype(np.int64) << 32 | b.astype(np.int64)).astype(np.uint64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((out == NONE) & (self.values[slot] != NONE) & (a >= 0) & (b >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at = (slot[open_] + 1) & (len(self.keys) - 1)
            slot[open_] = at
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.values[at] != NONE)]
        return out.reshape(shape)


def merge_rows(ids: np.ndarray, pairs: PairTable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row numbers, their final ids)`` of a padded matrix (padding -1), as rows come to their end."""
    rows = np.arange(len(ids))
    ranks = pairs.ranks(ids[:, :-1], ids[:, 1:])
    while True:
        if ids.shape[1] < 2:
            yield rows, ids
            return
        column = ranks.argmin(axis=1)
        best = ranks[np.arange(len(rows)), column]
        ended = best == NONE
        if ended.any():
            yield rows[ended], ids[ended]
            going = ~ended
            rows, ids, ranks, column, best = rows[going], ids[going], ranks[going], column[going], best[going]
            if not len(rows):
                return
        n, width = ids.shape
        at = np.arange(n)
        # Compaction: what follows the merged pair moves one to the left.
        source = np.arange(width - 1)[None, :] + (np.arange(width - 1)[None, :] > column[:, None])
        ids = np.take_along_axis(ids, source, 1)
        ids[at, column] = best
        keep = np.arange(width - 2)[None, :] + (np.arange(width - 2)[None, :] >= column[:, None])
        ranks = np.take_along_axis(ranks, keep, 1)
        if width > 2:
            has_left = np.flatnonzero(column > 0)
            ranks[has_left, column[has_left] - 1] = pairs.ranks(ids[has_left, column[has_left] - 1], best[has_left])
            has_right = np.flatnonzero(column < width - 2)
            ranks[has_right, column[has_right]] = pairs.ranks(best[has_right], ids[has_right, column[has_right] + 1])


def merge_long(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """The final ids of one long piece."""
    ranks = pairs.ranks(ids[:-1], ids[1:])
    while len(ranks) and (best := ranks.min()) != NONE:
        hits = np.flatnonzero(ranks == best)
        # In runs of overlapping pairs every other one merges, from the left.
        fresh = np.append(True, np.diff(hits) > 1)
        run_start = hits[np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))]
        hits = hits[(hits - run_start) % 2 == 0]
        # The pairs that each merge makes, with what stands beside it at that time.
        before = np.where(np.append(False, hits[1:] == hits[:-1] + 2), best, ids[np.maximum(hits - 1, 0)])
        lower = (hits > 0) & (pairs.ranks(before.astype(ids.dtype), np.full(len(hits), best, ids.dtype)) <= best)
        after = hits + 2 < len(ids)
        lower |= after & (pairs.ranks(np.full(len(hits), best, ids.dtype), ids[np.minimum(hits + 2, len(ids) - 1)]) <= best)
        hits = hits[: int(lower.argmax()) + 1] if lower.any() else hits
        ids[hits] = best
        stays = np.ones(len(ids), bool)
        stays[hits + 1] = False
        ids = ids[stays]
        ranks = pairs.ranks(ids[:-1], ids[1:])
    return ids


class MatrixBPE(ByteBPE):
    """The byte-level encoder with its merges run in matrices; no special strings."""

    def __init__(self, rank_file: str, pattern: str = public_tokenizers.PATTERN):
        ranks = load_ranks(rank_file)
        self.special, self.library = {}, None
        self.stand_in = stand_ins()
        self.odd_char = re.compile(unsettled_class())
        self.pattern = regex.compile(pattern)
        self.pairs = PairTable(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pieces = sorted((r, p) for p, r in ranks.items())
        self.token_bytes = np.zeros(pieces[-1][0] + 1, np.int64)
        self.token_bytes[[r for r, _ in pieces]] = [len(p) for _, p in pieces]
        self.token_starts = np.cumsum(self.token_bytes) - self.token_bytes
        self.flat = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)

    def _ids(self, text: str) -> np.ndarray:
        return self._many([text])[0]

    def _many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self._pieces(t) if self.odd_char.search(t) else self.pattern.findall(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        known, code = distinct(pa.array([p for parts in split for p in parts], pa.string()))
        ids, sizes = gather(*self.merged(known), code)
        return ids, C.sums(sizes, np.append(0, np.cumsum(counts)))

    def _pieces(self, text: str) -> list[str]:
        """Matches in a text whose characters the pattern's two engines may class differently."""
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_in))]

    def merged(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces on end, and the size of each."""
        data, offsets = C.raw(pieces)
        start, length = self.single[data], np.diff(offsets)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(length, kind="stable")
        edges = np.searchsorted(length[order], np.arange(LONGEST_ROW + 2))
        for size in range(1, LONGEST_ROW + 1):  # buckets: all rows of a matrix have one length
            bucket = order[edges[size] : edges[size + 1]]
            for at in range(0, len(bucket), ROWS):
                part = bucket[at : at + ROWS]
                matrix = start[offsets[part][:, None] + np.arange(size)[None, :]]
                found += [(part[rows], ids) for rows, ids in merge_rows(matrix, self.pairs)]
        for i in order[edges[LONGEST_ROW + 1] :].tolist():
            ids = merge_long(start[offsets[i] : offsets[i + 1]].copy(), self.pairs)
            found.append((np.array([i]), ids[None, :]))
        sizes = np.zeros(len(pieces), np.int64)
        for rows, ids in found:
            sizes[rows] = ids.shape[1]
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        for rows, ids in found:
            out[starts[rows][:, None] + np.arange(ids.shape[1])[None, :]] = ids
        return out, sizes

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts on end, and where each text's begin, from ids on end."""
        sizes = self.token_bytes[ids]
        return self.flat[C.ragged(self.token_starts[ids], sizes)], np.append(0, np.cumsum(C.sums(sizes, starts)))


@functools.cache
def stand_ins() -> dict[int, str]:
    """For each unsettled character, a settled one of the class that tiktoken's engine gives it."""
    single = {bytes([b]): b for b in range(256)}
    out = {ord(c): "!" for c in unsettled()}
    for pattern, stand_in in zip(CLASSES, "b1\u3000"):
        engine = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        out |= {ord(c): stand_in for c in bytes(engine.encode_ordinary(unsettled())).decode()}
    return out


@functools.cache
def encoder(rank_file: str) -> MatrixBPE:
    """The encoder of a rank file, one a worker."""
    return MatrixBPE(rank_file)


def _binary(flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def encode(text: Column | str, rank_file: str | None = None) -> Column:
    """The ids of a text column, as little-endian unsigned 32-bit integers."""
    rank_file = rank_file or public_tokenizers.path(RANK_FILE)

    @F.arrow_udf(BinaryType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(rank_file)
        for batch in batches:
            for texts in C.steps(C.filled(batch), STEP_BYTES):
                ids, starts = own.encode(texts)
                yield _binary(ids.astype("<u4"), starts * 4)

    return run(text)


def decode(ids: Column | str, rank_file: str | None = None) -> Column:
    """The bytes that ids (as :func:`encode` gives them) stand for; null for null."""
    rank_file = rank_file or public_tokenizers.path(RANK_FILE)

    @F.arrow_udf(BinaryType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(rank_file)
        for batch in batches:
            for part in C.steps(batch.cast(pa.binary()), STEP_BYTES):
                flat, offsets = C.raw(part)
                text, starts = own.decode(np.frombuffer(flat.tobytes(), "<u4"), offsets // 4)
                out = _binary(text, starts)
                yield pc.if_else(part.is_null(), pa.scalar(None, pa.binary()), out) if part.null_count else out

    return run(ids)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = docs.select("doc_id", encode("text").alias("ids"))
    both = coded.select("doc_id", "ids", decode("ids").alias("decoded"))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
