"""Arrow text columns as flat numpy arrays: the shared footing of the vectorised operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step works on; a longer single text is a step of its own.
STEP_BYTES = 4 << 20


def filled(texts: pa.Array) -> pa.Array:
    """The column as strings, nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type != pa.string():
        texts = texts.cast(pa.string())
    return pc.fill_null(texts, "") if texts.null_count else texts


def steps(texts: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of about ``step_bytes`` each (at least one row), in order."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + step_bytes, side="right")))
        yield texts.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and the offsets of each text in them."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The non-empty parts of split texts, and where each text's parts begin."""
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets -= offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(full.to_numpy(zero_copy_only=False), out=before[1:])
    return flat.filter(full), before[offsets]


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space (``[^\\x20\\x09-\\x0D]+``), and where each text's words begin."""
    return pieces(pc.ascii_split_whitespace(texts))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each text, as int64."""
    before = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=before[1:])
    return before[offsets[1:]] - before[offsets[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` for all i, on end."""
    total = int(lengths.sum())
    shift = np.cumsum(lengths) - lengths
    far = max(total, int((starts + lengths).max(initial=0)))
    kind = np.int32 if far < 1 << 31 else np.int64  # half the memory where places are small
    out = np.repeat((starts - shift).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)

#: A-Z in lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values with every bit spread over all others."""
    with np.errstate(over="ignore"):
        values = values ^ (values >> np.uint64(29))
        values = values * np.uint64(0xBF58476D1CE4E5B9)
        return values ^ (values >> np.uint64(32))


class HashedWords:
    """The words of a column of texts: their 64-bit hashes on end, and where each text's words begin.

    A-Z count as lower case; ``word`` says which bytes words are made of.
    """

    def __init__(self, texts: pa.Array, word: np.ndarray = NOT_SPACE):
        data, offsets = raw(texts)
        self.data = LOWER[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = word[self.data]
        edge = np.diff(inside.astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self._cut(offsets)
        self.bounds = np.searchsorted(self.starts, offsets)
        n = len(data)
        powers = np.empty(n + 1, np.uint64)
        powers[0] = 1
        with np.errstate(over="ignore"):
            powers[1:] = _BASE
            np.multiply.accumulate(powers, out=powers)
            totals = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=totals[1:])
            # Each word's sum, shifted to the same power whatever its place.
            value = (totals[self.ends] - totals[self.starts]) * powers[n - self.starts]
            value *= np.uint64(pow(int(_BASE), -n, 1 << 64))
        self.hashes = mixed(value)

    def _cut(self, offsets: np.ndarray) -> None:
        """End words where their text ends, even if the next text begins with more of a word."""
        if not len(self.starts):
            return
        inner = offsets[1:-1]
        at = np.searchsorted(self.starts, inner, side="left") - 1
        crossed = np.unique(inner[(at >= 0) & (self.starts[np.maximum(at, 0)] < inner) & (self.ends[np.maximum(at, 0)] > inner)])
        self.starts = np.sort(np.append(self.starts, crossed))
        self.ends = np.sort(np.append(self.ends, crossed))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rolling hashes of k words, of each text by itself, and where each text's begin."""
        n = max(0, len(self.hashes) - k + 1)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = out * _STEP + self.hashes[j : j + n]
        counts = np.maximum(np.diff(self.bounds) - k + 1, 0)
        return out[ragged(self.bounds[:-1], counts)].view(np.int64), np.append(0, np.cumsum(counts))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`grams`, but a text with fewer words has one of all its words."""
        values, starts = self.grams(k)
        held = np.diff(self.bounds)
        short = np.flatnonzero((held > 0) & (held < k))
        if not len(short):
            return values, starts
        folded = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k - 1):
                there = held[short] > j
                folded[there] = folded[there] * _STEP + self.hashes[self.bounds[short[there]] + j]
        counts = np.diff(starts)
        counts[short] = 1
        fresh = np.append(0, np.cumsum(counts))
        out = np.empty(fresh[-1], np.int64)
        own = np.ones(len(out), bool)
        own[fresh[short]] = False
        out[own], out[fresh[short]] = values, folded.view(np.int64)
        return out, fresh
