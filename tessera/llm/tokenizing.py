"""Whole Arrow columns of texts to token ids, by the public tokenizers' rules.

A column is cut at places where the tokenizer can never join what stands on either side, the cut
parts are encoded once per distinct part, and the ids of all texts are gathered by numpy. Tests hold
the results against the tokenizers' own libraries.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

from tessera.llm import columns as C

#: White space as ``\\s`` may mean it; a superset is safe, as it only decides which texts are encoded whole.
SPACE = r"[\s\pZ\x1c-\x1f\x{85}]"


CLASSES = (r"\p{L}", r"\p{N}", r"\s")


@functools.cache
def unsettled() -> str:
    """Characters whose class (letter, number, white space) differs between Unicode 3.2 and the newest known here.

    Libraries carry different Unicode versions, so texts with such characters take the library's own
    path where there is one.
    """
    import regex

    chars = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    new = [set(regex.findall(c, chars)) for c in CLASSES]
    old = unicodedata.ucd_3_2_0
    return "".join(c for c in chars if [c in x for x in new] != [(k := old.category(c))[0] == "L", k[0] == "N", k[0] == "Z" or c in "\t\n\v\f\r\x85"])


@functools.cache
def unsettled_class() -> str:
    """A bracketed regular expression of :func:`unsettled`, for RE2 and Python alike."""
    codes = np.array([ord(c) for c in unsettled()])
    edges = np.flatnonzero(np.diff(codes) > 1)
    firsts, lasts = codes[np.append(0, edges + 1)], codes[np.append(edges, len(codes) - 1)]
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(firsts, lasts)) + "]"


def distinct(parts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct parts, and the code of each part among them."""
    coded = parts.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def gather(ids: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of coded parts on end, and the size of each, from those of the distinct parts."""
    starts = np.cumsum(sizes) - sizes
    return ids[C.ragged(starts[code], sizes[code])], sizes[code]


class Encoder:
    """Columns of texts to ids: texts that can be cut go by their distinct parts, the rest whole."""

    def odd(self, texts: pa.Array) -> np.ndarray:
        """Which texts must be encoded whole."""
        raise NotImplementedError

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all parts on end, the size of each part, and where each text's parts begin."""
        raise NotImplementedError

    def whole(self, text: str) -> np.ndarray:
        """One text, uncut."""
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end (uint32), and where each text's ids begin (one more at the end)."""
        odd = np.flatnonzero(self.odd(texts))
        plain = texts
        if len(odd):
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            plain = pc.if_else(pa.array(mask), pa.scalar(""), texts)
        ids, sizes, bounds = self.cut(plain)
        starts = np.append(0, np.cumsum(C.sums(sizes, bounds)))
        if len(odd):
            split = [ids[a:b] for a, b in zip(starts, starts[1:])]
            for i in odd.tolist():
                split[i] = self.whole(texts[i].as_py())
            ids, starts = np.concatenate(split), np.append(0, np.cumsum([len(x) for x in split]))
        return ids, starts


class ByteBPE(Encoder):
    """Byte-level BPE by a rank file, as the ``tokenizers`` file of the same vocabulary gives it.

    ``special`` strings inside texts become their id. Texts are cut before single spaces, as a space
    belongs to what follows it. Where a run of white space could reach over a cut, the text is whole.
    """

    def __init__(self, rank_file: str, pattern: str = public_tokenizers.PATTERN, special: dict[str, int] | None = None, library_file: str | None = None):
        from tokenizers import Tokenizer

        ranks = load_ranks(rank_file)
        self.special = special or {}
        self.library = Tokenizer.from_file(library_file) if library_file else None
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            self.token_bytes[rank] = len(piece)

    def whole(self, text: str) -> np.ndarray:
        if self.library is not None and re.search(unsettled_class(), text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        if not any(s in text for s in self.special):
            return self._ids(text)
        split = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
        return np.concatenate([np.array([self.special[x]], np.uint32) if x in self.special else self._ids(x) for x in split])

    def _ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)

    def _many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several texts on end, and the size of each."""
        found = [self._ids(t) for t in texts]
        return np.concatenate(found) if found else np.zeros(0, np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def odd(self, texts: pa.Array) -> np.ndarray:
        out = pc.match_substring_regex(texts, f"{SPACE} ({SPACE}|$)|{unsettled_class()}")
        for s in self.special:
            out = pc.or_(out, pc.match_substring(texts, s))
        return out.to_numpy(zero_copy_only=False)

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of distinct parts, encoded in one run of text."""
        # A part of white space alone, or whose space is followed by more, would join the part before it.
        blank = pc.match_substring_regex(parts, f"^ ({SPACE}|$)").to_numpy(zero_copy_only=False)
        joined = parts.filter(pa.array(~blank))
        data, offsets = C.raw(joined)
        ids = self._ids(data.tobytes().decode())
        ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), offsets[1:], side="right")
        sizes = np.zeros(len(parts), np.int64)
        sizes[~blank] = np.diff(np.append(0, ends))
        spots = np.flatnonzero(blank)
        lone, sizes[spots] = self._many([parts[int(i)].as_py() for i in spots])
        out = np.empty(int(sizes.sum()), np.uint32)
        alone = np.repeat(blank, sizes)
        out[~alone], out[alone] = ids, lone
        return out, sizes

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds -= bounds[0]
        known, code = distinct(lists.flatten())
        # A text's first part has no space before it; the parts after it do.
        heads, head_code = np.unique(code[bounds[:-1]], return_inverse=True)
        ids, sizes = self._parts(pc.binary_join_element_wise(" ", known, ""))
        first, first_sizes = self._many([known[int(i)].as_py() for i in heads])
        code[bounds[:-1]] = len(known) + head_code
        ids, part_sizes = gather(np.append(ids, first), np.append(sizes, first_sizes), code)
        return ids, part_sizes, bounds


class WordBPE(Encoder):
    """Lower-cased BPE with an end-of-word mark, as the ``tokenizers`` file gives it.

    White space is dropped and nothing joins over it, so a text is its words between white space. The
    merges are run by a rank encoder on pieces that end with a mark byte, its ranks putting the merge
    of the mark with the last byte first. That gives the merges' own result if every entry of the
    vocabulary encodes to itself, which :meth:`faithful` shows. Texts with special strings, the mark or
    separators that not all libraries call white space go to the library whole.
    """

    MARK = "\x00"

    def __init__(self, file: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        alphabet, mark = byte_alphabet(), self.MARK.encode()
        to_byte = {c: b for b, c in alphabet.items()}
        ranks = {bytes([b]) + mark: vocab[c + suffix] for b, c in alphabet.items() if bytes([b]) != mark}
        ranks |= {bytes([b]): vocab[c] for b, c in alphabet.items()}
        for a, b in spec["model"]["merges"]:
            merged = a + b
            end = merged.endswith(suffix)
            ranks[bytes(to_byte[c] for c in merged.removesuffix(suffix)) + mark * end] = vocab[merged]
        self.pieces, self.ids = list(ranks), np.array(list(ranks.values()), np.uint32)
        self.encoding = tiktoken.Encoding("words", pat_str=r"[^\x00\n]+\x00|\n", mergeable_ranks={p: i for i, p in enumerate(ranks)}, special_tokens={})
        self.separator = self.pieces.index(b"\n")
        self.parts = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    def faithful(self) -> bool:
        """Whether every entry of the vocabulary encodes to itself."""
        single = self.encoding._core_bpe.encode_single_piece
        return all(single(p) == [r] for r, p in enumerate(self.pieces))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def odd(self, texts: pa.Array) -> np.ndarray:
        out = pc.match_substring_regex(texts, r"[\x00\x1c-\x1f]|" + unsettled_class())
        for s in self.special:
            out = pc.or_(out, pc.match_substring(texts, s, ignore_case=True))
        return out.to_numpy(zero_copy_only=False)

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, bounds = C.pieces(pc.utf8_split_whitespace(texts))
        known, code = distinct(words)
        joined = "".join(x + "\n" for x in known.to_pylist())
        # Lower case of each character by itself: only the capital sigma's depends on its place.
        joined = unicodedata.normalize("NFC", joined).replace("\u03a3", "\u03c3").lower()
        marked = self.parts.sub(r"\g<0>" + self.MARK, joined)
        found = self.encoding.encode_to_numpy(marked, disallowed_special=())
        breaks = np.flatnonzero(found == self.separator)
        sizes = np.diff(np.append(-1, breaks)) - 1
        ids, part_sizes = gather(self.ids[found[found != self.separator]], sizes, code)
        return ids, part_sizes, bounds


@functools.cache
def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies, in the order of their ids."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def load_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


@functools.cache
def byte_bpe(file: str = public_tokenizers.path("byte_bpe_50k.tiktoken"), library: str = public_tokenizers.path("byte_bpe_50k.json"), special: tuple = (("<|endoftext|>", 50256),)) -> ByteBPE:
    """The encoder of a rank file and its library's file, one a worker."""
    return ByteBPE(file, special=dict(special), library_file=library)


@functools.cache
def word_bpe(file: str = public_tokenizers.path("word_bpe_49k.json")) -> WordBPE:
    """The encoder of a word BPE file, one a worker."""
    return WordBPE(file)
