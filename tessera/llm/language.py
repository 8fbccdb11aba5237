"""Operator 12, language identification by language-bitmask n-gram filters.

Three letters in a row, with a word's edges as letters of their own, make a gram; a text is the set of its grams. From the
documents to learn from, Spark counts in how many of each language's documents every gram stands. A gram is held by
a language if it makes up ``LEAST_SHARE`` of the language's counts and ``NEAR`` of its share in the language where it is most common.
So a language holds ``1 / LEAST_SHARE`` grams at most, whatever the input, and no gram that is merely a stray word of another.

All languages' grams go into one Bloom filter whose slots are bitmasks, one bit a language (the filters of all languages,
sliced by bit): the masks at a gram's ``HASHES`` slots, and-ed, name every language that holds it. A text's grams are looked up once for all languages,
and the bits of each language counted. A filter that is full to a share ``f`` names a gram that its language doesn't hold with
probability ``f ** HASHES``; the counts are corrected for that. The language with the largest corrected count is the prediction and
its share of all languages' corrected counts the score.

Memory: ``SLOTS`` masks of 64 languages, 8 MB, are sent to all tasks; above 1,024 languages there are fewer slots, so that 128 MB
is the most at any number, and more false positives, which the correction takes into account.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is any text where nothing could be learned; a
language is any non-null label, the empty one too; a text that none of the languages explains, and ties, go to the language with
more documents to learn from, then to the smaller name; repeated rows and copies count as documents of their own; long texts
are read whole; null ids are learned from and not held out; an empty table gives an empty table; further columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tessera.llm import columns as C
from tessera.session import Scratch

LEAST_SHARE = 2e-5
NEAR = 0.5
HASHES = 3
SLOTS = 1 << 20
WORD = 64
#: Words of 64 languages that a slot may have at the full number of slots.
FULL_WORDS = 16
NO_LANGUAGE = "und"
#: Stands between texts; no text can hold a lone surrogate.
BETWEEN = "\ud800"


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(text, gram)``, each pair once and in order of texts; a gram is three code points of 21 bits, an edge of a word is zero."""
    joined = BETWEEN + BETWEEN.join(texts.to_pylist()).lower() + BETWEEN
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    inside = letters()[points]
    # One edge between words: the last of the characters that aren't letters, and one at the very end.
    kept = np.flatnonzero(inside | np.append(inside[1:], True))
    text = np.cumsum(points == ord(BETWEEN))[kept] - 1
    points = np.where(inside[kept], points[kept], 0)
    alphabet, small = _dense(points)
    middle = np.flatnonzero(points[1:-1]) + 1
    a = len(alphabet)
    keys = np.sort(((text[middle] * a + small[middle - 1]) * a + small[middle]) * a + small[middle + 1])
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    place = [alphabet[keys // a**k % a] for k in (2, 1, 0)]
    return keys // a**3, place[0] << 42 | place[1] << 21 | place[2]


def _dense(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different code points, and each one's place among them."""
    there = np.zeros(0x110000, bool)
    there[points] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[points]


def slots_of(gram: np.ndarray, slots: int) -> np.ndarray:
    """The slots of each gram, a row a hash; ``slots`` is a power of two."""
    with np.errstate(over="ignore"):
        seeds = np.arange(1, HASHES + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        return (C.mixed(C.mixed(gram.astype(np.uint64))[None] + seeds) & np.uint64(slots - 1)).astype(np.int64)


class Filters:
    """The Bloom filters of all languages, sliced by bit: ``masks[w, slot]`` has bit b set if language ``64 w + b`` has the slot."""

    def __init__(self, languages: list[str], slots: int):
        self.languages, self.slots = languages, slots
        self.masks = np.zeros((max(1, -(-len(languages) // WORD)), slots), np.uint64)

    def fill(self) -> np.ndarray:
        """The share of each language's bits that is set."""
        return np.array([float((self.masks[i // WORD] >> np.uint64(i % WORD) & np.uint64(1)).sum()) for i in range(len(self.languages))]) / self.slots

    def holders(self, gram: np.ndarray) -> np.ndarray:
        """The masks of the languages that hold each gram (and a few that don't), ``[word, gram]``."""
        return np.bitwise_and.reduce(self.masks[:, slots_of(gram, self.slots)], axis=1)

    def predict(self, texts: pa.Array, wrong: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores; ``wrong``: how likely each language's filter names a gram by mistake."""
        text, gram = grams(texts)
        score, best = np.zeros(len(texts)), np.full(len(texts), -1)
        if self.languages and len(text):
            different, which = np.unique(gram, return_inverse=True)
            masks = self.holders(different)
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            n = np.diff(np.append(first, len(text)))
            total, most, at = np.zeros(len(first)), np.full(len(first), -1.0), np.zeros(len(first), np.int64)
            for i, by_mistake in enumerate(wrong):
                bits = (masks[i // WORD] >> np.uint64(i % WORD) & np.uint64(1)).astype(np.int64)[which]
                count = np.maximum(np.add.reduceat(bits, first) - n * by_mistake, 0) / max(1 - by_mistake, 1e-9)
                total += count
                at[count > most] = i
                most = np.maximum(most, count)
            best[text[first]] = at
            score[text[first]] = np.minimum(1.0, most / np.maximum(total, 1e-300))
        return [self.languages[i] if i >= 0 else NO_LANGUAGE for i in best], score


def gram_counts(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, gram, docs)``: in how many documents of a language each gram stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = 0, C.filled(batch.column(0))
            langs = C.filled(batch.column(1)).dictionary_encode()
            place = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for part in C.steps(texts):
                text, gram = grams(part)
                different, which = np.unique(gram, return_inverse=True)
                pair, docs = np.unique(place[at + text] * max(1, len(different)) + which, return_counts=True)
                lang = langs.dictionary.take(pa.array(pair // max(1, len(different))))
                yield pa.RecordBatch.from_arrays([lang, pa.array(different[pair % max(1, len(different))], pa.int64()), pa.array(docs, pa.int64())], names=["lang", "gram", "docs"])
                at += len(part)

    rows = labelled.select(labelled[text_col].cast("string").alias("text"), labelled[lang_col].cast("string").alias("lang")).where("lang is not null")
    return rows.mapInArrow(run, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """The filters of all labelled rows."""
    scratch = Scratch(labelled.sparkSession, "language")
    label = labelled[lang_col].cast("string")
    known = labelled.where(label.isNotNull()).groupBy(label.alias("lang")).count().collect()  # a row a language
    languages = [r["lang"] for r in sorted(known, key=lambda r: (-r["count"], r["lang"].encode()))]
    words = max(1, -(-len(languages) // WORD))
    out = Filters(languages, SLOTS // (1 << max(0, (words - 1) // FULL_WORDS).bit_length()))
    if not languages:
        return out
    counts = scratch.table(gram_counts(labelled, text_col, lang_col))
    sizes = counts.groupBy("lang").agg(F.sum("docs").alias("size"))
    shares = counts.join(sizes, "lang").select("lang", "gram", (F.col("docs") / F.col("size")).alias("share")).where(F.col("share") >= LEAST_SHARE)
    held = shares.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= NEAR * F.col("most")).select("lang", "gram")
    number, slots = {name: i for i, name in enumerate(languages)}, out.slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            slot = slots_of(batch.column(1).to_numpy(), slots)
            mask = (np.uint64(1) << (at % WORD).astype(np.uint64)).view(np.int64)
            full = lambda x: pa.array(np.broadcast_to(x, slot.shape).ravel())
            yield pa.RecordBatch.from_arrays([full((at // WORD).astype(np.int32)), full(slot.astype(np.int32)), full(mask)], names=["word", "slot", "mask"])

    # At most HASHES / LEAST_SHARE slots a language, and never more than there are.
    sliced = held.mapInArrow(run, "word int, slot int, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    word, slot, mask = (sliced.column(c).to_numpy() for c in ("word", "slot", "mask"))
    out.masks[word, slot] = mask.view(np.uint64)
    scratch.drop_all()
    return out


def predict(rows: DataFrame, filters: Filters, text_col: str, keep: list[Column]) -> DataFrame:
    """``keep`` of every row with ``lang_pred`` and ``score``."""
    spark = rows.sparkSession
    sent, wrong = spark.sparkContext.broadcast(filters), filters.fill() ** HASHES
    kept = rows.select(*keep)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in C.steps(C.filled(batch.column(len(names)))):
                lang, score = sent.value.predict(part, wrong)
                held = [batch.column(i).slice(at, len(part)) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*held, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])
                at += len(part)

    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.select(*keep, rows[text_col].cast("string").alias("_text")).mapInArrow(run, schema)


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op12_over(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of all documents, learned from those that are not held out."""
    held_out = is_held_out(docs["doc_id"])
    filters = learn(docs.where(~held_out))
    return predict(docs, filters, "text", [docs["doc_id"], held_out.alias("held_out")])


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    """The languages of all documents."""
    return op12_over(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
