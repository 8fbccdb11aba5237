"""Operator 1, quality rules: repetition found by a suffix array over words.

A suffix array of each text's words is sorted by prefix doubling, many texts in one vectorised
step. Longest common prefixes of neighbouring suffixes give the maximal repeated word sequences;
the union of their spans is the repeated part of the text.

Defined cases: a null or blank text has no words, so it fails the base rule (under 20 words); null
ids are kept; repeated rows each get their own, equal result; no suffixes tie, as one is always longer; long texts are
judged whole, one to a step; an empty table gives an empty table; further columns pass through :func:`passing` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import columns as C

WINDOW = 8  # words of a window of the base rule
MIN_WORDS = 20
MAX_WINDOW_PERCENT = 30


@dataclass(frozen=True)
class RepetitionLimits:
    """The verdict's limits. Repeats under ``min_repeat`` words don't count."""

    min_repeat: int = 5
    max_covered: float = 0.4
    max_longest: int = 100


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, "
    "longest_repeat long, n_repeats long, base_failed boolean, kept boolean"
)


def suffix_ranks(codes: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Ranks of every suffix by its first 1, 2, 4, ... words, within its own text, until all are distinct.

    Equal ranks at level k mean equal sequences of 2**k words; the last level orders all suffixes.
    Only suffixes that still share their rank are sorted again.
    """
    n = len(codes)
    if not n:
        return [np.zeros(0, np.int64)]
    last = np.zeros(n, np.int64)  # position after the text's last word
    edge = np.flatnonzero(np.diff(doc)) + 1
    ends = np.append(edge, n)
    last[:] = np.repeat(ends, np.diff(np.append(0, ends)))
    key = doc.astype(np.int64) * (int(codes.max()) + 1) + codes
    active = np.argsort(key, kind="stable")
    key = key[active]
    group = np.zeros(n, np.int64)  # the rank that the suffixes shared before this level
    rank = np.zeros(n, np.int64)
    levels: list[np.ndarray] = []
    h = 1
    while True:
        first = np.ones(len(active), bool)
        first[1:] = key[1:] != key[:-1]
        at = np.arange(len(active))
        run = np.maximum.accumulate(np.where(first, at, 0))
        if levels:
            head = np.ones(len(active), bool)
            head[1:] = group[1:] != group[:-1]
            rank[active] = group + run - np.maximum.accumulate(np.where(head, at, 0))
        else:
            rank[active] = run
        levels.append(rank.astype(np.int32))  # a step or a single text holds far under 2**31 words
        shared = ~first
        shared[:-1] |= ~first[1:]
        active = active[shared]
        if not len(active):
            return levels
        beyond = active + h
        inside = beyond < last[active]
        following = np.where(inside, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + following
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        group = rank[active]
        h *= 2


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` have in common at their start."""
    n = len(levels[0])
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        ok = (x < n) & (y < n)
        ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        out[ok] += 1 << k
    return out


def repeat_lengths(codes: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each word, the longest sequence from there that occurs elsewhere in its text; 0 if under ``least``."""
    out = np.zeros(len(codes), np.int64)
    levels = suffix_ranks(codes, doc)
    if not len(codes):
        return out
    order = np.empty(len(codes), np.int64)
    order[levels[-1]] = np.arange(len(codes))
    filter_level = min(len(levels) - 1, max(0, int(least).bit_length() - 1))  # 2**level <= least
    coarse = levels[filter_level]
    near = np.flatnonzero(coarse[order[1:]] == coarse[order[:-1]])
    a, b = order[near], order[near + 1]
    lcp = common_prefixes(levels, a, b)
    lcp[lcp < least] = 0
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def covered(lengths: np.ndarray) -> np.ndarray:
    """Which words lie in one of the spans ``[i, i + lengths[i])``."""
    if not len(lengths):
        return np.zeros(0, bool)
    reach = np.maximum.accumulate(np.arange(len(lengths)) + lengths)
    return reach > np.arange(len(lengths))


def measure(texts: pa.Array, limits: RepetitionLimits) -> pa.StructArray:
    """All figures and the verdict for a column of texts."""
    n = len(texts)
    words, starts = C.words(texts)
    counts = np.diff(starts)
    doc = np.repeat(np.arange(n), counts)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    chars = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    data, offsets = C.raw(texts)
    symbols = np.zeros(256, np.uint8)
    symbols[list(b"#*$%&|<>")] = 1

    lines = pc.split_pattern(texts, "\n")
    line = lines.flatten()
    line_doc = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy(zero_copy_only=False)))
    wordy = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(line)), 0)
    line_doc = line_doc[wordy.to_numpy(zero_copy_only=False)]
    line = line.filter(wordy).dictionary_encode()
    pair = line_doc * (len(line.dictionary) + 1) + line.indices.to_numpy(zero_copy_only=False)
    _, firsts = np.unique(pair, return_index=True)
    n_lines = np.bincount(line_doc, minlength=n)
    n_distinct = np.bincount(line_doc[firsts], minlength=n)

    # Spans never leave their text, as common prefixes are taken within one text.
    lengths = repeat_lengths(codes, doc, min(limits.min_repeat, WINDOW))
    windows = np.where(lengths >= WINDOW, lengths, 0)
    spans = np.where(lengths >= limits.min_repeat, lengths, 0)
    maximal = spans > 0
    maximal[1:] &= (spans[:-1] <= spans[1:]) | (doc[:-1] != doc[1:])
    n_repeat = C.sums(covered(windows), starts)
    n_covered = C.sums(covered(spans), starts)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, spans)
    failed = (counts < MIN_WORDS) | (100 * n_repeat > MAX_WINDOW_PERCENT * counts)
    kept = ~failed & (n_covered <= limits.max_covered * counts) & (longest <= limits.max_longest)
    long = lambda x: pa.array(np.asarray(x, np.int64))
    fields = {
        "n_words": long(counts),
        "word_chars": long(C.sums(chars[codes], starts)),
        "n_symbols": long(C.sums(symbols[data], offsets)),
        "n_dup_lines": long(n_lines - n_distinct),
        "n_repeat_words": long(n_repeat),
        "covered_words": long(n_covered),
        "longest_repeat": long(longest),
        "n_repeats": long(C.sums(maximal, starts)),
        "base_failed": pa.array(failed),
        "kept": pa.array(kept),
    }
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))


def quality(text: Column | str, limits: RepetitionLimits = RepetitionLimits()) -> Column:
    """A struct column of all figures and the verdict (:data:`FIELDS`) for a text column."""

    @F.arrow_udf(FIELDS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = [measure(step, limits) for step in C.steps(C.filled(batch))]
            yield pa.concat_arrays(done) if done else measure(C.filled(batch), limits)

    return run(text)


def passing(docs: DataFrame, limits: RepetitionLimits = RepetitionLimits(), text: str = "text") -> DataFrame:
    """The rows whose text the rules keep, with the columns they came with."""
    return docs.where(quality(docs[text], limits)["kept"])


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The figures and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "base_failed", "kept")
    return docs.select("doc_id", quality("text").alias("q")).select("doc_id", *[f"q.{c}" for c in figures])


def _reference_sql(limits: RepetitionLimits = RepetitionLimits()) -> str:
    """The query in DuckDB's SQL: the union of maximal repeats of k and more words is that of repeated k-word windows."""

    def windows(k: int) -> str:
        return f"""(SELECT row, i, count(*) OVER (PARTITION BY row, h) AS c FROM (
          SELECT row, unnest(range(1, n - {k} + 2)) AS i, unnest(list_transform(range(1, n - {k} + 2), lambda i: hash(w[i:i + {k} - 1]))) AS h FROM d WHERE n >= {k}))"""

    def spread(k: int) -> str:
        return f"""(SELECT row, CAST(sum(least({k}, coalesce(later - i, {k}))) AS BIGINT) AS words FROM (
          SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS later FROM {windows(k)} WHERE c > 1) GROUP BY row)"""

    word = r"[^\x20\x09-\x0D]"
    return f"""
WITH d AS (
  SELECT *, len(w) AS n, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines
  FROM (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM documents)
), r AS (
  SELECT d.*, coalesce(base.words, 0) AS rep, coalesce(own.words, 0) AS cov, long.row IS NOT NULL AS too_long
  FROM d LEFT JOIN {spread(WINDOW)} base USING (row) LEFT JOIN {spread(limits.min_repeat)} own USING (row)
  LEFT JOIN (SELECT DISTINCT row FROM {windows(limits.max_longest + 1)} WHERE c > 1) long USING (row)
)
SELECT doc_id, n AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  rep AS n_repeat_words, cov AS covered_words, n < {MIN_WORDS} OR 100 * rep > {MAX_WINDOW_PERCENT} * n AS base_failed,
  NOT (n < {MIN_WORDS} OR 100 * rep > {MAX_WINDOW_PERCENT} * n) AND cov <= {limits.max_covered} * n AND NOT too_long AS kept
FROM r"""


OP1_SQL = _reference_sql()
