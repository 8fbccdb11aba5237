"""Operator 11, source divergence audit: sketch-prefiltered counting, then sparse pair joins.

The first pass over the texts finds each task's document frequencies by language and term and puts them into a count-min
sketch: a term adds to one cell in each of ``DEPTH`` rows. Tasks send the cells that they touched, Spark adds these up, and
what is left of the merged sketch is one bit a cell, that is whether it reached the frequency asked for. A term's cells hold
its own documents at least, so a merged sketch never underestimates; it may only let a rare term through.

The second pass counts again and drops a term unless all its cells have their bit: terms that can't be frequent enough, most
of all different ones, never leave their task. The survivors are counted exactly by language, source and term.

Pairs of sources are compared sparsely. Where neither source has a term, its value is the same for all such terms; where
one has it, the value depends on that source's count alone, so a histogram of counts is enough; only terms that both
have are joined, term by term, and summed in the task that joins them.

The sketch has eight cells a document and row, 65,536 at least and ``WIDEST`` at most, so what is sent to all tasks is
``DEPTH * WIDEST / 8`` bytes (6 MB) however many terms there are; beyond that more rare terms slip through to the exact
count and results stay the same.

Defined cases: null text, language and source count as empty; a text without terms makes its group occur; repeated rows and
copies are documents of their own; ties in a rank go to the smaller item by its bytes; a language without kept terms has value
0 for its pairs; a language's only source has no pairs; long texts are read whole; an empty table gives an empty table;
further columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import columns as C
from tessera.session import Scratch

LEAST_DOCS = 30
TOP_TERMS = 50
SMOOTH = 5
ONE = 1_000_000_000

DEPTH = 3
NARROWEST, WIDEST = 1 << 16, 1 << 24
CELLS_A_DOCUMENT = 8
#: Spark's bitmaps hold so many bits each.
BITMAP = 1 << 15
#: Texts that are counted together in a task; larger steps send fewer rows.
STEP_BYTES = 8 << 20

#: Bytes of terms: letters of ASCII and all of other characters.
TERM = np.ones(256, bool)
TERM[0x00:0x41] = TERM[0x5B:0x61] = TERM[0x7B:0x80] = False


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of a sorted array, and where each begins."""
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)
    return sorted_keys[first], first


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different terms, and for each text and term in it the text's place, the term's and how often it occurs."""
    data, offsets = C.raw(pc.binary_join_element_wise(texts, "", "\n"))  # so that no term runs on into the next text
    low = C.LOWER[data]
    inside = TERM[low]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    places = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(np.append(low[inside], np.uint8(0))))
    coded = found.dictionary_encode()
    different = coded.dictionary
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
    size = max(1, len(different))
    keys, first = runs(np.sort(doc * size + coded.indices.to_numpy(zero_copy_only=False)))
    return different, keys // size, keys % size, np.diff(np.append(first, len(doc)))


def hashed(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every task."""
    return C.HashedWords(pc.binary_join_element_wise(strings, "", "/"), np.ones(256, bool)).hashes


def cells(term: np.ndarray, lang: np.ndarray, width: int) -> np.ndarray:
    """The cell of each term in every row of the sketch, from the hashes of terms and their languages; rows stand one after another."""
    both = C.mixed(term ^ C.mixed(lang))
    rows = np.arange(DEPTH, dtype=np.uint64)[:, None]
    with np.errstate(over="ignore"):
        place = C.mixed(both[None] + (rows + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(width - 1)
    return (place + rows * np.uint64(width)).astype(np.int64)


class Step:
    """What one step's texts hold: terms, languages and sources by number, and the pairs of text and term."""

    def __init__(self, batch: pa.RecordBatch):
        text, lang, source = (C.filled(batch.column(name)) for name in ("text", "lang", "source"))
        self.terms, self.doc, self.term, self.n = terms(text)
        self.size = max(1, len(self.terms))
        lang, source = lang.dictionary_encode(), source.dictionary_encode()
        self.langs, self.sources = lang.dictionary, source.dictionary
        self.lang = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.source = source.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.hashes, self.lang_hashes = hashed(self.terms), hashed(self.langs)

    def frequencies(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Term, language and number of documents, each pair of the first two once."""
        keys, first = runs(np.sort(self.lang[self.doc] * self.size + self.term))
        return keys % self.size, keys // self.size, np.diff(np.append(first, len(self.doc)))

    def counts(self, able: np.ndarray) -> pa.RecordBatch:
        """Occurrences and documents by language, source and term, of the pairs of text and term that ``able`` names."""
        doc, term, n = self.doc[able], self.term[able], self.n[able]
        keys = (self.lang[doc] * len(self.sources) + self.source[doc]) * self.size + term
        order = np.argsort(keys, kind="stable")
        keys, first = runs(keys[order])
        group, term = keys // self.size, keys % self.size
        total = np.add.reduceat(n[order], first) if len(first) else first
        docs = np.diff(np.append(first, len(order)))
        pick = lambda values, at: values.take(pa.array(at))
        return pa.RecordBatch.from_arrays([pick(self.langs, group // len(self.sources)), pick(self.sources, group % len(self.sources)), pick(self.terms, term), pa.array(total, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[Step]:
    for batch in batches:
        at = 0
        for part in C.steps(C.filled(batch.column("text")), STEP_BYTES):
            yield Step(batch.slice(at, len(part)))
            at += len(part)


def sketch_bits(rows: DataFrame, least: int, width: int) -> np.ndarray:
    """The merged sketch's bits, packed: which cells reach ``least`` documents. It holds ``DEPTH * width`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(DEPTH * width, np.uint8)  # up to ``least``: no more is asked
        for step in steps(batches):
            term, lang, docs = step.frequencies()
            place = cells(step.hashes[term], step.lang_hashes[lang], width).ravel()
            order = np.argsort(place, kind="stable")
            place, first = runs(place[order])
            if len(first):
                held[place] = np.minimum(held[place] + np.add.reduceat(np.tile(docs, DEPTH)[order], first), least)
        touched = np.flatnonzero(held)
        for at in range(0, len(touched), 1 << 18):
            some = touched[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some].astype(np.int32))], names=["cell", "n"])

    full = rows.mapInArrow(run, "cell long, n int").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    packed = full.groupBy(F.shiftright("cell", 15).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell") + 1)).alias("bits"))
    out = np.zeros(-(-DEPTH * width // BITMAP) * BITMAP // 8, np.uint8)
    for at, bits in packed.collect():  # one row for 4096 bytes
        out[at * BITMAP // 8 : (at + 1) * BITMAP // 8] = np.frombuffer(bits, np.uint8)
    return out


def width_for(n_documents: int) -> int:
    """Cells of a row of the sketch: a power of two."""
    return min(WIDEST, max(NARROWEST, 1 << (CELLS_A_DOCUMENT * n_documents - 1).bit_length()))


def term_counts(documents: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``(lang, source, term, n, lang_n)``: occurrences of each language's terms that stand in ``least`` of its documents at least."""
    if not 0 < least < 256:
        raise ValueError("the sketch counts up to 255 documents")
    rows = documents.select(*[documents[c].cast("string").alias(c) for c in ("text", "lang", "source")])
    width = width_for(rows.count())
    sent = rows.sparkSession.sparkContext.broadcast(sketch_bits(rows, least, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for step in steps(batches):
            term, lang, _ = step.frequencies()
            place = cells(step.hashes[term], step.lang_hashes[lang], width)
            able = ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).all(axis=0)
            may = np.zeros(len(step.langs) * step.size, bool)
            may[lang[able] * step.size + term[able]] = True
            yield step.counts(np.flatnonzero(may[step.lang[step.doc] * step.size + step.term]))

    survivors = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    exact = survivors.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")  # a row a source
    return exact.withColumns({"lang_n": F.sum("n").over(whole), "lang_docs": F.sum("docs").over(whole)}).where(F.col("lang_docs") >= least).drop("docs", "lang_docs")


def share(n: str, total: str, kept: str) -> Column:
    """``1 + floor(ONE * (n + SMOOTH) / (total + SMOOTH * kept))`` in whole numbers of any size."""
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"1 + ({ONE}BD * ({wide(n)} + {SMOOTH}BD)) div ({wide(total)} + {SMOOTH}BD * {wide(kept)})")


def divergence(documents: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: each source against the others of its language, and the terms it uses more than its language."""
    scratch = Scratch(documents.sparkSession, "divergence")
    counts = scratch.table(term_counts(documents, least))
    sized = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = counts.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    occurring = documents.select(*[F.coalesce(documents[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = occurring.join(sized, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0)
    groups = groups.withColumn("none", F.when(F.col("kept") > 0, share("0", "total", "kept")).otherwise(0))
    groups = scratch.table(groups)
    held = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "none", share("n", "total", "kept").alias("p"), share("lang_n", "lang_total", "kept").alias("q"))
    held = scratch.table(held)

    own = held.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    own = own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"))
    apart = F.abs(F.col("none") - F.col("item_none"))
    pairs = groups.join(other, "lang").where("source <> item")
    neither = pairs.select("lang", "source", "item", (F.col("kept") * apart).alias("value"))
    steps_up = held.groupBy("lang", "source", "none", "p").agg(F.count("*").alias("n_terms"))
    one = steps_up.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("n_terms") * (F.abs(F.col("p") - F.col("item_none")) - apart)).alias("value"))
    second = held.select("lang", "term", F.col("source").alias("item"), F.col("none").alias("item_none"), F.col("p").alias("item_p"))
    differs = F.abs(F.col("p") - F.col("item_p")) - F.abs(F.col("p") - F.col("item_none")) - F.abs(F.col("none") - F.col("item_p")) + apart
    both = held.join(second, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(differs).alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    sided = scratch.table(one.unionByName(both))  # read twice, as each holds for both directions
    parts = neither.unionByName(sided).unionByName(turned(sided))
    pair = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pair = pair.withColumn("rank", F.row_number().over(best))
    return pair.unionByName(own)


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS kept, sum(lang_n) AS lang_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(n.n, 0) AS n FROM g JOIN k ON g.lang = k.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + ({ONE} * (c.n + {SMOOTH})::HUGEINT) // (t.total + {SMOOTH} * v.kept) AS p, 1 + ({ONE} * (c.lang_n + {SMOOTH})::HUGEINT) // (v.lang_total + {SMOOTH} * v.kept) AS q
  FROM c JOIN t ON c.lang = t.lang AND c.source = t.source JOIN v ON c.lang = v.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
