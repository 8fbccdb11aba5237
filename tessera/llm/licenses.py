"""Operator 4, license scans by diagonal voting.

One pass over the texts hashes every text's words, all rolling k-word hashes and the base phrases. Hashes that no
template holds are left out where they are made, and so are texts that have too few of a template's hashes in all to be
able to hold it; what is left is joined by Spark to the positions of the same hashes in the templates. A hit votes for
its diagonal (place in the text less place in the template); votes are summed up by diagonal, diagonals next to each
other (words put in or left out) are merged into runs, and every span around the runs is verified word by word: the
score is the largest share of the template's words that stand in order within a span of twice its length.
A template needs a quarter of its hashes in the text, however they are spread over runs. Besides, phrases that name a
license outright give base labels.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are put in lower case.

Defined cases: a null or empty text has no words and labels; null ids and repeated rows each give their own row, and
equal texts have equal results however often they occur; of labels with equal scores all stay; a long text is one
row of words in its task, and its spans are looked at one by one; an empty table gives an empty table; further
columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import columns as C
from tessera.session import Scratch

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Openings and notices of public licenses, as their texts have them.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]

GRAM = 3
#: Diagonals at most so far apart are one run.
DRIFT = 3
#: Votes that a text needs for a template in all, as a share of the template's positions.
LEAST_VOTES = 0.25
#: Share of a template's words that a span must hold, in order.
LEAST_SHARE = 0.85
#: Words of a span, for each word of the template.
SPAN = 2
#: Templates are sent to all tasks; words in all, checked.
TEMPLATE_WORDS = 100_000

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_of(text: str) -> list[bytes]:
    data = C.LOWER[np.frombuffer(text.encode(), np.uint8)]
    data[~WORD[data]] = 32
    return data.tobytes().split()


def Hashed(texts: pa.Array) -> C.HashedWords:
    return C.HashedWords(texts, WORD)


def hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of words given one by one."""
    return Hashed(pa.array([b" ".join(words).decode()])).hashes


def templates_table(spark, templates=TEMPLATES) -> DataFrame:
    """``(template, tpos, gram, size)`` of all templates; its size is fixed by the list and checked."""
    rows = []
    for t, (_, text) in enumerate(templates):
        values, _ = Hashed(pa.array([text])).grams(GRAM)
        rows += [(t, i, int(g), len(values)) for i, g in enumerate(values)]
    if len(rows) > TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {TEMPLATE_WORDS} words")
    return spark.createDataFrame(rows, "template int, tpos int, gram long, size int")


BASE = "n_words long, n_base long, first_word long, last_word long, base_labels string"
HITS = "hits array<struct<pos:long,gram:long>>"


class Wanted:
    """The templates' hashes, and which template holds which."""

    def __init__(self, templates=TEMPLATES):
        each = [Hashed(pa.array([t])).grams(GRAM)[0] for _, t in templates]
        self.grams = np.unique(np.concatenate([np.zeros(0, np.int64), *each]))
        self.least = np.array([LEAST_VOTES * len(g) for g in each])
        # How often a template holds each hash: so many votes does a hit give it.
        self.votes = np.stack([np.array([np.count_nonzero(g == x) for x in self.grams]) for g in each], axis=1)
        self.near = np.zeros(1 << 16, bool)
        self.near[self.grams & 0xFFFF] = True

    def hits(self, hashed: C.HashedWords) -> pa.ListArray:
        """``(pos, gram)`` of the wanted hashes of each text that can hold a template; none of other texts."""
        values, starts = hashed.grams(GRAM)
        at = np.flatnonzero(self.near[values & 0xFFFF])
        at = at[np.isin(values[at], self.grams)]
        doc = np.searchsorted(starts, at, side="right") - 1
        votes = np.zeros((len(starts) - 1, len(self.least)), np.int64)
        np.add.at(votes, doc, self.votes[np.searchsorted(self.grams, values[at])])
        able = ((votes >= self.least) & (votes > 0)).any(axis=1)
        at, doc = at[able[doc]], doc[able[doc]]
        sizes = np.bincount(doc, minlength=len(starts) - 1)
        found = pa.StructArray.from_arrays([pa.array(at - starts[doc]), pa.array(values[at])], names=["pos", "gram"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), found)


def measure(texts: pa.Array, templates: Wanted) -> pa.StructArray:
    hashed = Hashed(texts)
    n = len(texts)
    bounds, h = hashed.bounds, hashed.hashes
    places, labels = [[] for _ in range(n)], [set() for _ in range(n)]
    for phrase, label in PHRASES.items():
        words = phrase.encode().split()
        wanted = hashes(words)
        span = len(h) - len(words) + 1
        hit = np.ones(max(0, span), bool)
        for j, w in enumerate(wanted):
            hit &= h[j : j + len(hit)] == w
        for i in np.flatnonzero(hit).tolist():
            doc = int(np.searchsorted(bounds, i, side="right")) - 1
            same = all(hashed.data[hashed.starts[i + j] : hashed.ends[i + j]].tobytes() == w for j, w in enumerate(words))
            if same and i + len(words) <= bounds[doc + 1]:
                places[doc].append(i - int(bounds[doc]))
                labels[doc].add(label)
    columns = [
        pa.array(np.diff(bounds).astype(np.int64)), pa.array([len(p) for p in places], pa.int64()), pa.array([min(p, default=None) for p in places], pa.int64()),
        pa.array([max(p, default=None) for p in places], pa.int64()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), templates.hits(hashed),
    ]
    return pa.StructArray.from_arrays(columns, names=["n_words", "n_base", "first_word", "last_word", "base_labels", "hits"])


def scanned(text: Column | str, templates=TEMPLATES) -> Column:
    """A struct of word count, phrase places, base labels (:data:`BASE`) and hits (:data:`HITS`) for a text column."""
    wanted = Wanted(templates)

    @F.arrow_udf(f"{BASE}, {HITS}")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = C.filled(batch)
            yield pa.concat_arrays([measure(s, wanted) for s in C.steps(texts)] or [measure(texts, wanted)])

    return run(text)


def vote(texts: DataFrame, templates: DataFrame) -> DataFrame:
    """``(key, template, runs)``: runs ``(first, last)`` of neighbouring diagonals of ``texts(key, hits)``, for templates with enough votes."""
    hits = texts.select("key", F.explode("hits").alias("h")).select("key", "h.pos", "h.gram")
    hits = hits.join(F.broadcast(templates), "gram").select("key", "template", "size", (F.col("pos") - F.col("tpos")).alias("diagonal"), "pos")
    lines = hits.groupBy("key", "template", "size", "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    along = Window.partitionBy("key", "template").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= DRIFT, 0).otherwise(1)
    runs = lines.withColumn("fresh", fresh)
    runs = runs.withColumn("run", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("key", "template", "size", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("votes").alias("votes"))
    # A text's runs for one template: no more than its words.
    told = runs.groupBy("key", "template", "size").agg(F.collect_list(F.struct("first", "last")).alias("runs"), F.sum("votes").alias("votes"))
    return told.where(F.col("votes") >= LEAST_VOTES * F.col("size")).select("key", "template", "runs")


class Verifier:
    """The share of a template's words that a span of words holds in order."""

    def __init__(self, template: list[bytes]):
        self.size, self.places = len(template), {}
        for i, w in enumerate(template):
            self.places[w] = self.places.get(w, 0) | 1 << i

    def share(self, words: list[bytes]) -> float:
        """Longest common subsequence, by the bits of one number a row."""
        whole = (1 << self.size) - 1
        row = whole
        for w in words:
            met = row & self.places.get(w, 0)
            row = ((row + met) | (row - met)) & whole
        return (self.size - row.bit_count()) / self.size

    def best(self, words: list[bytes], runs: list[tuple[int, int]]) -> float:
        """The largest share of any span that meets a run; a span begins with one of the template's words."""
        span, out, done = SPAN * self.size, 0.0, 0
        for first, last in sorted(runs):
            for at in range(max(done, first + 1 - span, 0), min(last + GRAM, len(words))):
                if words[at] in self.places:
                    out = max(out, self.share(words[at : at + span]))
            done = max(done, last + GRAM)
        return out


def verified(runs: DataFrame, texts: DataFrame, templates=TEMPLATES, least: float = LEAST_SHARE) -> DataFrame:
    """``(key, own, best)``: labels of templates of which ``least`` is there, checked word by word on ``texts(key, text)``, and the best score."""
    checks = [Verifier(words_of(t)) for _, t in templates]
    names = [label for label, _ in templates]
    grouped = runs.groupBy("key").agg(F.collect_list(F.struct("template", "runs")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                words = words_of(r["text"])
                scores = [(checks[c["template"]].best(words, [(x["first"], x["last"]) for x in c["runs"]]), names[c["template"]]) for c in r["found"]]
                held = [x for x in scores if x[0] >= least]
                if held:
                    out.append({"key": r["key"], "own": sorted({x[1] for x in held}), "best": max(held)[0]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("own", pa.list_(pa.string())), ("best", pa.float64())]))

    return texts.join(grouped, "key").select("key", "text", "found").mapInArrow(run, "key string, own array<string>, best double")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    read = rows.select("id", "text", scanned("text", templates).alias("s"))
    able = F.size("s.hits") > 0
    # Written once: of texts that can't hold a template only the base columns stay.
    read = scratch.table(read.select("id", "s.*", F.when(able, F.col("text")).alias("text"), F.when(able, F.md5("text")).alias("key")))
    # Equal texts vote once, so that their number has no part in the result.
    texts = scratch.table(read.where("key is not null").groupBy("key").agg(F.first("text").alias("text"), F.first("hits").alias("hits")))
    runs = vote(texts.select("key", "hits"), templates_table(spark, templates))
    by_text = scratch.table(verified(runs, texts.select("key", "text"), templates))
    # Rows without a key need no join; the others are few, and a key that many of them share can be split.
    based = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    scored = read.where("key is not null").select("key", *based).join(by_text, "key", "left").select(*based, "own", "best")
    merged = scored.unionByName(read.where("key is null").select(*based), allowMissingColumns=True)
    own = F.coalesce("own", F.array().cast("array<string>"))
    named = F.filter(F.split("base_labels", ","), lambda x: x != "")
    return merged.select(
        "id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(F.array_sort(F.array_union(named, own)), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def op4_license_scans(spark, sf_dir: str) -> DataFrame:
    """Base places and all labels of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return license_scan(docs).withColumnRenamed("id", "doc_id")
