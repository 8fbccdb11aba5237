import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.functions import lit
from tokenizers import Tokenizer

from tessera.llm import packing
from tests.llm import cases


def brute_pieces(docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=str)


def checked(rows, capacity=1024):
    """Every sequence is gapless and within the capacity; returns their number."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_pieces_and_places(spark):
    df = cases.docs(spark)
    rows = packing.pack_documents(df).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == brute_pieces([(r.doc_id, r.text) for r in df.collect()])
    assert checked(rows) == packing.lower_bound(np.bincount([r.length for r in rows], minlength=1025), 1024)
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_sequences_hold_the_ids(spark):
    df = cases.docs(spark).where("doc_id < 12")
    placed = packing.pack(packing.pieces(df))
    got = {r.sequence_id: bytes(r.ids) for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert got[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def test_exchange_saves_bins(spark):
    lengths = [600] * 64 + [424] * 64 + [300, 300, 424] * 30
    df = spark.createDataFrame([(x, "own") for x in lengths], "length long, item string")
    apart = checked(packing.pack(df, partition=8, rounds=0).collect())
    met = packing.pack(df, partition=8, rounds=4)
    assert met.columns == ["length", "item", "sequence_id", "offset"] and met.count() == len(lengths)
    assert packing.lower_bound(np.bincount(lengths, minlength=1025), 1024) <= checked(met.collect()) < apart


def fewest(lengths, capacity):
    """The true least number of bins, by trying all."""
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=7))
def test_bound_never_exceeds_the_optimum(lengths):
    bound = packing.lower_bound(np.bincount(lengths, minlength=25), 24)
    bins, offsets = packing.best_fit(np.array(lengths, np.int64), 24)
    assert bound <= fewest(sorted(lengths, reverse=True), 24) <= (bins.max() + 1 if len(bins) else 0)


def test_clashing_columns(spark):
    df = cases.docs(spark, extra=True)
    for name in ("start", "ids", "ids_crc32", "sequence_id", "offset", "bin", "part"):
        df = df.withColumn(name, lit("own"))
    piece = lambda rows: sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str)
    got = packing.pack_documents(df).collect()
    assert piece(got) == piece(packing.pack_documents(cases.docs(spark)).collect())
    checked(got)
