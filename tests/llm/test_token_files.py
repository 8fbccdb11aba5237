import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import token_files
from tests.llm import cases


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=3000))
def test_segment_round_trip(values):
    s = token_files.Segment(token_files.pack(np.array(values, np.uint32), np.array([0, len(values)])))
    assert s.all().tolist() == values
    assert s.at(np.arange(len(values))).tolist() == values


def test_files_hold_the_librarys_ids(spark, tmp_path, monkeypatch):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    (tmp_path / "in").mkdir()
    df = cases.docs(spark).repartition(5)
    df.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    got = sorted(map(tuple, token_files.op7_token_files(spark, str(tmp_path / "in")).collect()), key=lambda r: r[1])
    ids = {(r.doc_id, r.text): library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in df.collect()}
    digest = lambda x: (len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
    assert sorted(((r[0], *r[2:]) for r in got), key=str) == sorted(((r.doc_id, *digest(ids[r.doc_id, r.text])) for r in df.collect()), key=str)
    at, last = 0, None
    for doc_id, start, n, _ in got:
        assert start == at and (last is None or doc_id >= last)
        at, last = at + n, doc_id
    token_files.write_files(df.where("doc_id not in (5)"), str(tmp_path / "x"))
    wanted = [(i, p) for i in (6, 10, 15) for p in (0, 3, 50, -1, 10**6)]
    read = {(r.doc_id, r.place): r.token for r in token_files.tokens_at(spark, str(tmp_path / "x"), spark.createDataFrame(wanted, "doc_id long, place long")).collect()}
    texts = {r.doc_id: ids[r.doc_id, r.text] for r in df.collect()}
    assert read == {(i, p): texts[i][p] for i, p in wanted if 0 <= p < len(texts[i])}
    token_files.write_files(df.limit(0), str(tmp_path / "none"))
    assert token_files.read_files(spark, str(tmp_path / "none")).count() == 0


def test_one_token_opens_one_segment(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_VALUES", 500)
    df = spark.createDataFrame([(i, cases.prose(i, 90)) for i in range(40)], "doc_id long, text string").repartition(3)
    path = str(tmp_path / "x")
    token_files.write_files(df, path)
    segments = spark.read.parquet(path)
    assert segments.count() > 8
    held, payloads = token_files.opened(spark, path, spark.createDataFrame([(17, 5)], "doc_id long, place long"))
    (row,) = payloads.collect()
    assert held.count() == 1 and 17 in segments.where((segments.part == row.part) & (segments.seg == row.seg)).first().doc_ids
    # What is stored is the payload itself.
    stored = b"".join(f.read_bytes() for f in (tmp_path / "x").glob("*.parquet"))
    assert all(bytes(r.payload) in stored for r in segments.select("payload").collect())


def test_clashing_names(spark, tmp_path):
    df = cases.docs(spark, extra=True)
    for name in ("tie", "part", "seg", "ids"):
        df = df.withColumn(name, df.text)
    token_files.write_files(df, str(tmp_path / "x"))
    assert token_files.read_files(spark, str(tmp_path / "x")).count() == df.count()
