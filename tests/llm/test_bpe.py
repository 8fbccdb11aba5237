import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.functions import lit as cases_lit

from tessera.llm import bpe
from tessera.llm import columns as C
from tessera.llm import tokenizing
from tests.llm import cases
from tests.llm.test_tokenizing import ODD

RANKS = tokenizing.load_ranks(public_tokenizers.path(bpe.RANK_FILE))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_query_matches_the_library(spark, tmp_path):
    df = cases.docs(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for r in df.collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.op5_byte_bpe(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
    empty = df.limit(0).select(bpe.encode("text").alias("ids"))
    assert empty.select(bpe.decode("ids")).count() == 0


def test_long_pieces_and_odd_texts():
    r = random.Random(1)
    texts = ODD + ["a" * 5001, "".join(r.choice("abct") for _ in range(4000)), "".join(r.choice("ab ") for _ in range(3000)), "é" * 400, "=" * 1000, " " * 700]
    own = bpe.encoder(public_tokenizers.path(bpe.RANK_FILE))
    ids, starts = own.encode(C.filled(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [LIBRARY.encode_ordinary(t) for t in texts]
    text, at = own.decode(ids, starts)
    assert [text[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == texts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n'sSteinr"), st.characters(exclude_categories=["Cs"]))), max_size=5))
def test_any_text(texts):
    own = bpe.encoder(public_tokenizers.path(bpe.RANK_FILE))
    ids, starts = own.encode(C.filled(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [LIBRARY.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.integers(2, 400))
def test_long_pieces_by_any_ranks(seed, n):
    # Ranks in any order, so that merges make pairs of lower rank, as trained ones seldom do.
    r = random.Random(seed)
    letters = "abc"[: r.randint(1, 3)]
    joins = {"".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(r.randint(1, 40))}
    order = list(range(256, 256 + len(joins)))
    r.shuffle(order)
    ranks = {bytes([b]): b for b in range(256)} | dict(zip((j.encode() for j in sorted(joins)), order))
    library = tiktoken.Encoding("any", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    text = "".join(r.choice(letters) for _ in range(n))
    if text.encode() in ranks:
        return
    ids = bpe.merge_long(np.frombuffer(text.encode(), np.uint8).astype(np.int32), bpe.PairTable(ranks))
    assert ids.tolist() == library.encode_ordinary(text)


def test_clashing_columns(spark, tmp_path):
    plain, extra = str(tmp_path / "plain"), str(tmp_path / "extra")
    cases.docs(spark).write.parquet(f"{plain}/documents.parquet")
    df = cases.docs(spark, extra=True)
    for name in ("ids", "n_tokens", "ids_sha256", "decoded"):
        df = df.withColumn(name, cases_lit("own"))
    df.write.parquet(f"{extra}/documents.parquet")
    assert sorted(map(tuple, bpe.op5_byte_bpe(spark, extra).collect()), key=str) == sorted(map(tuple, bpe.op5_byte_bpe(spark, plain).collect()), key=str)
