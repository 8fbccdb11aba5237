import numpy as np
import public_tokenizers
from pyspark.sql.functions import lit as cases_lit
from tokenizers import Tokenizer

from tessera.llm import token_counts
from tests.llm import cases

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def want(df):
    out = []
    for r in df.collect():
        t = r.text or ""
        out.append((r.doc_id, len(t.encode()), len(LIBRARY.encode(t, add_special_tokens=False).ids)))
    return sorted(out, key=str)


def test_counts_are_the_librarys_at_any_chunking(spark):
    more = [
        (100, cases.prose(7, 2000) + " " + "y" * 900 + "é" * 700 + " " + cases.prose(8, 500)), (101, ("x́ " * 700) + "<|endoftext|>" * 90 + " end"),
        (102, "z" * 4000), (103, "　".join(cases.prose(9, 900).split(" "))), (104, "\x1c \x1d word " * 300), (105, "x" * 300 + " "), (106, " " * 3000 + "a"),
        (107, "the same word " * 900), (107, "the same word " * 900),
    ]
    df = cases.docs(spark).select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    for long_bytes, size, overlap in ((200, 64, 16), (1000, 300, 100), (token_counts.LONG_BYTES, token_counts.CHUNK, token_counts.OVERLAP)):
        got = token_counts.token_counts(df, long_bytes=long_bytes, size=size, overlap=overlap)
        assert sorted(map(tuple, got.collect()), key=str) == want(df)
    assert token_counts.token_counts(df.limit(0)).count() == 0


def test_copies_are_encoded_once(spark):
    text = cases.prose(3, 9000)
    for n in (1, 20):
        df = spark.createDataFrame([("k", text)] * n, "key string, text string").repartition(3)
        assert token_counts.chunks(df, 1 << 14, 1 << 8, 4).count() == -(-(len(text) - 256) // (1 << 14))


def test_boundaries_are_those_of_the_whole_text():
    text = cases.prose(5, 400) + " <|endoftext|> é́ ｆｕｌｌ　width " + cases.prose(6, 400)
    whole = LIBRARY.encode(text, add_special_tokens=False)
    for start, end in ((0, 900), (333, 1500), (700, len(text))):
        found = LIBRARY.encode(text[start:end], add_special_tokens=False)
        told = token_counts.boundaries(text[start:end], np.array(found.ids), np.array(found.offsets), 0, end - start)
        starts = [a for a, _ in whole.offsets]
        assert told and {x["pos"] + start for x in told} <= set(starts)
        # From the first boundary on, the tokens of the chunk are those of the whole text.
        first = told[0]
        at = starts.index(first["pos"] + start)
        until = told[-1]["before"] - first["before"]
        assert found.ids[first["before"] : told[-1]["before"]] == whole.ids[at : at + until]


def test_clashing_names(spark):
    df = cases.docs(spark, extra=True).withColumn("key", cases_lit("own")).withColumn("n_bytes", cases_lit("own"))
    assert sorted(map(tuple, token_counts.token_counts(df, long_bytes=1000, size=300, overlap=100).collect()), key=str) == want(df)
