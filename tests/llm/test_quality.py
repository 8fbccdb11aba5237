import re

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import quality
from tests.llm import cases


def brute(text, limits=quality.RepetitionLimits()):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    lengths = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j and words[i] == words[j]:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                lengths[i] = max(lengths[i], k)

    def spread(least):
        got = set()
        for i, k in enumerate(lengths):
            if k >= least:
                got |= set(range(i, i + k))
        return len(got)

    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    rep, cov, longest = spread(8), spread(limits.min_repeat), max([k for k in lengths if k >= limits.min_repeat], default=0)
    failed = n < 20 or 100 * rep > 30 * n
    kept = not failed and cov <= limits.max_covered * n and longest <= limits.max_longest
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, cov, longest, failed, kept)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "base_failed", "kept"]


def test_matches_brute_force_on_awkward_texts(spark):
    df = cases.docs(spark, extra=True)
    got = df.select("text", quality.quality("text").alias("figures")).collect()
    for text, q in got:
        if len(text or "") < 4000:
            assert tuple(q[n] for n in NAMES) == brute(text), text


def test_stage_keeps_columns_and_drops_rejects(spark):
    df = cases.docs(spark, extra=True)
    kept = quality.passing(df)
    assert kept.columns == df.columns
    want = sorted((r.doc_id, r.text) for r in df.collect() if len(r.text or "") < 4000 and brute(r.text)[-1])
    got = sorted((r.doc_id, r.text) for r in kept.collect() if len(r.text or "") < 4000)
    assert got == want
    assert quality.passing(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4))
def test_repeat_lengths(texts):
    codes = np.array([c for t in texts for c in t], np.int64)
    doc = np.array([i for i, t in enumerate(texts) for _ in t], np.int64)
    got = quality.repeat_lengths(codes, doc, 3)
    want = []
    for t in texts:
        for i in range(len(t)):
            best = 0
            for j in range(len(t)):
                k = 0
                while i != j and max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                    k += 1
                best = max(best, k)
            want.append(best if best >= 3 else 0)
    assert got.tolist() == want


def test_sql_agrees(spark, tmp_path):
    df = cases.docs(spark)
    long = cases.prose(50, 130)
    df = df.union(spark.createDataFrame([(900, cases.prose(51, 900) + " " + long + " " + cases.prose(52, 300) + " " + long, "en", "s", 0)], cases.DOCS))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = quality.op1_quality_rules(spark, str(tmp_path))
    want = con.sql(quality.OP1_SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
    assert {r.doc_id: r.kept for r in got.collect()}[900] is False
