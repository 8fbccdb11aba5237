import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import divergence
from tests.llm import cases


def brute(rows, least, top=50):
    """``rows``: text, lang, source."""
    rows = [tuple(x or "" for x in r) for r in rows]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    words = [[low(w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)] for t, _, _ in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for (_, lang, source), found in zip(rows, words):
        docs[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            own = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", own, top)):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(seed, n=400):
    r = random.Random(seed)
    vocabulary = ["the", "The", "réel", "ÉTÉ", "été", "x", "日本", "ab1cd", "it's"] + [f"w{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}" for i in range(60)]
    rows = []
    for i in range(n):
        lang, source = r.choice(["en", "fr", None, ""]), r.choice(["a", "b", "é", None, "", "z"])
        text = " ".join(r.choice(vocabulary[: 1 + (len((lang or "") + 2 * (source or "")) % 7 + 9) * 4] if r.random() < 0.7 else vocabulary) for _ in range(r.randint(0, 40)))
        rows.append((i, text if r.random() > 0.05 else None, lang, source, 0))
    rows += [(1000 + i, rows[3][1], "en", "hot", 0) for i in range(200)]  # copies of one text
    rows += [(2000, "123 --", "no terms", "only", 0), (2001, "rare words", "lone", "one", 0), (2002, "rare words", "lone", "two", 0), (2003, "x" * 100_000 + " the" * 50_000, "en", "a", 0)]
    return rows


def check(spark, rows, least):
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA).repartition(5), least)
    assert sorted(map(tuple, got.collect())) == brute([r[1:4] for r in rows], least)


def test_awkward_documents(spark):
    rows = made(1)
    check(spark, rows, 30)
    check(spark, rows, 1)
    check(spark, rows[:3], 30)  # nothing is kept


def test_a_crowded_sketch_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "WIDEST", 64)
    check(spark, made(2), 30)


def test_narrow_steps(spark, monkeypatch):
    monkeypatch.setattr(divergence, "STEP_BYTES", 300)
    check(spark, made(3), 30)


def test_the_sketch_drops_rare_terms_and_never_underestimates():
    r = np.random.default_rng(5)
    docs = np.concatenate([np.full(500, 30), r.integers(1, 10, 20_000)])
    hashes = divergence.C.mixed(np.arange(len(docs), dtype=np.uint64))
    width = 1 << 16
    place = divergence.cells(hashes, np.full(len(docs), 7, np.uint64), width)
    sketch = np.bincount(place.ravel(), np.tile(docs, divergence.DEPTH), divergence.DEPTH * width)
    passed = (sketch[place] >= 30).all(axis=0)
    assert passed[docs >= 30].all() and passed[docs < 30].mean() < 0.01


def test_terms_of_texts():
    different, doc, term, n = divergence.terms(pa.array(["ab Ab", "", "ab", "cÉ-c 1 c"]))
    assert sorted((int(d), different[int(t)].as_py(), int(k)) for d, t, k in zip(doc, term, n)) == [(0, "ab", 2), (2, "ab", 1), (3, "c", 2), (3, "cÉ", 1)]


def test_clashing_columns_and_an_empty_table(spark):
    rows = made(4, 120)
    df = spark.createDataFrame(rows, SCHEMA)
    plain = sorted(map(tuple, divergence.divergence(df, 5).collect()))
    for name in ("term", "n", "cell", "rank", "value", "item", "part", "docs", "total", "kept", "p", "q", "lang_n"):
        df = df.withColumn(name, F.lit("own"))
    assert sorted(map(tuple, divergence.divergence(df, 5).collect())) == plain
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    assert divergence.divergence(cases.docs(spark, extra=True)).count() > 0


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(map(tuple, divergence.op11_source_divergence(spark, sf).collect())) == sorted(con.execute(divergence.OP11_SQL).fetchall())
