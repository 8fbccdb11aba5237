import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import language
from tests.llm import cases

SCHEMA = "doc_id long, text string, lang string"


def brute_grams(text):
    low = text.lower()
    words, word = [], ""
    for c in low + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    return {f"\0{w}\0"[i : i + 3] for w in words for i in range(len(w))}


def packed(gram):
    return sum(ord(c) << s for c, s in zip(gram, (42, 21, 0)))


AWKWARD = ["", "a", "The cat's Ωmega 12x3", "日本語 テキスト", "퟿ ẞtraße İx ǅ", " - ", "no\nlines\n", "ét", "x" * 1000, "😀 wörd😀s"]


def test_grams():
    text, gram = language.grams(pa.array(AWKWARD))
    got = [set() for _ in AWKWARD]
    for t, g in zip(text.tolist(), gram.tolist()):
        assert g not in got[t]
        got[t].add(g)
    assert got == [{packed(g) for g in brute_grams(t)} for t in AWKWARD]
    assert len(language.grams(pa.array([], pa.string()))[0]) == 0


def brute_model(rows):
    """The languages' grams without any filter: ``rows`` are text and language."""
    docs = {}
    for text, lang in rows:
        if lang is not None:
            for g in brute_grams(text or ""):
                docs.setdefault(lang, {}).setdefault(g, 0)
                docs[lang][g] += 1
    share = {lang: {g: n / sum(d.values()) for g, n in d.items()} for lang, d in docs.items()}
    most = {}
    for d in share.values():
        for g, s in d.items():
            most[g] = max(most.get(g, 0), s)
    return {lang: {g for g, s in d.items() if s >= language.LEAST_SHARE and s >= language.NEAR * most[g]} for lang, d in share.items()}


def test_filters_hold_what_brute_force_holds_and_predict_as_it_does(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    model = brute_model(rows)
    filters = language.learn(docs.where(~language.is_held_out(docs["doc_id"])))
    assert sorted(filters.languages) == sorted(model)
    every = sorted({packed(g) for held in model.values() for g in held})
    masks = filters.holders(np.array(every, np.int64))[0]
    for i, lang in enumerate(filters.languages):
        named = {g for g, m in zip(every, masks.tolist()) if m >> i & 1}
        own = {packed(g) for g in model[lang]}
        assert own <= named and len(named - own) <= 2 + len(every) * 3 * filters.fill()[i] ** language.HASHES
    got = {r.doc_id: r for r in language.op12_language_id(spark, sf).collect()}
    for r in docs.collect():
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= got[r.doc_id].score <= 1
        counts = {lang: len(brute_grams(r.text) & held) for lang, held in model.items()}
        most = max(counts.values())
        if sorted(counts.values())[-2] + 2 < most:  # not within what a false positive could turn
            assert counts[got[r.doc_id].lang_pred] == most


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.97), ("sf0.1", 0.98)])
def test_held_out_accuracy(spark, sf, least):
    root = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "lang")
    rows = language.op12_language_id(spark, root).where("held_out").join(labels, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert rows[0] >= least


def test_awkward_rows(spark):
    docs = cases.docs(spark, extra=True)
    got = language.op12_over(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        text = docs.where(F.col("doc_id").eqNullSafe(r.doc_id)).first().text if r.doc_id is not None else "x"
        assert r.lang_pred == ("en" if any(c.isalpha() for c in text or "") else "und") or r.doc_id is None
    assert {(r.lang_pred, r.score) for r in got if r.lang_pred == "und"} == {("und", 0.0)}
    assert language.op12_over(spark.createDataFrame([], SCHEMA)).count() == 0
    unlabelled = language.op12_over(spark.createDataFrame([(1, "some words", None), (2, None, None)], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)] * 2


def test_many_languages_ties_and_unknown_words(spark, monkeypatch):
    monkeypatch.setattr(language, "FULL_WORDS", 1)
    names = [f"l{i:03}" for i in range(150)]
    word = lambda i: "".join(chr(0x4E00 + (i * 37 + j) % 5000) for j in range(5))
    rows = [(i, f"{word(i)} {word(i)}", name) for i, name in enumerate(names)] + [(1000, word(3), "l003")]
    filters = language.learn(spark.createDataFrame(rows, SCHEMA))
    assert filters.slots == language.SLOTS // 4 and filters.masks.shape[0] == 3
    wrong = filters.fill() ** language.HASHES
    asked = pa.array([word(77), word(149), "ΩΩΩ", ""])
    lang, score = filters.predict(asked, wrong)
    assert lang == ["l077", "l149", "l003", "und"] and score[0] > 0.9 and score[2] < 0.05 and score[3] == 0


def test_repeated_documents_do_not_take_over(spark):
    rows = [(i, "der und die das ist nicht", "de") for i in range(30)] + [(100 + i, f"the and of {'abcdefghijklmnopqrst'[i]}ing", "en") for i in range(20)]
    rows += [(1000 + i, "zzz yyy xxx", "en") for i in range(500)]
    filters = language.learn(spark.createDataFrame(rows, SCHEMA))
    assert filters.predict(pa.array(["und nicht", "the and"]), filters.fill() ** language.HASHES)[0] == ["de", "en"]
