import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import licenses
from tests.llm import cases


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(text):
    words = plain_words(text)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


EXTRA = [
    "MIT license mit LICENSE, the mit-license; summit license mit licenses", "Apache License Version 2 0 cc-by-nc cc by nc cc by", "mit", "license",
    "This work is licensed under the GNU General Public License, version 3.", cases.prose(4, 300) + " Released, kindly, under the MIT License. " + cases.prose(5, 300),
    "Permission is hereby granted, free of charge, to any dear person obtaining a copy of this software and associated docs files, to deal in the Software without restriction",
    ("This work is licensed under the GNU General Public License, version 3. " + cases.prose(6, 30)) * 30, "licensed under the general license of this work", "mit\x00license",
]


def test_base_and_labels(spark):
    df = cases.docs(spark).select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(EXTRA)], "doc_id long, text string"))
    want = sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=str)
    got = licenses.license_scan(df).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    labels = {r.id: r.labels for r in got}
    assert labels[104] == "gpl-3" and labels[107] == "gpl-3" and labels[105] == "mit" and labels[106] == "mit" and labels[108] == "" and labels[20] == "apache-2,mit"
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.license_scan(df.limit(0)).count() == 0


def common(a, b):
    """Longest common subsequence, by the textbook's table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def brute_labels(text):
    """All labels and the score, over all templates and all spans."""
    words, found = plain_words(text), {}
    triples = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    for label, template in licenses.TEMPLATES:
        t = plain_words(template)
        own = triples(t)
        if sum(own.count(g) for g in triples(words)) < licenses.LEAST_VOTES * len(own) or not set(own) & set(triples(words)):
            continue
        score = max(common(t, words[i : i + licenses.SPAN * len(t)]) for i in range(len(words))) / len(t)
        if score >= licenses.LEAST_SHARE:
            found[label] = max(score, found.get(label, 0))
    base = brute(text)
    labels = {*found, *filter(None, base[-1].split(","))}
    return ",".join(sorted(labels)), max([1.0 if base[1] else 0.0, *found.values()])


def spoiled(template, every, put_in, left_out, seed):
    r, words = random.Random(seed), template.split()
    out = []
    for i, w in enumerate(words):
        if r.random() >= left_out:
            out.append(w)
        if every and i % every == every - 1:
            out += [f"odd{r.randrange(50)}" for _ in range(put_in)]
    return cases.prose(seed, 12) + " " + " ".join(out) + ". " + cases.prose(seed + 1, 9)


def test_labels_and_score_against_all_spans(spark):
    texts = [spoiled(t, every, put_in, left_out, 7 * i + every) for i, (_, t) in enumerate(licenses.TEMPLATES) for every, put_in, left_out in ((0, 0, 0), (5, 4, 0), (0, 0, 0.12), (6, 2, 0.05), (4, 9, 0))]
    texts += EXTRA[:7] + ["Permission is hereby granted, free of charge, to any person " + cases.prose(3, 200) + " obtaining a copy of this software and associated documentation files"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.labels, r.score) for r in licenses.license_scan(df).collect()}
    assert got == {i: brute_labels(t) for i, t in enumerate(texts)}
    assert len({x for x, _ in got.values()}) > 10 and any(x == "" for x, _ in got.values())


def test_copies_have_no_say(spark):
    # The opening in pieces of five words: each piece by itself has too few votes.
    near = spoiled(dict(licenses.TEMPLATES)["bsd"], 5, 4, 0, 1)
    far = spoiled(dict(licenses.TEMPLATES)["bsd"], 3, 7, 0, 1)
    for n in (1, 2, 100):
        df = spark.createDataFrame([(i, t) for i in range(n) for t in (near, far)], "doc_id long, text string")
        got = licenses.license_scan(df.withColumn("key", df.doc_id).withColumn("hits", df.doc_id)).collect()
        assert sorted((r.labels, r.score) for r in got) == [("", 0.0)] * n + [("bsd", 1.0)] * n


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAb9 -é"), st.characters(exclude_categories=["Cs"]))), max_size=5))
def test_hashes_tell_words_apart_wherever_they_stand(texts):
    h = licenses.Hashed(pa.array(texts, pa.string()))
    split = [plain_words(t) for t in texts]
    assert np.diff(h.bounds).tolist() == list(map(len, split))
    flat = [w for t in split for w in t]
    by_word = {}
    for w, x in zip(flat, h.hashes.tolist()):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)
    for w, x in by_word.items():
        assert licenses.hashes([w.encode()]).tolist() == [x]
