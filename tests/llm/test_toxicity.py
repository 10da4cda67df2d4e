from __future__ import annotations

import random
import zlib

import numpy as np

from lodestar.llm import toxicity as tox


def sample(n=120, seed=1):
    r = random.Random(seed)
    plain = [f"word{i}x" for i in range(60)]
    bad = ["slurone", "slurtwo", "rudeword"]
    texts, labels = [], []
    for i in range(n):
        words = r.choices(plain, k=40)
        if i % 3 == 0:
            words[:3] = [w + r.choice(["", "ish", "es"]) for w in r.choices(bad, k=3)]
        r.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_nearest_examples_are_exact():
    texts, labels = sample(400)
    m = tox.Examples(texts, labels, list(range(400)), (1.0, 1.0))
    dense = np.zeros((400, len(m.vocabulary)))
    for i, old in enumerate(m.ids):
        t, w = m.vector(tox.terms_of(texts[old]))
        dense[i, t] = w
    for text in sample(40, 7)[0] + ["slurone rudeword", "nothing"]:
        t, w = m.vector(tox.terms_of(text))
        if not len(t):
            continue
        q = np.zeros(len(m.vocabulary))
        q[t] = w
        cos = dense @ q
        want = np.lexsort((np.arange(400), -np.round(cos, 12)))[:10]
        want = want[cos[want] > 0]
        rows, got = m.nearest(t, w, 10)
        assert rows.tolist() == want.tolist() and np.allclose(got, cos[want])


def test_learns_and_scores_every_row(spark):
    texts, labels = sample(300)
    rows = [(i, t, "e") for i, t in enumerate(texts)] + [(900, None, None), (901, "", "x"), (None, "slurone slurtwo", "x"), (5, texts[5], "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, evidence string")
    lab = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = tox.train(docs, lab)
    out = tox.scored(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 300 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == labels[r["doc_id"]] for r in held]) > 0.95
    assert all(e["cosine"] > 0 for r in out for e in r["evidence"])
    assert all(zlib.crc32(str(e["doc_id"]).encode()) % 5 for r in out for e in r["evidence"])
    assert {r["score"] for r in tox.scored(docs, tox.train(docs, lab.limit(0))).collect()} == {0.5}
    assert tox.scored(docs.limit(0), model).count() == 0
