from __future__ import annotations

import zlib

import numpy as np

from lodestar.llm import quality as q


def texts(n=40, seed=2):
    r = np.random.default_rng(seed)
    words = ["lorem", "ipsum", "Dolor", "sit", "amet,", "naïve", "42"]
    good = [" ".join(r.choice(words, int(r.integers(1, 300)))).encode() for _ in range(n)]
    bad = [(str(r.choice(words)) + "$$ | ").encode() * int(r.integers(20, 60)) for _ in range(n)]
    return good, bad


def test_scores_do_not_depend_on_batches_or_segments(monkeypatch):
    good, bad = texts()
    long = b" ".join(good * 12)
    assert len(long) > 2 * q.SEGMENT
    model = q.Network()
    batch = [b"", b"x", *good, long, long[: q.SEGMENT - 3], long[: q.SEGMENT * 2 - 40], *bad]
    together = model.score(batch)
    alone = np.array([model.score([t])[0] for t in batch])
    monkeypatch.setattr(q, "SEGMENT", 1 << 24)
    whole = model.score(batch)
    assert np.allclose(together, alone, atol=1e-6) and np.allclose(together, whole, atol=1e-6)


def test_gradient_matches_differences():
    good, bad = texts(4)
    model, data, y = q.Network(), good + bad, np.array([1] * 4 + [0] * 4, np.float32)
    grad = model.gradient(data, y)

    def loss():
        rows, halves = q.laid_out(data)
        p = model.probability(model.pooled(model.halves(rows, halves).max(1), halves))
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))

    for name, at in (("w", (5, 3)), ("w", (60, 7)), ("b", (2,)), ("v", (1,)), ("v", (20,))):
        value = getattr(model, name)
        keep, eps = value[at], 1e-2
        value[at] = keep + eps
        up = loss()
        value[at] = keep - eps
        down = loss()
        value[at] = keep
        assert abs((up - down) / (2 * eps) - grad[name][at]) < 2e-2 * max(0.1, abs(grad[name][at]))


def test_learns_and_scores_every_row(spark):
    good, bad = texts(60)
    rows = [(i, t.decode(), "s") for i, t in enumerate(good + bad)] + [(500, None, "s"), (501, "", None), (None, "x", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = q.train(docs, labels)
    out = {r["doc_id"]: r["score"] for r in q.scored(docs, model).collect()}
    assert len(out) == 123 and all(0 <= s <= 1 for s in out.values())
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.5) == (i < 60) for i in held]) > 0.9
    none = q.scored(docs, q.train(docs, labels.limit(0)))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert q.scored(docs.limit(0), model).count() == 0
