from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import perplexity as lm
from lodestar.llm.gru import GatedModel


def small(seed=0):
    return GatedModel(np.arange(1, 13)[::-1].astype(float), members=3, emb=5, hidden=6, seed=seed)


def test_gradients_match_differences():
    r = np.random.default_rng(1)
    m = small()
    for k in m.NAMES:
        setattr(m, k, (getattr(m, k) + r.standard_normal(getattr(m, k).shape) * 0.3).astype(np.float64))
    x, y = r.integers(0, 12, (7, 3)), r.integers(0, 12, (7, 3))
    first = r.random((7, 3)) < 0.2
    h = np.zeros((3, 6))
    g, _, _ = m.gradients(x, y, first, h)
    for k in m.NAMES:
        a = getattr(m, k)
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in a.shape)
            keep = a[at]
            a[at] = keep + 1e-3
            up = m.gradients(x, y, first, h)[2]
            a[at] = keep - 1e-3
            down = m.gradients(x, y, first, h)[2]
            a[at] = keep
            assert abs((up - down) / 2e-3 - g[k][at]) < 1e-3 * max(1, abs(g[k][at])), k


def test_scores_do_not_depend_on_lanes_or_windows_and_sum_to_one():
    r = np.random.default_rng(2)
    m = small()
    m.wc = r.standard_normal(m.wc.shape).astype(np.float32)
    m.ww = r.standard_normal(m.ww.shape).astype(np.float32)
    texts = [np.append(r.integers(0, 11, n), 11) for n in [0, 1, 5, 40, 200, 3, 3, 64, 63]]
    one = [m.score([t], 11, 1, 1000)[0] for t in texts]
    for lanes, window in ((1, 4), (3, 5), (256, 64)):
        assert np.allclose(m.score(texts, 11, lanes, window), one, rtol=1e-4)
    states = r.standard_normal((1, 6)).astype(np.float32)
    assert np.exp(m.log_probabilities(np.repeat(states, 12, 0), np.arange(12))).sum() == pytest.approx(1, abs=1e-5)


def test_network_learns_order():
    stream = [np.array([i % 5 for i in range(s, s + 60)] + [11]) for s in range(200)]
    m = small().fit(stream, 11, lanes=8, window=16, epochs=6, rate=0.02)
    assert m.score(stream[:1], 11)[0] / 61 > -0.4


@pytest.mark.parametrize("head", [10, 200_000])
def test_base_scores_and_table(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    r = random.Random(4)
    lang = [[f"{c}{i}" for i in range(40)] for c in "abÉ"]
    texts = [" ".join(r.choices(lang[i % 3], k=r.randrange(1, 80))) for i in range(240)] + [None, "", "never seen zz Yy yy", "A1 a1"]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "a1", 7), (3, texts[3], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    training = docs.where(~lm.held_out("doc_id", 10))
    counts = lm.word_counts(training)
    scorer = lm.fit(training, counts)
    got = lm.scored(docs, scorer, counts).collect()
    low = lambda t: (t or "").encode().lower().split()
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    learn = [t for i, t, _ in rows if crc(i)]
    c = Counter(w for t in learn for w in low(t))
    n, v = sum(c.values()) + len(learn), len(c) + 1
    want = Counter()
    for i, t, _ in rows:
        w = low(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((len(learn) + 0.1) / (n + 0.1 * (v + 1)))
        want[(i, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 6))] += 1
    assert Counter((g["id"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 6)) for g in got) == want
    assert all(g["score"] < 0 for g in got)
    held = [g for g in got if g["id"] is not None and crc(g["id"]) == 0]
    assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held)
    # probabilities of all training words and one unseen word of each shape after an empty context sum to one
    s = scorer
    first = s.model.step((s.model.emb[[s.end]] @ s.model.wx + s.model.bx), np.zeros((1, s.model.hidden), np.float32))[0]
    p = np.exp(s.model.log_probabilities(np.repeat(first, lm.VOCABULARY, 0), np.arange(lm.VOCABULARY)))
    total = p[s.end] + sum(p[s.id[w]] for w in s.id)
    for k in range(1, lm.SHAPES + 1):
        inside = [10 ** (math.log10(c[w] + 0.1) - s.shape_log[k]) for w in c if w not in s.id and lm.shape(w) == k]
        total += p[s.shape_id[k]] * (sum(inside) + 10 ** (-1 - s.shape_log[k]))
    assert total == pytest.approx(1 - p[1 + lm.SHAPES + len(s.id) :].sum(), abs=1e-3)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    counts = lm.word_counts(docs)
    scorer = lm.fit(docs, counts)
    assert lm.scored(docs, scorer, counts).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm.scored(one, scorer, counts).first()["n_known"] == 0


def test_every_token_of_a_stream_is_stepped_over(monkeypatch):
    model = GatedModel(np.ones(64), members=8, emb=4, hidden=4)
    seen = []
    own = GatedModel.gradients
    monkeypatch.setattr(GatedModel, "gradients", lambda self, x, y, s, h: (seen.append(y.ravel()), own(self, x, y, s, h))[1])
    stream = np.arange(613) % 64
    model.descend(np.roll(stream, 1), stream, np.zeros(613, bool), lanes=7, window=16, epochs=1, rate=0.01)
    assert 613 <= sum(map(len, seen)) < 613 + 7 and (np.bincount(np.concatenate(seen), minlength=64) >= np.bincount(stream, minlength=64)).all()


def test_stretches_come_from_all_of_a_long_text():
    class Plain:
        end = -1

        def ids(self, words):
            return [int(w) for w in words]

    text = [str(i).encode() for i in range(200_000)]
    got = list(lm.stretches(text, 5, Plain()))
    at = np.array([y[0] for _, y in got])
    assert abs(len(got) * lm.SHARE * lm.STRETCH / len(text) - 1) < 0.2 and at.max() > 190_000
    assert all((x[1:] == y[:-1]).all() and len(x) == len(y) == lm.STRETCH and x[0] == y[0] - 1 for x, y in got)
    for n in (0, 3, 127, 128, 129):  # every token of a text, and its end, is in one stretch
        whole = [np.concatenate([y for seed in range(400) for _, y in lm.stretches(text[:n], seed, Plain())]).tolist()]
        assert set(whole[0]) == {*range(n), -1}


def test_learning_from_all_rows_raises_the_probability(spark):
    r = np.random.default_rng(3)
    cycle = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(cycle[(k + s) % 40] for k in range(400))) for i, s in enumerate(r.integers(0, 40, 120).tolist())]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string").repartition(3)
    counts = lm.word_counts(docs)
    scorer = lm.fit(docs.where("doc_id < 2"), counts)
    before = scorer.model.parameters().copy()
    mean = lambda: lm.scored(docs, scorer, counts).agg({"score": "sum"}).first()[0]
    start = mean()
    lm.learned(docs, scorer)
    assert mean() > start and not np.array_equal(before, scorer.model.parameters())
    lm.learned(docs.limit(0), scorer)


def test_every_token_of_the_training_texts_is_learned_from(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k % 7}" for k in range(n))) for i, n in enumerate((0, 3, 128, 1000, 257))], "doc_id long, text string").repartition(1)
    scorer = lm.fit(docs, lm.word_counts(docs))
    whole = [s for t in (r["text"].encode().split() for r in docs.collect()) for s in lm.stretches(t, 1, scorer, share=1)]
    assert sum(len(y) for _, y in whole) == sum(n + 1 for n in (0, 3, 128, 1000, 257))
    assert all(len(y) <= lm.STRETCH + 1 for _, y in whole)
    taken = []
    lm.learned(docs, scorer, watch=taken.append)
    assert taken == [1388 + 5]


def test_words_are_looked_up_once_for_learning_and_scoring(spark, monkeypatch):
    r = random.Random(8)
    texts = [" ".join(r.choices([f"w{i}" for i in range(90)], k=n)) for n in (0, 1, 127, 128, 129, 700, 5)] + [None, "W1 never seen seen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    monkeypatch.setattr(lm, "HEAD", 60)
    counts = lm.word_counts(docs.where("doc_id < 8"))
    scorer = lm.fit(docs, counts)
    table = lm.read(docs, scorer)
    for row in table.collect():
        words = (texts[row["id"]] or "").lower().encode().split()
        assert np.frombuffer(row["tokens"], np.uint16).tolist() == [*scorer.ids(words), scorer.end]
        assert {bytes(t["word"]): t["tf"] for t in row["tail"]} == {w: n for w, n in Counter(words).items() if w not in scorer.place}
    apart = sorted(map(tuple, lm.scored(docs, scorer, counts).collect()))
    read = sorted(map(tuple, lm.scored(docs, scorer, counts, texts=table).collect()))
    assert np.allclose(np.array(apart), np.array(read), rtol=1e-6) and [a[0] for a in apart] == list(range(9))
    start = scorer.model
    ends = []
    for given in (None, table):
        scorer.model = start
        ends.append(lm.learned(docs, scorer, texts=given).model.parameters())
    assert np.array_equal(*ends) and not np.array_equal(ends[0], start.parameters())


def test_probabilities_over_more_rows_than_a_block():
    r = np.random.default_rng(5)
    m = small()
    m.ww, m.wc = (r.standard_normal(a.shape).astype(np.float32) for a in (m.ww, m.wc))
    states, target = r.standard_normal((5000, 6)).astype(np.float32), r.choice(12, 5000, p=[0.7, *[0.3 / 11] * 11])
    soft = lambda x: x - np.log(np.exp(x).sum(1, keepdims=True))
    at, c = np.arange(5000), target // 3
    want = soft(states @ m.wc + m.bc)[at, c] + soft(np.einsum("nh,nhm->nm", states, m.ww[c]) + m.bw[c])[at, target % 3]
    assert np.allclose(m.log_probabilities(states, target), want, atol=1e-4)


ODD = ["", None, "  A b\x0b\x0cÉé\xa0x \x1c y\u2003z ", " ", "q", "a\n\tb A\r\nb", "\x00 x\x85y", "z" * 70_000, "never zz a ", "a " * 500]


@pytest.mark.parametrize("cut", [slice(None), slice(1, 2), slice(3, 4), slice(2, 9), slice(0, 0)])
def test_only_different_words_are_looked_up(monkeypatch, cut):
    low = [(t or "").encode().lower().split() for t in ODD]
    c = Counter(w for t in low for w in t if w != b"never")
    head = sorted(c.items(), key=lambda x: (-x[1], x[0]))[:-3]
    shapes: dict = {}
    for w, n in c.items():
        shapes[lm.shape(w)] = tuple(np.add(shapes.get(lm.shape(w), (0, 0)), (n, 1)))
    monkeypatch.setattr(lm, "VOCABULARY", 128)
    monkeypatch.setattr(lm, "SHAPES", 63)
    s = lm.Scorer(head, shapes, len(ODD), sum(c.values()), len(c), [])
    asked, find = [], lm.pc.index_in
    monkeypatch.setattr(lm.pc, "index_in", lambda words, **k: (asked.extend(words.to_pylist()), find(words, **k))[1])
    got = {k: v.to_pylist() for k, v in s.read(pa.array(ODD, pa.string())[cut]).items()}
    words = low[cut]
    assert sorted(asked) == sorted({w for t in words for w in t})
    assert got["n_tokens"] == [len(t) + 1 for t in words]
    assert got["n_known"] == [sum(w in dict(head) for w in t) + 1 for t in words]
    assert [np.frombuffer(t, np.uint16).tolist() for t in got["tokens"]] == [[*s.ids(t), s.end] for t in words]
    assert [Counter({e["word"]: e["tf"] for e in t}) for t in got["tail"]] == [Counter(w for w in t if w not in dict(head)) for t in words]
    assert all(e["shape_log"] == s.shape_log[lm.shape(e["word"])] for t in got["tail"] for e in t)
    base = lambda t: s.base_end + sum(math.log10(dict(head)[w] + 0.1) - s.base_log for w in t if w in dict(head))
    assert np.allclose(got["base"], [base(t) for t in words])


@pytest.mark.parametrize("held", [1, 4, 300_000])
def test_counts_of_a_task_are_whole_however_few_it_holds(monkeypatch, held):
    monkeypatch.setattr(lm, "HELD", held)
    total: Counter = Counter()
    batches = [pa.RecordBatch.from_arrays([pa.array(ODD[i : i + 3], pa.string())], ["text"]) for i in range(0, len(ODD), 3)]
    for b in lm._count(iter(batches)):
        for w, n in zip(b["word"].to_pylist(), b["n"].to_pylist()):
            total[w] += n
    assert total == Counter(w for t in ODD for w in (t or "").encode().lower().split())
    assert list(lm._count(iter([]))) == []


def test_shapes_of_words_of_any_bytes():
    words = [bytes([a]) for a in range(256)] + [bytes([a, b]) for a in range(0, 256, 5) for b in range(0, 256, 3)] + [b"long\xff\x00", b"word"]
    array = pa.array(words, pa.binary())
    assert lm.shapes_of(array).tolist() == [lm.shape(w) for w in words]
    assert lm.shapes_of(array[3:9]).tolist() == [lm.shape(w) for w in words[3:9]] and len(lm.shapes_of(array[:0])) == 0


def test_logits_beyond_the_range_of_exponentials_and_windows_of_one_step():
    r = np.random.default_rng(7)
    m = small()
    for k in m.NAMES:
        setattr(m, k, (getattr(m, k) + r.standard_normal(getattr(m, k).shape) * 0.3).astype(np.float32))
    far = small().with_parameters(m.parameters())
    far.bc, far.bw = far.bc + np.float32(200), far.bw - np.float32(200)  # the same probabilities
    assert m.outputs()[1] and not far.outputs()[1]
    for steps in (1, 5):
        x, y, first = r.integers(0, 12, (steps, 40)), r.integers(0, 12, (steps, 40)), r.random((steps, 40)) < 0.3
        h = np.tanh(r.standard_normal((40, 6))).astype(np.float32)
        g, last, loss = m.gradients(x, y, first, h)
        f, same, lost = far.gradients(x, y, first, h)
        assert np.array_equal(last, same) and abs(loss - lost) < 1e-4
        assert all(np.allclose(g[k], f[k], atol=1e-4) and g[k].any() for k in m.NAMES)
        # the window's mean loss is that of its targets one by one
        states = np.where(first[0][:, None], 0, h)
        states = m.step(m.emb[x[0]] @ m.wx + m.bx, states)[0]
        if steps == 1:
            assert loss == pytest.approx(-m.log_probabilities(states, y[0]).mean(), abs=1e-5)
        assert np.allclose(m.log_probabilities(states, y[0]), far.log_probabilities(states, y[0]), atol=1e-4)
        assert np.isfinite(m.log_probabilities(states * 1e4, y[0])).all()  # no states of this network, but in range all the same


def test_u_gradient_of_one_step_comes_from_the_state_before():
    r = np.random.default_rng(9)
    m = small()
    for k in m.NAMES:
        setattr(m, k, (getattr(m, k) + r.standard_normal(getattr(m, k).shape) * 0.3).astype(np.float64))
    x, y, first = r.integers(0, 12, (1, 3)), r.integers(0, 12, (1, 3)), np.zeros((1, 3), bool)
    h = np.tanh(r.standard_normal((3, 6)))
    u = np.array(m.gradients(x, y, first, h)[0]["u"])
    for at in ((0, 0), (3, 8), (5, 17)):
        keep, losses = m.u[at], []
        for to in (1e-3, -1e-3):
            m.u[at] = keep + to
            losses.append(m.gradients(x, y, first, h)[2])
        m.u[at] = keep
        assert abs((losses[0] - losses[1]) / 2e-3 - u[at]) < 1e-3
