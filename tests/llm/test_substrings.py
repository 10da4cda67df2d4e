from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import substrings as sub
from lodestar.llm.suffixsort import SHALLOW, BlindTrie, common_prefix, deep_shallow


def naive_prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def strings(seed, n=400):
    r = random.Random(seed)
    base = [r.randbytes(SHALLOW + 30) for _ in range(5)] + [b"\0" * 70, b"ab" * 50]
    out = []
    for _ in range(n):
        s = bytearray(r.choice(base)[: r.randrange(0, 90)])
        if s and r.random() < 0.5:
            s[r.randrange(len(s))] = r.randrange(3)
        out.append(bytes(s))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_deep_shallow_sorts(seed):
    s = strings(seed)
    group = np.array([random.Random(seed + i).randrange(6) for i in range(len(s))])
    order, lcp = deep_shallow(s, group)
    keys = [(group[i], s[i]) for i in order]
    assert keys == sorted(zip(group, s))
    want = [-1 if k == 0 or keys[k][0] != keys[k - 1][0] else naive_prefix(keys[k][1], keys[k - 1][1]) for k in range(len(s))]
    assert lcp.tolist() == want
    ids, shared = BlindTrie(s, list(range(len(s)))).walk()
    assert [s[i] for i in ids] == sorted(s)
    assert all(common_prefix(a, b) == naive_prefix(a, b) for a, b in zip(s, s[1:]))
    assert deep_shallow([], np.zeros(0, np.int64))[0].tolist() == []


def corpus():
    r = random.Random(9)
    words = ["lorem", "ipsum", "dolor", "été", "sit", "世界", "x"]
    say = lambda n: " ".join(r.choices(words, k=n))
    passages = [say(30) for _ in range(4)]
    texts = [None, "", "short", "a" * 300, "ab" * 90, "line\n" * 60]
    for i in range(40):
        t = say(r.randrange(5, 60))
        if i % 2:
            p = r.choice(passages)
            a = r.randrange(len(p) // 3)
            t += p[a : len(p) - r.randrange(len(p) // 3)] + say(r.randrange(20))
        texts.append(t)
    texts += [texts[10]] * 3 + [texts[12][: len(texts[12]) // 2] + "!" + texts[12][len(texts[12]) // 2 :]]
    return texts


def brute(texts, size):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - size + 1):
            if count[d[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        rest = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [10_000, 2])
def test_removed_bytes_match_brute_force(spark, limit):
    texts = corpus()
    docs = spark.createDataFrame([(i % 40, i, t, "q") for i, t in enumerate(texts)], "doc_id long, i int, text string, spans string").repartition(3)
    for size in (48, 100):
        got = sub.digests(sub.with_spans(sub.keyed(docs, "i", "text"), size, limit=limit)).collect()
        assert [tuple(g)[1:5] for g in sorted(got)] == brute(texts, size)


@pytest.mark.parametrize("limit", [10_000, 2])
def test_one_copy_stays(spark, limit):
    texts = [t for t in corpus() if t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    size = 60
    rows = sub.with_spans(sub.keyed(docs, "doc_id", "text"), size, True, limit).collect()
    data = {r["id"]: (r["text"].encode(), r["spans"] or [], r["rid"]) for r in rows}
    first = {}
    for d, _, rid in sorted(data.values(), key=lambda x: x[2]):
        for i in range(len(d) - size + 1):
            first.setdefault(d[i : i + size], (rid, i))
    for d, spans, rid in data.values():
        want = np.zeros(len(d), bool)
        for i in range(len(d) - size + 1):
            if first[d[i : i + size]] != (rid, i):
                want[i : i + size] = True
        got = np.zeros(len(d), bool)
        for s in spans:
            got[s["lo"] : s["hi"]] = True
        assert (got == want).all()


def test_texts_are_cut_on_characters(spark):
    rows = [(1, "é" * 200, "a"), (2, "x" + "é" * 200, "b"), (3, None, "c"), (4, "kept", "d"), (4, "kept", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid string").coalesce(1)
    got = [tuple(r) for r in sub.without_repeats(docs, 300).collect()]
    assert len(got) >= 4 and all(r in rows or "é" in r[1] or r[1] == "x" for r in got) and (3, None, "c") in got and got.count((4, "kept", "d")) == 2
    assert sub.without_repeats(docs.limit(0), 300).count() == 0


def test_passages_of_51_short_words_are_cut_and_of_50_are_not(spark):
    import corpus_pipeline

    r = random.Random(8)
    say = lambda n: " ".join("".join(r.choices("abcdefghijkl", k=r.randint(4, 8))) for _ in range(n))
    short = lambda n: " ".join("".join(r.choices("abcdefghijkl", k=r.randint(1, 5))) for _ in range(n))
    long, less = short(51), short(50)
    assert len(long) < 300
    texts = [f"{say(30)} {p} {say(30)}" for p in (long, long, less, less)] + [f"{say(9)}\n{long.replace(' ', '  ')}\t{say(9)}", long, None, "", say(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    want = dict(enumerate(texts))
    want[1] = want[1].replace(long, "")
    want[4] = want[4].replace(long.replace(" ", "  "), "")
    del want[5]
    assert got == want


@pytest.mark.parametrize("limit", [10_000, 2])
def test_words_that_repeat_anywhere_match_brute_force(spark, limit):
    r = random.Random(10)
    parts = [[f"w{r.randint(0, 60)}" for _ in range(r.randint(20, 120))] for _ in range(10)]
    texts = [[w for p in r.choices(parts, k=3) for w in p] for _ in range(60)] + [["das"] * 500, ["das"] * 51, []]
    texts += [texts[3]] * 4
    rows = spark.createDataFrame([(i, "  ".join(t)) for i, t in enumerate(texts)], "rid long, text string").repartition(3)
    count = Counter(tuple(t[s : s + 51]) for t in texts for s in range(len(t) - 50))
    want = {(i, k) for i, t in enumerate(texts) for s in range(len(t) - 50) if count[tuple(t[s : s + 51])] > 1 for k in range(s, s + 51)}
    found = sub.repeated_spans(rows, 51, limit=limit, words=True)
    assert {(x["rid"], k) for x in found.collect() for y in x["spans"] for k in range(y["lo"], y["hi"])} == want
    docs = rows.withColumn("id", rows.rid)
    got = sub.digests(docs.join(found.withColumnRenamed("spans", "word_spans"), "rid", "left").selectExpr("*", "word_spans as spans")).collect()
    assert {g["id"]: g["n_repeated_words"] for g in got} == {i: sum(1 for x in want if x[0] == i) for i in range(len(texts))}


def test_repeated_words_match_brute_force(spark):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(40)]
    parts = [r.choices(vocab, k=r.randint(20, 90)) for _ in range(12)]
    texts = [[w for p in r.choices(parts, k=4) for w in p] + r.choices(vocab, k=30) for _ in range(40)]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "rid long, text string")
    got = {(x["rid"], k) for x in sub.repeated_spans(rows, 51, keep_first=True, words=True).collect() for y in x["spans"] for k in range(y["lo"], y["hi"])}
    seen, want = set(), set()
    for i, t in enumerate(texts):
        for s in range(len(t) - 50):
            if (w := tuple(t[s : s + 51])) in seen:
                want |= {(i, k) for k in range(s, s + 51)}
            seen.add(w)
    assert got == want
