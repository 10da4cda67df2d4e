from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lodestar.llm import decontaminate as dc


def brute(texts, items, width):
    out = []
    split = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().lower())
    windows = set()
    for item, t in items:
        w = split(t)
        if item is not None and w:
            windows |= {(item, tuple(w[i : i + width])) for i in range(max(1, len(w) - width + 1))}
    for t in texts:
        w, hit, found = split(t), set(), set()
        for item, p in windows:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_index_finds_every_occurrence():
    r = np.random.default_rng(0)
    text = r.integers(0, 5, 700)
    index = dc.FMIndex(text, 3)
    phrases = np.zeros((60, 6), np.int64)
    lengths = r.integers(1, 7, 60)
    for i, n in enumerate(lengths):
        phrases[i, 6 - n :] = r.integers(0, 6, n)
    lo, hi = index.search(phrases, lengths)
    for i, n in enumerate(lengths):
        want = [j for j in range(len(text) - n + 1) if (text[j : j + n] == phrases[i, 6 - n :]).all()]
        assert sorted(index.locate(np.arange(lo[i], hi[i])).tolist()) == want


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_hits_match_brute_force(spark, block_bytes):
    r = random.Random(6)
    vocab = ["alpha", "Beta", "gamma", "d9", "été", "ζ"]
    say = lambda n: "".join(x + r.choice([" ", ", ", "-", "\n"]) for x in r.choices(vocab, k=n))
    items = [(i, say(r.randrange(1, 12))) for i in range(30)] + [(7, "zz"), (50, ""), (51, None), (None, "alpha"), (60, say(8)), (60, say(8))]
    items[0] = (0, say(9))
    texts = [None, "", "...", "zz", "ZZ!"] + [say(r.randrange(0, 90)) for _ in range(40)] + [say(20) + items[3][1] + say(5)] * 3
    docs = spark.createDataFrame([(i, t, 5, "q") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(dc.find_hits(docs, bench, width=5, block_bytes=block_bytes).collect(), key=lambda x: x["doc_id"])
    assert [(g["n_words"], sum(s["hi"] - s["lo"] for s in g["word_spans"]), g["items"]) for g in got] == brute(texts, items, 5)
    for g in got:
        assert all(a["hi"] < b["lo"] for a, b in zip(g["word_spans"], g["word_spans"][1:]))


def test_words_are_cut_and_empty_tables_pass(spark):
    docs = spark.createDataFrame([(1, "Keep this. ONE two, three! And this."), (2, "one two three"), (3, ""), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dc.without_spans(dc.find_hits(docs, bench)).collect()}
    assert got == {1: "Keep this. ! And this.", 3: "", 4: None}
    assert dc.find_hits(docs, bench.limit(0)).where("size(items) > 0").count() == 0
    assert dc.find_hits(docs.limit(0), bench).count() == 0
