from __future__ import annotations

import random

import pytest

from lodestar.llm import tokencount as tc

POOL = ["the", "The", " ", "  ", "\n", "\n\n", "\t", "'", "'s", "'ll", "l", "1", "42", "!", "...", "é", "世", "🙂", "a", "word", " x", "\r\n"]


@pytest.fixture(scope="module")
def c():
    return tc.counter(tc.byte_bpe_path())


@pytest.mark.parametrize("seed", range(6))
def test_edited_counts_equal_full_counts(c, seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(tc, "LEAF", 3)
    r = random.Random(seed)
    for _ in range(60):
        text = "".join(r.choices(POOL, k=r.randrange(0, 250)))
        tree = tc.TokenTree(text, c)
        for _ in range(12):
            a = r.randrange(-2, len(text) + 3)
            b = a + r.choice([0, 0, 1, 2, 5, 40])
            new = "".join(r.choices(POOL, k=r.randrange(0, 5)))
            tree.edit(a, b, new)
            lo = min(max(a, 0), len(text))
            text = text[:lo] + new + text[min(max(b, lo), len(text)) :]
            assert tree.text() == text
            assert tree.total == len(c.encoding.encode_ordinary(text))
            assert [p for leaf in tree.parts for p in leaf] == c.split(text)


def test_only_the_region_is_counted_again(c):
    text = "lorem ipsum dolor sit amet " * 20_000
    tree = tc.TokenTree(text, c)
    for at in (5, 200_000, 400_001):
        tree.edit(at, at + 3, "XY z")
    assert tree.recounted < 40


def test_table(spark):
    rows = [(1, "some words here", "e"), (2, None, "e"), (3, "", None), (None, "x " * 3000, "e"), (1, "some words here", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumn("edits", tc.sample_edits())
    out = tc.counted(docs).collect()
    full = tc.counter(tc.byte_bpe_path()).encoding.encode_ordinary
    assert len(out) == 5
    for r in out:
        text = r["text"] or ""
        assert r["n_tokens"] == len(full(text))
        for e in r["edits"]:
            lo = min(e["start"], len(text))
            text = text[:lo] + e["text"] + text[max(lo, min(e["end"], len(text))) :]
        assert r["n_tokens_edited"] == len(full(text))
    assert tc.counted(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "abc", None), (2, "abc", [None]), (3, "abc", [(0, None, "x")])], "doc_id long, text string, edits array<struct<start:long,end:long,text:string>>")
    assert all(r["n_tokens"] == r["n_tokens_edited"] for r in tc.counted(odd).collect())
