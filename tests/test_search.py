from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.indexes import inverted
from lodestar.operators import search

WORDS = "gato perro casa rojo azul verde sol luna".split()


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    texts = [" ".join(r.choices(WORDS, weights=range(1, 9), k=r.randrange(0, 12))) for _ in range(60)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc long, text string")


def weights(texts):
    tfs = [Counter(t.split()) for t in texts]
    df = Counter(t for c in tfs for t in c)
    return tfs, df


def test_tfidf_and_bm25_match_brute_force(spark, corpus, tmp_path):
    texts, docs = corpus
    tfs, df = weights(texts)
    n = len(texts)
    w = lambda tf, t: (1 + math.log10(tf)) * math.log10(n / df[t])
    index = inverted.build(docs, f"file://{tmp_path}/index", "doc", "text", "raw")
    query = Counter({"gato": 2, "casa": 1, "missing": 1})
    qn = math.sqrt(sum(w(q, t) ** 2 for t, q in query.items() if df[t]))
    average = sum(sum(c.values()) for c in tfs) / n
    tfidf, bm25 = {}, {}
    for i, c in enumerate(tfs):
        if any(t in c for t in query):
            norm = math.sqrt(sum(w(x, t) ** 2 for t, x in c.items()))
            tfidf[i] = sum(w(q, t) * w(c[t], t) for t, q in query.items() if c[t]) / (norm * qn) if norm else 0
            size = sum(c.values())
            bm25[i] = sum(q * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size / average)) for t, q in query.items() if c[t])
    for scoring, want in (("TFIDF", tfidf), ("BM25", bm25)):
        got = search.ranked(index, "gato gato casa missing", None, scoring).collect()
        assert {r["doc"]: r["score"] for r in got} == pytest.approx(want)
        assert [r["doc"] for r in got] == [i for i, _ in sorted(((i, round(s, 12)) for i, s in want.items()), key=lambda x: (-x[1], x[0]))] or scoring == "TFIDF"
        allowed = docs.where("doc % 2 = 0").select("doc")
        some = search.ranked(index, "gato gato casa missing", None, scoring, allowed).collect()
        assert {r["doc"]: r["score"] for r in some} == pytest.approx({i: s for i, s in want.items() if i % 2 == 0})


@pytest.mark.parametrize("text", ["gato AND perro", "gato OR sol", "NOT luna", "luna AND NOT (sol OR gato)", "NOT luna OR gato", "sol luna", "missing"])
def test_conditions_over_the_index(spark, corpus, text):
    texts, docs = corpus
    index = search.text_index(docs, "doc", "text", "raw")
    c = search.condition(text, "raw")
    want = {i for i, t in enumerate(texts) if c.holds(set(t.split()))}
    assert {r["doc"] for r in search.matching(index, text).collect()} == want


def test_scores_without_positive_terms_and_empty_tables(spark, corpus):
    _, docs = corpus
    index = search.text_index(docs, "doc", "text", "raw")
    assert {r["score"] for r in search.ranked(index, "NOT luna").collect()} == {0.0}
    nothing = search.text_index(docs.limit(0), "doc", "text", "raw")
    assert search.ranked(nothing, "gato").count() == 0
    assert search.matching(index, search.condition("de", "spanish")).count() == 0


def test_only_the_terms_postings_are_read(spark, corpus, tmp_path):
    _, docs = corpus
    index = inverted.build(docs, f"file://{tmp_path}/i", "doc", "text", "raw")
    plan = search.matching(index, "gato AND luna")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [gato,luna])" in plan and F


def test_rare_terms_are_joined_and_common_ones_told(spark, corpus):
    texts, docs = corpus
    index = search.text_index(docs, "doc", "text", "raw")
    _, df = weights(texts)
    want = sorted((i, t, n, df[t]) for i, text in enumerate(texts) for t, n in Counter(text.split()).items())
    for most in (0, 3, 100):
        got = search.with_frequencies(index.stored, index.frequencies, most).select("doc", "term", "tf", "df")
        assert sorted(map(tuple, got.collect())) == want


def test_conditions_make_no_scores(spark, corpus):
    _, docs = corpus
    index = search.text_index(docs, "doc", "text", "raw")
    assert search.matching(index, "NOT luna").count()
    assert not {"stored", "frequencies", "documents", "average_length"} & set(vars(index))


def test_only_rare_rows_are_shuffled_for_frequencies(spark, corpus):
    _, docs = corpus
    index = search.text_index(docs, "doc", "text", "raw")
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a large vocabulary
    try:
        plan = search.with_frequencies(index.stored, index.frequencies, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    assert plan.count("Exchange hashpartitioning(term") == 1 and "SortMergeJoin" not in plan
