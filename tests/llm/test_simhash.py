from __future__ import annotations

import random

import numpy as np
import xxhash

from lodestar.llm import simhash


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(ids, fps, radius=3):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


def test_fingerprints_and_groups_match_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(80)]
    texts = [None, "", "  \n", "One", "one", "two words", "ÄB äb"]
    for _ in range(25):
        base = rnd.choices(vocab, k=150)
        for e in range(4):
            new = list(base)
            for _ in range(e):
                new[rnd.randrange(150)] = "edit"
            texts.append(" ".join(new))
    rows = [(i * 7 % 1009, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, rep int")
    got = {r["id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fp(t) for t in texts]
    want = groups([r[0] for r in rows], fps)
    assert {i: r["fp"] % 2**64 for i, r in got.items()} == {r[0]: f for r, f in zip(rows, fps)}
    assert {i: r["component"] for i, r in got.items()} == {r[0]: w for r, w in zip(rows, want)}


def test_hot_blocks_are_dealt_again_without_losing_links(spark):
    rnd = np.random.default_rng(3)
    base = int(rnd.integers(0, 2**63))
    fps = {base}
    for _ in range(300):
        x = base
        for b in rnd.choice(64, rnd.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    classes = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    from lodestar.llm.components import connected_components

    got = {r["node"]: r["component"] for r in connected_components(simhash.linked_pairs(classes, 3, limit=5), "a", "b").collect()}
    assert [got.get(i, i) for i in range(len(fps))] == groups(list(range(len(fps))), fps)


def test_empty_table_null_ids_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, "A B C D"), (None, "zz yy xx ww")], "doc_id long, text string")
    rows = [(r["id"], r["component"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(rows, key=str) == sorted([(None, 2), (4, 2), (4, 2), (2, 2), (None, None)], key=str)


def test_similar_texts_meet_and_others_do_not(spark):
    r = random.Random(2)
    vocab = ["".join(r.choices("abcdefghijkl", k=6)) for _ in range(3000)]
    texts, family = [], []
    for f in range(60):
        base = r.choices(vocab, k=200)
        for e in (0, 1, 2, 2, 3):  # edits; five shingles each: 0.85 and more
            new = list(base)
            for at in r.sample(range(0, 200, 6), e):
                new[at] = "edit" + str(r.random())
            texts.append(" ".join(new))
            family.append(f)
    half = texts[0].split()[:100] + r.choices(vocab, k=100)  # similarity about a third
    texts += [" ".join(half), texts[5], None, "", "\n"]
    family += [60, family[5], 61, 62, 63]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["id"]: x["component"] for x in simhash.similar_groups(docs, "doc_id").collect()}
    assert all(family[i] == family[c] for i, c in got.items() if texts[i] and texts[i].strip())
    apart = sum(got[i] != family.index(family[i]) for i in range(300))
    assert apart <= 6
    kept = {x["doc_id"] for x in simhash.one_of_each(docs).collect()}
    assert {300, 302, 303, 304} <= kept and {i * 5 for i in range(60)} <= kept and len(kept) <= 64 + apart
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, "x y z")]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.one_of_each(odd).collect()), key=str) == sorted([(7, "a b c d e f"), (None, None), (3, "x y z")], key=str)
    assert simhash.one_of_each(odd.limit(0)).count() == 0
    from pyspark.sql import functions as F

    named = odd.withColumn("lodestar_row", F.lit("own"))
    assert sorted(map(tuple, simhash.one_of_each(named).collect()), key=str) == sorted([(7, "a b c d e f", "own"), (None, None, "own"), (3, "x y z", "own")], key=str)


def test_every_pair_at_the_stated_similarity_links(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    texts, alike = [], []
    for f in range(120):  # lone pairs: m new words at the end give (196 - m) / (196 + m)
        base = [word() for _ in range(200)]
        m = 21 if f % 2 else 22  # 0.806 and 0.798
        texts += [" ".join(base), " ".join(base[: 200 - m] + [word() for _ in range(m)])]
        alike.append(f % 2 == 1)
    got = {x["id"]: x["component"] for x in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id").collect()}
    assert [got[2 * f] == got[2 * f + 1] for f in range(120)] == alike


def test_hot_keys_are_dealt_without_losing_pairs(spark):
    r = random.Random(6)
    prefix = {i: set(r.sample(range(12), 4)) for i in range(60)}  # 4 of 16 elements: similarity 0.8 has 1 + 16 - 13
    often = {k: sum(k in p for p in prefix.values()) for k in range(12)}
    bits = ", ".join(f"{c} long" for c in simhash.BITS)
    rows = spark.createDataFrame([(k, i, 16, often[k], i % 50, *[0] * 8) for i, p in prefix.items() for k in p], f"key long, id long, n int, rows long, component long, {bits}")
    want = {(i, j) for j in prefix for i in range(j) if len(prefix[i] & prefix[j]) + 12 >= 16 * 2 * 0.8 / 1.8 and i % 50 != j % 50}
    for limit in (4, 7, 1000):
        assert {tuple(x) for x in simhash.candidates(rows, 0.8, limit).collect()} == want


def test_a_template_is_linked_by_representatives(spark, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[:110] + [f"name{i}"] + base[110:]) for i in range(150)]
    asked = []
    own = simhash.candidates
    monkeypatch.setattr(simhash, "candidates", lambda rows, *a: (asked.append(rows.count()), own(rows, *a))[1])
    got = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id").collect()
    assert len(got) == 150 and {x["component"] for x in got} == {0} and asked == [0]


def test_wide_fingerprints_tell_near_from_far():
    r = np.random.default_rng(5)
    for n in (16, 20, 60, 400):
        far, near = [], []
        for _ in range(60):
            a = r.integers(-(2**63), 2**63, n)
            b = np.concatenate([a[: -(-8 * n // 9)], r.integers(-(2**63), 2**63, n // 9)])  # similarity about 0.8
            other = r.integers(-(2**63), 2**63, n)
            bits = lambda x, y: int(np.bitwise_count(simhash.wide_fingerprint(x) ^ simhash.wide_fingerprint(y)).sum())
            near.append(bits(a, b))
            far.append(bits(a, other))
        assert max(near) <= simhash.FAR < min(far)


def test_parities_never_differ_more_than_their_sets():
    r = np.random.default_rng(8)
    below = 0
    for n in (0, 1, 5, 17, 60, 300, 5000):
        for same in (0, n // 2, 3 * n // 4, n):
            a = r.integers(-(2**63), 2**63, n)
            b = np.concatenate([a[:same], r.integers(-(2**63), 2**63, n - same)])
            bits = int(np.bitwise_count(simhash.parities(a) ^ simhash.parities(b)).sum())
            assert bits <= 2 * (n - same)
            below += n in (17, 60) and same == 3 * n // 4 and bits > simhash.most_different(0.8) * 2 * n
    assert below == 2  # sets alike in 0.6 are told apart
