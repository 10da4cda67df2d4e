from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestar.llm import packing


def optimum(items, size):
    """Fewest bins by exhaustive search over subsets."""
    n = len(items)
    fits = [sum(items[i] for i in range(n) if s >> i & 1) <= size for s in range(1 << n)]
    best = [0] + [n] * ((1 << n) - 1)
    for s in range(1, 1 << n):
        sub = s
        while sub:
            if fits[sub] and best[s ^ sub] + 1 < best[s]:
                best[s] = best[s ^ sub] + 1
            sub = (sub - 1) & s
    return best[-1]


def check_plan(counts, plan, size):
    used = Counter()
    for pattern, n in plan:
        assert sum(x * t for x, t in pattern) <= size and n > 0
        for x, t in pattern:
            used[x] += t * n
    assert used == Counter(counts)


@pytest.mark.parametrize("seed", range(40))
def test_plans_are_optimal_on_small_instances(seed):
    r = random.Random(seed)
    items = [r.randint(1, 30) for _ in range(9)]
    counts = Counter(items)
    plan = packing.plan(counts, 40)
    check_plan(counts, plan, 40)
    assert packing.lower_bound(counts, 40) <= sum(n for _, n in plan) == optimum(items, 40)


def test_search_beats_best_fit():
    counts = {48: 2, 37: 4, 32: 2, 20: 2, 63: 2, 16: 4}
    beaten = 0
    for seed in range(60):
        r = random.Random(seed)
        counts = Counter(r.choice([12, 17, 23, 31, 35, 41, 52]) for _ in range(60))
        plan = packing.plan(counts, 100)
        check_plan(counts, plan, 100)
        fit = packing.best_fit(counts, 100)
        check_plan(counts, fit, 100)
        beaten += sum(n for _, n in plan) < sum(n for _, n in fit)
    assert beaten


def test_large_histogram_is_planned_at_once():
    r = np.random.default_rng(1)
    counts = {int(x): int(r.integers(1, 10**9)) for x in range(1, 2049)}
    plan = packing.plan(counts, nodes=5)
    check_plan(counts, plan, 2048)


def test_cached_parts_give_the_tokenizers_ids():
    enc = packing.Encoder(packing.word_bpe_path())
    r = random.Random(2)
    pool = list("abcXYZ 019.,'!|\n\t éÉßİıΣςσ́̀世界🙂 'sll") + [" ", "\n", "the ", "don't ", "<|endoftext|>", "<|ENDOFTEXT|> "]
    for _ in range(400):
        text = "".join(r.choices(pool, k=r.randrange(60)))
        want = np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert enc.encode_all([text])[0] == want == enc.encode(text, 7)


def test_packed_table(spark):
    r = random.Random(8)
    texts = [None, "", "word", " \n"] + [" ".join(r.choices(["alpha", "beta,", "gamma", "Δelta"], k=r.randrange(1, 900))) for _ in range(60)]
    rows = [(None if i == 9 else i % 50, t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, part string").repartition(5)
    out = packing.pack(docs, size=256, with_ids=True).collect()
    enc = packing.encoder(packing.word_bpe_path())
    want = Counter()
    for i, t, *_ in rows:
        ids = enc.encode(t or "") + b"\0\0\0\0"
        for k in range(0, len(ids), 1024):
            want[(i, k // 1024, k // 4, len(ids[k : k + 1024]) // 4, zlib.crc32(ids[k : k + 1024]))] += 1
    assert Counter((o["id"], o["piece"], o["start"], o["length"], o["ids_crc32"]) for o in out) == want
    assert all(zlib.crc32(o["ids"]) == o["ids_crc32"] for o in out)
    by = defaultdict(list)
    for o in out:
        by[o["sequence_id"]].append((o["offset"], o["length"]))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 256
    assert len(by) == sum(n for _, n in packing.plan(Counter(o["length"] for o in out), 256))
    assert packing.pack(docs.limit(0)).count() == 0
