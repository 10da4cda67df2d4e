from __future__ import annotations

import random
from collections import defaultdict

import corpus_pipeline as cp
import pyarrow as pa
import pyarrow.parquet as pq
from test_decontaminate import brute as brute_hits

from lodestar.llm import packing


def folder(tmp_path):
    r = random.Random(12)
    vocab = ["".join(r.choices("abcdefghijk", k=6)) for _ in range(300)]
    say = lambda n: " ".join(r.choices(vocab, k=n))
    bench = [say(14) for _ in range(3)]
    passage = say(60)
    docs = []
    for i in range(90):
        docs.append(f"{say(60)}. {say(40)}.")
    for i in range(3):
        docs[i] = say(30) + " " + bench[i] + " " + say(20)
        docs[10 + i] = say(30) + " " + passage + " " + say(20)
    docs += [docs[20]] * 3 + [docs[21].replace(".", "!")]
    docs += [" | ".join(r.choices(vocab, k=60)) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(docs)] + [(500, None, None, None, None), (501, "", "en", "s", 0)]
    cols = list(zip(*rows))
    pq.write_table(pa.table({"doc_id": cols[0], "text": pa.array(cols[1], pa.string()), "lang": cols[2], "source": cols[3], "n_chars": cols[4]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [0, 1, 2], "text": bench}), tmp_path / "benchmark.parquet")
    known = [i for i in range(len(docs)) if i % 10]
    pq.write_table(pa.table({"doc_id": known, "quality": pa.array([int(i < 94) for i in known], pa.int32()), "toxic": pa.array([0] * len(known), pa.int32())}), tmp_path / "labels.parquet")
    return docs, bench, passage


def keep_one(texts):
    """Smallest id of each group of documents whose five-word shingle sets are alike in 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {("no words", i)}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
    return [i for i in root if root[i] == i]


def test_stages(spark, tmp_path):
    docs, bench, passage = folder(tmp_path)
    sf_dir = f"file://{tmp_path}"
    at = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = at.columns
    seen = {}
    for i, (name, stage) in enumerate(cp.STAGES):
        stage(spark, at, sf_dir).write.parquet(f"{sf_dir}/out{i}")
        at = spark.read.parquet(f"{sf_dir}/out{i}")
        seen[name] = at.collect()
        assert i == len(cp.STAGES) - 1 or at.columns == columns

    good = {x["doc_id"]: x["text"] for x in seen["quality"]}
    assert set(range(94)) <= set(good) and not set(range(94, 124)) & set(good)
    kept = {x["doc_id"]: x["text"] for x in seen["near_duplicates"]}
    assert sorted(kept) == sorted(keep_one(good))
    cut = {x["doc_id"]: x["text"] for x in seen["substrings"]}
    assert sum(passage in (t or "") for t in cut.values()) == 1 and all(cut[i] == kept[i] for i in range(30, 90))
    clean = {x["doc_id"]: x["text"] for x in seen["decontamination"]}
    assert all(clean[i] == cut[i] for i in range(30, 90))
    assert not any(n for _, n, _ in brute_hits(list(clean.values()), list(enumerate(bench)), 10))
    enc = packing.encoder(packing.word_bpe_path())
    lengths = defaultdict(int)
    for x in seen["packing"]:
        lengths[x["doc_id"]] += x["length"]
    assert lengths == {i: len(enc.encode(t or "")) // 4 + 1 for i, t in clean.items()}
    assert cp.run(spark, sf_dir).count() == len(seen["packing"])


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([("q1", "one two three four five six seven eight nine ten")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["n_words", "word_spans", "items", "lodestar_row", "lodestar_score", "others", "spans", "rid", "score", "id"]
    rows = [(1, "x One two three four five six seven eight nine ten y", *"abcdefghij"), (2, "p q r s t", *"klmnopqrst"), (3, None, *"klmnopqrst")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        got = {r["doc_id"]: tuple(r) for r in got.collect()}
        assert {k: v[2:] for k, v in got.items()} == {r[0]: r[2:] for r in rows}
    assert corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).where("doc_id = 1").first()["text"] == "x  y"
