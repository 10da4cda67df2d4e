"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, with block-max inverted indexes.

Terms are words and their first four and five letters, so inflected forms of a root meet. The vocabulary keeps
the terms of a bounded labelled sample whose document frequency differs between the classes. Examples lie in
blocks; every term has a posting list cut by block and the largest weight in each block. A query's sum of
those maxima bounds the cosine of any example in a block: the most promising blocks are scored first, and
the rest only where their bound reaches the k-th best cosine, so the k nearest are exact. Votes are weighted
by the squared cosine and the classes' sampling rates and calibrated on the sample, each example left out of
its own neighbours.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from lodestar.llm.common import held_out, sliced, table
from lodestar.llm.quality import training_rows

WORD = re.compile(r"[^\W\d_]+")
#: Bounds of the sample (rows, half of each class where there are enough) and of the vocabulary.
SAMPLE_ROWS, TERMS = 6000, 3000
LEAST_DF, LEAST_Z = 3, 4.5
BLOCK, NEIGHBOURS, FIRST_BLOCKS = 64, 15, 6


def terms_of(text: str) -> Counter:
    """Term frequencies of a whole text: words, and prefixes marked by a star."""
    out: Counter = Counter()
    for w, n in Counter(WORD.findall(text.lower())).items():
        out[w] += n
        if len(w) > 4:
            out[w[:4] + "*"] += n
            out[w[:5] + "*"] += n
    return out


class Examples:
    """The labelled sample as an inverted index, and its calibration."""

    def __init__(self, texts: list[str], labels: list[int], ids: list[int], rates: tuple[float, float]):
        """rates: how many labelled rows of class 0 and 1 each sampled one stands for."""
        y = np.array(labels)
        bags = [terms_of(t) for t in texts]
        df = [Counter(t for b, k in zip(bags, labels) if k == c for t in b) for c in (0, 1)]
        n0, n1 = (y == 0).sum(), (y == 1).sum()
        scored = []
        for t in set(df[0]) | set(df[1]):
            a, b = df[0][t], df[1][t]
            if a + b >= LEAST_DF:
                p = (a + b) / (n0 + n1)
                scored.append((abs(b / n1 - a / n0) / np.sqrt(max(p * (1 - p), 1e-12) * (1 / n0 + 1 / n1)), t))
        chosen = sorted((-z, t) for z, t in scored if z >= LEAST_Z)[:TERMS]
        self.vocabulary = {t: i for i, t in enumerate(sorted(t for _, t in chosen))}
        count = np.array([df[0][t] * rates[0] + df[1][t] * rates[1] for t in self.vocabulary]).reshape(-1)
        self.idf = np.log(1 + (n0 * rates[0] + n1 * rates[1]) / np.maximum(count, 1))
        vectors = [self.vector(b) for b in bags]
        # examples that share their heaviest term lie together, so block maxima stay close to the members
        heavy = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(len(texts)), key=lambda i: (labels[i], heavy[i], i))
        self.y, self.ids = y[order], np.array([ids[i] for i in order], np.int64)
        self.weight = np.where(self.y == 1, rates[1], rates[0])
        vectors = [vectors[i] for i in order]
        v, self.blocks = len(self.vocabulary), -(-len(order) // BLOCK)
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        value = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        sort = np.lexsort((row, term))
        self.row, self.value = row[sort], value[sort]
        cell = term[sort] * self.blocks + self.row // BLOCK
        self.start = np.searchsorted(cell, np.arange(v * self.blocks + 1)).reshape(-1)
        self.largest = np.zeros(v * self.blocks)
        np.maximum.at(self.largest, cell, self.value)
        self.largest = self.largest.reshape(v, self.blocks)
        self.calibrate(vectors)

    def vector(self, bag: Counter) -> tuple[np.ndarray, np.ndarray]:
        found = sorted((self.vocabulary[t], n) for t, n in bag.items() if t in self.vocabulary)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        t = np.array([x for x, _ in found])
        w = (1 + np.log(np.array([n for _, n in found]))) * self.idf[t]
        return t, w / np.sqrt((w * w).sum())

    def cosines(self, t: np.ndarray, w: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the examples of ``blocks`` that share a term with the query."""
        cell = (t[:, None] * self.blocks + blocks[None]).ravel()
        lo, n = self.start[cell], self.start[cell + 1] - self.start[cell]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo, n)
        sums = np.bincount(self.row[place], self.value[place] * np.repeat(np.repeat(w, len(blocks)), n))
        rows = np.flatnonzero(sums)
        return rows, sums[rows]

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine over 0, ties by place: exact."""
        bound = w @ self.largest[t]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rows, cos = self.cosines(t, w, order[:FIRST_BLOCKS])
        rest = order[FIRST_BLOCKS:]
        if len(rows) >= k and len(rest):
            rest = rest[bound[rest] >= np.partition(cos, -k)[-k] - 1e-12]
        if len(rest):
            more, also = self.cosines(t, w, rest)
            rows, cos = np.concatenate([rows, more]), np.concatenate([cos, also])
        top = np.lexsort((rows, -np.round(cos, 12)))[:k]
        return rows[top], cos[top]

    def vote(self, rows: np.ndarray, cos: np.ndarray) -> float:
        """Log odds of the neighbours' votes, smoothed by one neighbour at cosine 0.3 of the sample's mix."""
        w = self.weight[rows] * cos * cos
        base = 0.09 * self.weight.mean()
        rate = (self.weight * self.y).sum() / self.weight.sum()
        return float(np.log((w[self.y[rows] == 1].sum() + base * rate) / (w[self.y[rows] == 0].sum() + base * (1 - rate))))

    def calibrate(self, vectors: list) -> None:
        votes, known = [], []
        for i, (t, w) in enumerate(vectors):
            if len(t):
                rows, cos = self.nearest(t, w, NEIGHBOURS + 1)
                other = rows != i
                votes.append(self.vote(rows[other][:NEIGHBOURS], cos[other][:NEIGHBOURS]))
                known.append(i)
        empty = np.ones(len(vectors), bool)
        empty[known] = False
        rate = (self.weight * self.y).sum() / max(self.weight.sum(), 1e-9)
        self.blank = float(((self.weight * self.y)[empty].sum() + rate) / (self.weight[empty].sum() + 1))
        self.a, self.b = 1.0, 0.0
        if known:
            x, y, w = np.array(votes), self.y[known], self.weight[known]
            for _ in range(30):  # Newton steps of a weighted logistic fit, with a weak pull to the identity
                p = 1 / (1 + np.exp(-np.clip(self.a * x + self.b, -30, 30)))
                g = np.array([(w * (p - y) * x).sum() + (self.a - 1), (w * (p - y)).sum() + 0.1 * self.b])
                h = w * p * (1 - p)
                hess = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]])
                self.a, self.b = np.array([self.a, self.b]) - np.clip(np.linalg.solve(hess, g), -1, 1)

    def score(self, text: str) -> tuple[float, np.ndarray, np.ndarray]:
        """(probability of label 1, rows of the nearest examples, their cosines)."""
        t, w = self.vector(terms_of(text))
        if not len(t):
            return min(max(self.blank, 0.0), 1.0), np.zeros(0, np.int64), np.zeros(0)
        rows, cos = self.nearest(t, w, NEIGHBOURS)
        return float(1 / (1 + np.exp(-np.clip(self.a * self.vote(rows, cos) + self.b, -30, 30)))), rows, cos


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Examples | None:
    """The examples and their index from a bounded sample; None when a class has no labelled row."""
    rows = training_rows(docs, labels, label, SAMPLE_ROWS)
    found = Counter(r["y"] for r in rows)
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5))
    total = {r["y"]: r["count"] for r in usable.groupBy(F.col(label).cast("int").alias("y")).count().collect()}
    if len(found) < 2:
        return None
    return Examples([r["text"] for r in rows], [r["y"] for r in rows], [r["doc_id"] for r in rows], (total[0] / found[0], total[1] / found[1]))


def scored(docs: DataFrame, model: Examples | None, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` (but for those named like a result) with ``score`` and ``evidence``.

    evidence: the nearest examples' ids, cosines and labels. Null texts count as empty; a text with no known term
    has the rate of such examples as its score and no evidence. Without a model every score is 0.5.
    """
    keep = docs.drop("score", "evidence")
    names = keep.columns
    column = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in sliced(whole, text_col):
                score, evidence = [], []
                for t in batch.column(column).to_pylist():
                    p, rows, cos = m.score(t or "") if m else (0.5, (), ())
                    score.append(p)
                    evidence.append([{"doc_id": int(m.ids[r]), "cosine": float(c), "label": int(m.y[r])} for r, c in zip(rows, cos)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array(evidence, pa.list_(item))], [*names, "score", "evidence"])

    kind = ArrayType(StructType([StructField("doc_id", LongType()), StructField("cosine", DoubleType()), StructField("label", LongType())]))
    return keep.mapInArrow(run, StructType([*keep.schema.fields, StructField("score", DoubleType()), StructField("evidence", kind)]))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.slice("evidence", 1, 3).alias("evidence"))
