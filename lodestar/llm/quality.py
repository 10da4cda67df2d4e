"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping 512-byte chunks (steps of 256) that cover all of it. Every byte has a fixed
code: its character class, a few code bits of its value, and whether the last bytes repeat with a period
of at most 48. Learned filters of 16 bytes, four bytes apart, are rectified and max-pooled in each chunk;
the mean, the largest and the smallest of the chunk activations are combined into one probability. Memory
is linear in a slice of the text: long texts are processed in segments whose pooled values are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestar.llm.common import held_out, sliced, table, utf8

HALF, STEP, WIDTH, CODE, FILTERS = 256, 4, 16, 8, 12
TAPS = WIDTH // STEP
LAGS = range(1, 49)
#: Zeros after each text.
PAD = 56
#: Bound of the training sample: rows, and bytes of a row's text.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 65_536
#: Texts are convolved in segments of this many bytes.
SEGMENT = 1 << 16


def byte_codes() -> np.ndarray:
    """A row for each byte value, and again (from 256) for a byte that ends a repeat."""
    b = np.arange(256)
    lower, upper, digit = (b >= 97) & (b <= 122), (b >= 65) & (b <= 90), (b >= 48) & (b <= 57)
    space, line, high = b == 32, (b == 10) | (b == 13) | (b == 9), b >= 128
    mark = ~(lower | upper | digit | space | line | high | (b == 0))
    rows = np.column_stack([lower, upper, digit, space, line, high, mark, np.zeros(256)]).astype(np.float32)
    again = rows.copy()
    again[:, 7] = 1
    return np.concatenate([rows, again])


CODES = byte_codes()


def repeats(b: np.ndarray) -> np.ndarray:
    """True where the last 8 bytes equal the 8 bytes some lag before, for a lag up to 48."""
    out = np.zeros(len(b), bool)
    for lag in LAGS:
        if len(b) < lag + 8:
            break
        same = b[lag:] == b[:-lag]
        for run in (1, 2, 4):
            same = same[run:] & same[:-run]
        out[lag + 7 :] |= same
    return out


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes' row numbers of all texts, each padded with zeros to whole half chunks; half chunks of each text.

    The padding is longer than any lag or filter, so nothing of a text depends on the one beside it.
    """
    halves = np.array([(len(t) + PAD + HALF - 1) // HALF for t in texts])
    b = np.frombuffer(b"".join(t.ljust(n * HALF, b"\0") for t, n in zip(texts, halves.tolist())), np.uint8)
    return b + (repeats(b) & (b != 0)) * np.int64(256), halves


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.w = (r.standard_normal((WIDTH * CODE, FILTERS)) / np.sqrt(WIDTH * CODE) * 2).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = (r.standard_normal(3 * FILTERS) * 0.1).astype(np.float32)
        self.c = np.float32(0)

    def halves(self, rows: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """Filter outputs, (half chunks, positions, filters). Windows that would reach into the next text are out."""
        x = CODES.take(rows, axis=0).reshape(-1, STEP * CODE)
        w = self.w.reshape(TAPS, STEP * CODE, FILTERS)
        out = np.full((len(x), FILTERS), -1e30, np.float32)
        n = len(x) - TAPS + 1
        np.matmul(x[:n], w[0], out=out[:n])
        for t in range(1, TAPS):
            out[:n] += x[t : n + t] @ w[t]
        out[:n] += self.b
        ends = np.cumsum(halves) * (HALF // STEP)
        for t in range(1, TAPS):
            out[ends - t] = -1e30
        return out.reshape(-1, HALF // STEP, FILTERS)

    def pooled(self, top: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """(texts, 3 * filters) from the maxima of half chunks: a chunk is a half and the next of the same text."""
        starts = np.cumsum(halves) - halves
        chunk = np.maximum(top, 0)
        last = np.zeros(len(top), bool)
        last[starts + halves - 1] = True
        go = np.flatnonzero(~last)
        chunk[go] = np.maximum(top[go], np.maximum(top[go + 1], 0))
        mean = np.add.reduceat(chunk, starts, axis=0) / halves[:, None]
        return np.concatenate([mean, np.maximum.reduceat(chunk, starts, axis=0), np.minimum.reduceat(chunk, starts, axis=0)], axis=1)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ self.v + self.c, -30, 30).astype(np.float64)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of whole texts; short texts share a convolution, long ones are cut into segments."""
        tops: list[np.ndarray] = []
        counts: list[int] = []
        held: list[bytes] = []

        def flush() -> None:
            if held:
                rows, halves = laid_out(held)
                tops.append(self.halves(rows, halves).max(1))
                counts.extend(halves.tolist())
                held.clear()

        total = 0
        for t in texts:
            if len(t) > SEGMENT:
                flush()
                total = 0
                parts = []
                for start in range(0, len(t) + PAD, SEGMENT):
                    before = min(start, HALF)  # context of repeats
                    rows, halves = laid_out([t[start - before : start + SEGMENT + PAD]])
                    top = self.halves(rows, halves).max(1)[before // HALF :]
                    parts.append(top[: min(SEGMENT, len(t) + PAD - start + HALF - 1) // HALF])
                tops.append(np.concatenate(parts))
                counts.append(len(tops[-1]))
                continue
            if total + len(t) > SEGMENT:
                flush()
                total = 0
            held.append(t)
            total += len(t) + HALF
        flush()
        return self.probability(self.pooled(np.concatenate(tops), np.array(counts))) if tops else np.zeros(0)

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 48, rate: float = 0.01, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        params = ["w", "b", "v", "c"]
        m1, m2, t = {p: 0.0 for p in params}, {p: 0.0 for p in params}, 0
        prior = min(max(float(labels.mean()), 0.01), 0.99)
        self.c = np.float32(np.log(prior / (1 - prior)))
        epochs = max(epochs, 200 * batch // max(len(texts), 1))  # a small sample still gets some hundred steps
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                g = self.gradient([texts[j] for j in pick], labels[pick])
                t += 1
                for p in params:
                    m1[p] = 0.9 * m1[p] + 0.1 * g[p]
                    m2[p] = 0.99 * m2[p] + 0.01 * g[p] ** 2
                    step = rate * (1 - epoch / epochs) * (m1[p] / (1 - 0.9**t)) / (np.sqrt(m2[p] / (1 - 0.99**t)) + 1e-8)
                    setattr(self, p, (getattr(self, p) - step).astype(np.float32))
        return self

    def gradient(self, texts: list[bytes], labels: np.ndarray) -> dict:
        rows, halves = laid_out(texts)
        y = self.halves(rows, halves)
        at, top = y.argmax(1), y.max(1)
        starts = np.cumsum(halves) - halves
        x = self.pooled(top, halves)
        d = (self.probability(x) - labels).astype(np.float32) / len(labels)
        g = {"v": x.T @ d + 1e-4 * self.v, "c": d.sum()}
        text = np.repeat(np.arange(len(texts)), halves)
        last = np.zeros(len(top), bool)
        last[starts + halves - 1] = True
        own = np.arange(len(top))
        after = np.minimum(own + 1, len(top) - 1)
        chosen = np.where(last[:, None] | (top >= top[after]), own[:, None], after[:, None])  # the half that gives a chunk's maximum
        chunk = np.maximum(np.take_along_axis(top, chosen, 0), 0)
        share = np.repeat(d[text][:, None], FILTERS, 1)
        mean, big, small = (self.v[k * FILTERS : (k + 1) * FILTERS] for k in range(3))
        back = share * mean / halves[text][:, None]
        for weight, edge in ((big, np.maximum.reduceat(chunk, starts, axis=0)), (small, np.minimum.reduceat(chunk, starts, axis=0))):
            hit = chunk == edge[text]
            back += share * weight * hit / np.add.reduceat(hit, starts, axis=0)[text]
        back *= chunk > 0
        code = CODES[rows]
        base = (chosen * (HALF // STEP) + np.take_along_axis(at, chosen, 0)) * STEP
        gw = np.zeros_like(self.w)
        for f in range(FILTERS):
            live = np.flatnonzero(back[:, f])
            if len(live):
                window = code[np.minimum(base[live, f][:, None] + np.arange(WIDTH), len(code) - 1)].reshape(len(live), -1)
                gw[:, f] = back[live, f] @ window
        return g | {"w": gw, "b": back.sum(0)}


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int = 5, most_bytes: int = SAMPLE_BYTES) -> list:
    """At most ``rows`` labelled rows outside the held-out fold, half of each class where there are enough, in an order that only depends on ids.

    Rows without a label, id or text, and texts over ``most_bytes``, are never learned from.
    """
    lab = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    lab = lab.where(~held_out("doc_id", folds)).withColumn("h", F.xxhash64(F.lit("sample"), "doc_id"))
    most = rows // 2
    picked = lab.where("y = 0").orderBy("h", "doc_id").limit(most).union(lab.where("y = 1").orderBy("h", "doc_id").limit(most))
    text = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes))
    found = text.join(F.broadcast(picked), "doc_id").orderBy("h", "doc_id", F.xxhash64("text")).limit(rows)
    return found.select("doc_id", "text", "y").collect()


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Network | None:
    """A network fitted on a bounded sample; None when the sample lacks a class."""
    rows = training_rows(docs, labels, label, SAMPLE_ROWS)
    y = np.array([r["y"] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    return Network().fit([r["text"].encode() for r in rows], y)


def scored(docs: DataFrame, model: Network | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the probability of label 1; the score column replaces one of its name.

    Null texts count as empty; every text has a score. Without a model (no labels of both classes) it is 0.5.
    """
    keep = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = keep.columns
    column = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, text_col):
                texts = utf8(batch.column(column))
                p = shared.value.score(texts) if shared.value else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*names, score_col])

    schema = StructType([*keep.schema.fields, StructField(score_col, DoubleType())])
    return keep.mapInArrow(run, schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), "quality")
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
