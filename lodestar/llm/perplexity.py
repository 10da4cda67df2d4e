"""Language-model scores of whole documents, with a unigram base.

Word counts of the training fold are a distributed table. The network starts from a small sample and then
learns from all tokens of all training texts: each task goes on from the same start over the stretches of its own
partition, by truncated backpropagation, and the parameters are averaged by tokens in a tree, so what is gathered
grows with the corpus and the driver holds one set of parameters. The commonest words (two fixed bounds) go to the
tasks: the model's own vocabulary, and the counts of ``HEAD`` words; every other word of a document is looked up
by a join with the whole table. A word outside the model's vocabulary is one of its shape tokens (by its last two
bytes) times the smoothed unigram probability of the word among the words of that shape, so every word has a
probability and the model's probabilities sum to one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import discard, held_out, materialize, sliced, table
from lodestar.llm.gru import GatedModel

FOLDS, ADD = 10, 0.1
SHAPES, VOCABULARY, HEAD = 63, 4096, 200_000
#: Bounds of the sample that gives the network its start: rows, and bytes of a row's text.
SAMPLE_ROWS, SAMPLE_BYTES = 700, 65_536
#: Texts are learned from in stretches of STRETCH tokens: all of them. Who wants less than ``learned`` takes gets one in SHARE.
STRETCH, SHARE, RATE = 128, 16, 0.002
#: Parallel streams of stretches: a step of the parameters is over LANES times WINDOW tokens.
LANES, WINDOW = 256, 32
END = 0
#: Different words whose counts a task keeps before it sends them on; at most twice as many before they are merged.
HELD = 300_000


def shape(word: bytes) -> int:
    return 1 + zlib.crc32(word[-2:]) % SHAPES


@cache
def _shapes() -> np.ndarray:
    """The shape of each ending: of the last two bytes as a big-endian number, then of each word of one byte."""
    return np.array([shape(bytes(e)) for e in (*np.ndindex(256, 256), *np.ndindex(256))], np.int32)


def shapes_of(words: pa.Array) -> np.ndarray:
    """``shape`` of each of an array of words, none of them empty."""
    _, at, data = words.buffers()
    ends = np.frombuffer(at, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8) if len(words) else np.zeros(0, np.uint8)
    last = data[ends[1:] - 1].astype(np.int32)
    return _shapes()[np.where(np.diff(ends) > 1, data[ends[1:] - 2].astype(np.int32) << 8, 1 << 16) | last]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The number of words of each text (null is empty), A-Z lowered, all their words as places in the last, and the different words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, lengths = lists.flatten(), np.diff(lists.offsets.to_numpy())
    full = pc.binary_length(flat).to_numpy() > 0  # white space at the ends of a text leaves an empty word there
    if not full.all():
        lengths = np.diff(np.append(0, np.cumsum(full))[np.append(0, np.cumsum(lengths))])
        flat = flat.filter(pa.array(full))
    coded = flat.cast(pa.binary()).dictionary_encode()
    return lengths, coded.indices.to_numpy(), coded.dictionary


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for whole in batches:
        for batch in sliced(whole, "text"):
            _, at, words = words_of(batch["text"])
            held.append(pa.table({"word": words, "n": np.bincount(at, minlength=len(words))}))
            size += len(words)
            if size > 2 * HELD:
                held = [merged()]
                size = len(held[0])
                if size > HELD:
                    yield from held[0].to_batches()
                    held, size = [], 0
    if held:
        yield from merged().to_batches()
    pa.default_memory_pool().release_unused()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over whole texts, A-Z lowered; tasks count before anything is shuffled."""
    return docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Scorer:
    def __init__(self, head: list[tuple[bytes, int]], shapes: dict[int, tuple[int, int]], texts: int, words: int, types: int, sample: list[bytes]):
        """head: commonest words with counts; shapes: for each shape, tokens and types in the training fold."""
        own = head[: VOCABULARY - 1 - SHAPES]
        self.n, self.v = words + texts, types + (texts > 0)
        self.texts = texts
        self.base_log = math.log10(self.n + ADD * (self.v + 1))
        self.base_end = math.log10(texts + ADD) - self.base_log
        weights = np.zeros(VOCABULARY)
        rest = {s: list(shapes.get(s, (0, 0))) for s in range(1, SHAPES + 1)}
        for w, n in own:
            rest[shape(w)][0] -= n
            rest[shape(w)][1] -= 1
        self.shape_log = [0.0, *[math.log10(rest[s][0] + ADD * (rest[s][1] + 1)) for s in range(1, SHAPES + 1)]]
        tokens = [("end", texts), *[(s, max(rest[s][0], 1)) for s in range(1, SHAPES + 1)], *own]
        order = sorted(range(len(tokens)), key=lambda i: (-tokens[i][1], i))
        place = {i: k for k, i in enumerate(order)}  # model ids by falling frequency
        self.end = place[0]
        self.shape_id = [0, *[place[s] for s in range(1, SHAPES + 1)]]
        self.id = {w: place[1 + SHAPES + i] for i, (w, _) in enumerate(own)}
        for i, k in place.items():
            weights[k] = tokens[i][1]
        #: The known words, in the order of the next three, which end with what stands for any other word.
        self.words = pa.array([w for w, _ in head], pa.binary())
        #: log10 of the smoothed probability, share inside the word's shape (0 for the model's words), model id.
        self.base_of, self.inside_of, self.id_of = np.zeros(len(head) + 1), np.zeros(len(head) + 1), np.zeros(len(head) + 1, np.uint16)
        for at, (w, n) in enumerate(head):
            log, i = math.log10(n + ADD), self.id.get(w)
            k = 0 if i is not None else shape(w)
            self.base_of[at], self.inside_of[at], self.id_of[at] = log - self.base_log, log - self.shape_log[k] if k else 0.0, i if i is not None else self.shape_id[k]
        self.model = GatedModel(weights, emb=16, hidden=24)
        data = [np.array([*self.ids(t.lower().split()), self.end], np.int32) for t in sample]
        if data:
            self.model.fit(data, self.end)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "place"}

    @cached_property
    def place(self) -> dict[bytes, int]:
        """The place of each known word."""
        return {w: i for i, w in enumerate(self.words.to_pylist())}

    def ids(self, words: list[bytes]) -> list[int]:
        """Model ids of words alone."""
        return [int(self.id_of[i]) if (i := self.place.get(w)) is not None else self.shape_id[shape(w)] for w in words]

    def read(self, texts: pa.Array) -> dict[str, pa.Array]:
        """Columns for texts: tokens (model ids with the end, 16 bits each), n_tokens, n_known, base (log10 of the known words and
        the end), inside (log10 inside shapes of the known words), tail (different words to look up in the large table).

        Only the different words of all the texts are looked up.
        """
        lengths, at, words = words_of(texts)
        place, shapes = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(), shapes_of(words)
        known = place >= 0
        ids = np.where(known, self.id_of[place], np.array(self.shape_id, np.uint16)[shapes])
        text = np.repeat(np.arange(len(lengths)), lengths)
        ends = np.cumsum(lengths + 1)
        tokens = np.empty(len(at) + len(lengths), np.uint16)
        tokens[np.arange(len(at)) + text] = ids[at]
        tokens[ends - 1] = self.end
        rare = np.flatnonzero(~known[at])
        tail, tf = np.unique(text[rare] * max(len(words), 1) + at[rare], return_counts=True)  # in the order of the texts
        of, word = np.divmod(tail, max(len(words), 1))
        struct = pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(tf), pa.array(np.array(self.shape_log)[shapes[word]])], ["word", "tf", "shape_log"])
        sums = lambda values, add: pa.array(np.bincount(text, values[at], len(lengths)) + add)
        return {
            "n_tokens": pa.array(lengths.astype(np.int64) + 1),
            "n_known": pa.array(lengths - np.bincount(text[rare], minlength=len(lengths)) + int(self.texts > 0)),
            "base": sums(self.base_of[place], self.base_end),
            "inside": sums(self.inside_of[place], 0.0),
            "tokens": pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int32)), pa.py_buffer(tokens)]),
            "tail": pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(lengths) + 1)), pa.int32()), struct),
        }


def commonest(counts: DataFrame) -> int:
    """The least count such that at most HEAD words have it or more, on a grid of eight steps per doubling."""
    step = F.floor(F.log2("n") * 8).alias("b")
    room, least = HEAD, 1 << 62
    for r in counts.groupBy(step).agg(F.count(F.lit(1)).alias("v"), F.min("n").alias("n")).orderBy(F.desc("b")).collect():  # a few hundred rows
        room -= r["v"]
        if room < 0:
            return least
        least = r["n"]
    return 1


def fit(docs: DataFrame, counts: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Scorer:
    """Counts of all ``docs`` (the training fold) and a network fitted on a bounded sample of them, chosen by a hash."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head = sorted(((bytes(r["word"]), r["n"]) for r in counts.where(F.col("n") >= commonest(counts)).collect()), key=lambda x: (-x[1], x[0]))
    of = (F.lit(1) + F.crc32(F.substring("word", -2, 2)) % SHAPES).cast("int").alias("s")
    shapes = {r["s"]: (r["n"], r["v"]) for r in counts.groupBy(of).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    small = docs.where(F.col(text_col).isNotNull() & (F.octet_length(text_col) <= SAMPLE_BYTES))
    place = F.xxhash64(F.lit("lm"), id_col)
    last = small.select(place.alias("h")).orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]  # so that few texts come to the driver
    sample = small.where(place <= last).orderBy(place, F.xxhash64(text_col)).limit(SAMPLE_ROWS).select(text_col).collect() if last is not None else []
    return Scorer(head, shapes, docs.count(), total[0], total[1], [r[0].encode() for r in sample])


def stretches(words: list[bytes], seed: int, scorer: Scorer, share: int = SHARE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens before, tokens) of the stretches of a text, one in ``share`` of them by a hash of their place."""
    for k, at in enumerate(range(0, len(words) + 1, STRETCH)):
        if zlib.crc32(b"%d %d" % (seed, k)) % share == 0:
            ids = scorer.ids(words[max(at - 1, 0) : at + STRETCH])
            ids = [*([] if at else [scorer.end]), *ids, *([scorer.end] if at + STRETCH > len(words) else [])]
            yield np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)


READ = "n_tokens long, n_known long, base double, inside double, tokens binary, tail array<struct<word:binary,tf:long,shape_log:double>>"


def read(docs: DataFrame, scorer: Scorer, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(row, id, and the columns of ``Scorer.read``) of every row: words are looked up once, for learning and scoring. Null texts are empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                made = shared.value.read(batch["text"])
                yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], *made.values()], ["row", "id", *made])
        pa.default_memory_pool().release_unused()

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialize(source.mapInArrow(run, f"row long, id {kind}, {READ}"), "tokens")


def _tokens(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint16).astype(np.int32) for t in column.to_pylist()]


def learned(docs: DataFrame, scorer: Scorer, text_col: str = "text", enough: int = 1 << 17, watch: Callable[[int], None] | None = None, texts: DataFrame | None = None) -> Scorer:
    """``scorer`` with its network trained on over all tokens of ``docs``, in one pass.

    ``texts``: the same rows as ``read`` gives them, if they have been read. A task holds at most about ``enough`` tokens at
    once. A partition's result is a row of parameters and the tokens they have seen; the mean is taken in a tree of
    tasks. ``watch`` is told how many tokens all have seen.
    """
    own = read(docs.withColumn("_id", F.lit(0)), scorer, text_col, "_id") if texts is None else None
    shared, end = docs.sparkSession.sparkContext.broadcast(scorer.model), scorer.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.with_parameters(shared.value.parameters())
        held, size, seen, moments = [], 0, 0, None

        def learn() -> None:
            nonlocal held, size, seen, moments
            y = np.concatenate(held)
            starts = np.cumsum([0, *map(len, held[:-1])])
            x = np.append(end, y[:-1])
            x[starts] = end
            first = (np.arange(len(y)) - np.repeat(starts, list(map(len, held)))) % STRETCH == 0
            moments = model.descend(x, y, first, LANES, WINDOW, 1, RATE, moments, decay=False)
            held, size, seen = [], 0, seen + len(y)

        for whole in batches:
            for batch in sliced(whole, "tokens"):
                for t in _tokens(batch["tokens"]):
                    held.append(t)
                    size += len(t)
                    if size >= enough:
                        learn()
        if held:
            learn()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([model.parameters().astype(np.float32).tobytes()], pa.binary())], ["seen", "parameters"])

    found = materialize((own if texts is None else texts).select("tokens").mapInArrow(run, "seen long, parameters binary"), "models")
    weighted = found.rdd.map(lambda r: (r["seen"], np.frombuffer(bytes(r["parameters"]), np.float32).astype(np.float64) * r["seen"]))
    total, flat = weighted.treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]), 3) if not found.isEmpty() else (0, None)
    discard(docs.sparkSession, found, *([own] if own is not None else []))
    if watch:
        watch(total)
    if total:
        scorer.model = scorer.model.with_parameters(flat / total)
    return scorer


def scored(docs: DataFrame, scorer: Scorer, counts: DataFrame, text_col: str = "text", id_col: str = "doc_id", texts: DataFrame | None = None) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row; null texts are empty: only the end token.

    ``texts``: the same rows as ``read`` gives them, if they have been read.
    """
    texts = read(docs, scorer, text_col, id_col) if texts is None else texts
    kind = texts.schema["id"].dataType.simpleString()
    shared, end = docs.sparkSession.sparkContext.broadcast(scorer.model), scorer.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "tokens"):
                log = shared.value.score(_tokens(batch["tokens"]), end) / math.log(10)
                kept = [batch[c] for c in ("row", "id", "n_tokens", "n_known", "base")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(log + batch["inside"].to_numpy())], ["row", "id", "n_tokens", "n_known", "base", "score"])

    out = texts.select("row", "id", "n_tokens", "n_known", "base", "inside", "tokens").mapInArrow(run, f"row long, id {kind}, n_tokens long, n_known long, base double, score double")
    rare = texts.select("row", F.explode("tail").alias("t")).select("row", "t.*")
    found = rare.join(counts, "word", "left").select("row", "tf", "shape_log", F.coalesce("n", F.lit(0)).alias("c"))
    log = F.log10(F.col("c") + ADD)
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("k"),
        F.sum(F.col("tf") * (log - scorer.base_log)).alias("b"),
        F.sum(F.col("tf") * (log - F.col("shape_log"))).alias("s"),
    )
    both = out.join(sums, "row", "left")
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return both.select("id", "n_tokens", add("n_known", "k").alias("n_known"), F.lit(scorer.n).cast("long").alias("train_tokens"), add("base", "b").alias("base_score"), add("score", "s").alias("score"))


def op6_perplexity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = docs.where(~held_out("doc_id", FOLDS))
    counts = materialize(word_counts(training), "counts")
    scorer = fit(training, counts)
    texts = read(docs, scorer)
    out = scored(docs, learned(training, scorer, texts=texts.where(~held_out("id", FOLDS))), counts, texts=texts)
    return out.select(F.col("id").alias("doc_id"), held_out("id", FOLDS).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
