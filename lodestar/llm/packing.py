"""Best-fit packing of tokenized documents by bin completion.

Only the histogram of piece lengths (at most ``size`` numbers, whatever the corpus) is planned centrally.
Bin completion takes the largest length left, enumerates the undominated fillings around it, uses one as
often as the counts allow, and branches over the others. A branch ends when its waste exceeds what any
better plan may waste; best-fit decreasing gives the first incumbent. The plan is a bounded table of ranges:
"pieces lo..hi of this length go to sequences s.. at that offset". Pieces are numbered inside their length by
the counts of earlier partitions plus their place in their own, so nothing is sorted or gathered.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestar.llm.common import materialize, sliced, table

SIZE = 2048
#: Bounds of the search: branches tried in all, fillings considered for each largest length.
NODES, FILLINGS = 300, 24
CACHE = 600_000


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words of lower-case letters up to U+00FF, in UTF-8: each is one word to the tokenizer, and as it is in normal form.
WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: A part that ends in symbols after a letter or digit; the tokenizer always cuts between the two.
TAIL = re.compile(rb"(.*(?:[a-z0-9]|\xc3[\x9f-\xb6\xb8-\xbf]))([!-&(-/:-@\[-`{-~]+)", re.DOTALL)


def byte_letters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, the rest from 256 on."""
    hidden = [x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or x >= 174)]
    return {x: 256 + i for i, x in enumerate(hidden)}


class Encoder:
    """Token ids (little-endian unsigned 32-bit) of whole texts.

    The tokenizer lowers case, drops white space and joins nothing across it, so a text is encoded by its parts
    between blanks and line ends, with A-Z lowered; symbols at the end of a part are a part of their own. Plain words
    need none of the tokenizer's rules and go to its merges at once. Parts seen before come from a bounded cache.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        hidden = byte_letters()
        self.hidden = [(chr(x), chr(hidden[x])) for x in range(0x9F, 0xC0) if x in hidden]  # of those that words have
        self.known: dict[bytes, bytes] = {b"": b""}

    def add(self, parts: Iterable[bytes], step: int = 4096) -> None:
        words, others = [], []
        for p in parts:
            (words if p.isalpha() or WORD.fullmatch(p) else others).append(p)
        for i in range(0, len(words), step):  # what the tokenizer returns is far larger than the ids
            self.known.update(zip(words[i : i + step], self.merged(words[i : i + step])))
        for i in range(0, len(others), step):
            encoded = self.tokenizer.encode_batch_fast([p.decode() for p in others[i : i + step]], add_special_tokens=False)
            self.known.update(zip(others[i : i + step], [array("I", e.ids).tobytes() for e in encoded]))

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of plain words; the last token of each, and no other, is one that ends a word."""
        joined = b"\n".join(words).decode("latin-1")
        for x, y in self.hidden:
            joined = joined.replace(x, y)
        [encoding] = self.merges.encode_batch_fast([joined.split("\n")], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(encoding.ids, np.uint32)
        ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
        data = ids.tobytes()
        return [data[s:e] for s, e in zip([0, *ends], ends)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Texts with "<|" are encoded whole: special tokens are looked for before case is lowered."""
        parts = [t.encode().lower().replace(b"\n", b" ").split(b" ") for t in texts]
        here = set().union(*parts)
        if len(self.known) > CACHE:  # what these texts have stays
            self.known = {b"": b"", **{p: self.known[p] for p in here if p in self.known}}
        known = self.known
        new = here.difference(known)
        tails = {p: m.groups() for p in new if not p[-1:].isalnum() and (m := TAIL.fullmatch(p))}
        self.add(new.difference(tails).union(*tails.values()).difference(known))
        for p, (head, tail) in tails.items():
            known[p] = known[head] + known[tail]
        out = [b"".join(map(known.__getitem__, words)) for words in parts]
        for i in (i for i, t in enumerate(texts) if "<|" in t):
            out[i] = array("I", self.tokenizer.encode(texts[i], add_special_tokens=False).ids).tobytes()
        return out

    def encode(self, text: str, step: int = 1 << 20) -> bytes:
        """A long text goes in steps that end at a blank."""
        out, at = [], 0
        while at < len(text):
            end = len(text) if at + step >= len(text) else text.find(" ", at + step)
            end = len(text) if end < 0 else end
            out += self.encode_all([text[at:end]])
            at = end
        return b"".join(out)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# The plan. A pattern is a tuple of (length, times) of one sequence; a plan is a list of (pattern, repeats).


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple, int]]:
    """Best-fit decreasing over a histogram: every step moves whole classes of equally filled sequences."""
    open_bins: dict[int, list[list]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_bins if r >= length):
            classes = open_bins.pop(room)
            while classes and left:
                pattern, n = classes.pop()
                q = min(room // length, left)
                used = min(n, left // q)
                if used < n:
                    classes.append([pattern, n - used])
                open_bins.setdefault(room - q * length, []).append([(*pattern, (length, q)), used])
                left -= used * q
            if classes:
                open_bins.setdefault(room, []).extend(classes)
            if not left:
                break
        q = size // length
        for times, n in ((q, left // q), (left % q, 1)):
            if times and n:
                open_bins.setdefault(size - times * length, []).append([((length, times),), n])
    return [(tuple(p), n) for classes in open_bins.values() for p, n in classes]


def lower_bound(counts: dict[int, int], size: int) -> int:
    """No plan has fewer sequences: total length, and for each threshold the large lengths that cannot share."""
    lengths = np.array(sorted(counts))
    n = np.array([counts[x] for x in lengths.tolist()], object)
    best = -(-sum(int(x) * c for x, c in counts.items()) // size)
    for k in [x for x in lengths.tolist() if 2 * x <= size]:
        alone, pair, small = lengths > size - k, (lengths <= size - k) & (2 * lengths > size), (2 * lengths <= size) & (lengths >= k)
        room = sum((size - int(x)) * c for x, c in zip(lengths[pair], n[pair]))
        need = sum(int(x) * c for x, c in zip(lengths[small], n[small]))
        best = max(best, int(sum(n[alone])) + int(sum(n[pair])) + max(0, -(-(need - room) // size)))
    return best


def fillings(first: int, counts: dict[int, int], lengths: list[int], size: int, most: int = FILLINGS) -> list[tuple[tuple, int]]:
    """Undominated (pattern, waste) around ``first``, least waste first. ``lengths`` descend and have counts over 0."""
    found: list[tuple[tuple, int]] = []
    steps = 0

    def go(at: int, room: int, chosen: list) -> None:
        nonlocal steps
        steps += 1
        fits = False
        while at < len(lengths):
            x = lengths[at]
            n = min(room // x, counts[x] - (x == first))
            if n > 0:
                fits = True
                for times in range(n, 0, -1):
                    chosen.append((x, times))
                    go(at + 1, room - times * x, chosen)
                    chosen.pop()
                    if steps > 40 * most or len(found) >= most:
                        return
            at += 1
        if not fits:
            found.append((tuple(chosen), room))

    start = next((i for i, x in enumerate(lengths) if x <= size - first), len(lengths))
    go(start, size - first, [])
    out = []
    for chosen, waste in sorted(found, key=lambda x: (x[1], len(x[0]))):
        # dominated: one length left in stock can replace one or two of the filling and waste less
        items = [x for x, t in chosen for _ in range(min(t, 2))]
        sums = {a for a in items} | {a + b for i, a in enumerate(items) for b in items[:i]}
        inside = {x for x, _ in chosen}
        if waste and any(s < x <= s + waste for s in sums for x in lengths if x not in inside):
            continue
        out.append((chosen, waste))
    return out or [min(found, key=lambda x: x[1])]


def merged(first: int, chosen: tuple) -> tuple:
    total = Counter(dict(chosen))
    total[first] += 1
    return tuple(sorted(total.items(), reverse=True))


def plan(counts: dict[int, int], size: int = SIZE, nodes: int = NODES) -> list[tuple[tuple, int]]:
    """As few sequences as the bounded search finds: the fewest possible if they meet the lower bound, else perhaps not."""
    counts = {x: n for x, n in counts.items() if n}
    best = best_fit(counts, size)
    count = lambda p: sum(n for _, n in p)
    total, least = sum(x * n for x, n in counts.items()), lower_bound(counts, size)
    left, steps, waste, spent = dict(counts), [], 0, 1
    frames = [branches(left, size)]  # one state, changed and restored; a frame for each step taken
    while frames and count(best) > least and spent < nodes:
        if not frames[-1]:
            frames.pop()
            if steps:
                pattern, times, lost = steps.pop()
                waste -= lost
                for x, t in pattern:
                    left[x] = left.get(x, 0) + t * times
            continue
        pattern, lost = frames[-1].pop()
        times = min(left[x] // t for x, t in pattern)
        if waste + lost * times > (count(best) - 1) * size - total:
            continue
        spent += 1
        steps.append((pattern, times, lost * times))
        waste += lost * times
        for x, t in pattern:
            left[x] -= t * times
            if not left[x]:
                del left[x]
        rest = best_fit(left, size)  # an incumbent: this branch, completed by best fit
        if sum(n for _, n, _ in steps) + count(rest) < count(best):
            best = [*[(p, n) for p, n, _ in steps], *rest]
        frames.append(branches(left, size) if left else [])
    return best


def branches(left: dict[int, int], size: int) -> list[tuple[tuple, int]]:
    """(pattern, waste) of the undominated fillings around the largest length, the best one last."""
    lengths = sorted(left, reverse=True)
    return [(merged(lengths[0], chosen), lost) for chosen, lost in reversed(fillings(lengths[0], left, lengths, size))] if lengths else []


def ranges(patterns: list[tuple[tuple, int]]) -> dict[str, np.ndarray]:
    """The plan as sorted ranges: pieces lo.. of a length, ``repeats`` for each of its times in the pattern."""
    at: Counter = Counter()
    rows, sequence = [], 0
    for pattern, repeats in patterns:
        offset = 0
        for x, times in pattern:
            rows.append((x, at[x], sequence, repeats, offset))
            at[x] += times * repeats
            offset += x * times
        sequence += repeats
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "lo", "sequence", "repeats", "offset"), cols))


# The Spark job.


def pieces(docs: DataFrame, path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows of documents cut at ``size`` tokens, each document ended by id 0, with their number among the pieces of that length in their partition."""
    kind = docs.schema[id_col].dataType.simpleString()
    ids = ", ids binary" if with_ids else ""
    fields = ["id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        part = TaskContext.get().partitionId()
        for whole in batches:
            for batch in sliced(whole, "text"):
                texts = [t or "" for t in batch["text"].to_pylist()]
                enc = encoder(path)
                data = enc.encode_all(texts) if batch.num_rows > 1 else [enc.encode(t) for t in texts]
                out: list[list] = [[] for _ in fields]
                raw, rows = [], []
                for i, d in enumerate(data):
                    d += b"\0\0\0\0"
                    for k in range(0, len(d), 4 * size):
                        cut = d[k : k + 4 * size]
                        n = len(cut) // 4
                        for column, v in zip(out[1:], (k // (4 * size), k // 4, n, zlib.crc32(cut), part, seen[n])):
                            column.append(v)
                        seen[n] += 1
                        rows.append(i)
                        raw.append(cut)
                arrays = [batch["id"].take(pa.array(rows, pa.int64())), pa.array(out[1], pa.int32()), *[pa.array(v, pa.int64()) for v in out[2:]]]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(raw, pa.binary())] if with_ids else [])], [*fields, *(["ids"] if with_ids else [])])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, nth long{ids}")


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): a row per piece of each row of ``docs``.

    Null and empty texts are the single id 0. Repeated rows and ids are packed each; a null id stays null. Extra
    columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = path or word_bpe_path()
    cut = materialize(pieces(docs, path, size, id_col, text_col, with_ids), "pieces")
    per_part = cut.groupBy("part", "length").count()
    per_part = materialize(per_part, "counts")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(ranges(plan(counts, size)))
    before = F.sum("count").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = per_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    placed = cut.join(bases, ["part", "length"]).withColumn("nth", F.col("base") + F.col("nth")).drop("base", "part")
    names = placed.columns
    length_at, nth_at = names.index("length"), names.index("nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        keys = (p["length"].astype(object) << 48) + p["lo"]
        keys = keys.astype(np.int64) if len(keys) else np.zeros(0, np.int64)
        for batch in batches:
            length, nth = batch.column(length_at).to_numpy(), batch.column(nth_at).to_numpy()
            i = np.searchsorted(keys, (length << 48) + nth, "right") - 1
            k = nth - p["lo"][i]
            sequence, offset = p["sequence"][i] + k % p["repeats"][i], p["offset"][i] + k // p["repeats"][i] * length
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = StructType([*placed.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return placed.mapInArrow(run, schema).drop("nth")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
