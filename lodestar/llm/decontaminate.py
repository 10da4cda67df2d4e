"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of a partition. Its words become symbols of the benchmark's vocabulary; stretches that
cannot hold a test phrase (a word or neighbouring pair that no phrase has, or too short a run) are left out
of the shard's text. The FM-index of that text is its Burrows-Wheeler transform in a wavelet matrix plus
suffix positions sampled every few places: all phrases are searched backwards at once, and occurrences are
located by walking to a sampled position. Occurrences are merged into removal spans per document.

The phrases of a block of the benchmark (bounded in bytes) are sent to the tasks; a larger benchmark is
searched block by block and the spans of the blocks are merged per document.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.llm.common import materialize, sliced, table, utf8

WINDOW = 10
#: Largest block of benchmark text that is sent to the tasks, and text bytes of a shard.
BLOCK_BYTES, SHARD_BYTES = 16 << 20, 8 << 20
SAMPLE = 8
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Prefix doubling; the end sorts before everything."""
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    n, k = len(t), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        changed = np.concatenate([[0], (np.diff(key[order]) != 0).cumsum()])
        rank = np.empty(n, np.int64)
        rank[order] = changed
        if changed[-1] == n - 1 or k >= n:
            return order
        k *= 2


class WaveletMatrix:
    """Rank and access on a sequence of symbols, for many places at once."""

    def __init__(self, s: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (s >> b & 1).astype(bool)
            ones = np.zeros(len(s) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, bit, ones, len(s) - int(ones[-1])))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``at``."""
        lo, hi = np.zeros_like(at), at.copy()
        for b, _, ones, zeros in self.levels:
            one = (symbol >> b & 1).astype(bool)
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for b, bit, ones, zeros in self.levels:
            one = bit[at]
            out |= one.astype(np.int64) << b
            at = np.where(one, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    def __init__(self, text: np.ndarray, bits: int):
        """text: symbols from 0; an end mark, smaller than all, is added (symbols are stored plus one)."""
        t = np.append(text.astype(np.int64) + 1, 0)
        sa = suffix_array(t)
        bwt = t[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=(1 << bits) + 1))])
        self.matrix = WaveletMatrix(bwt, bits + 1)
        self.sampled = sa % SAMPLE == 0
        self.place = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]
        self.n = len(t)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all phrases; phrases are aligned at their ends, unused places at the front."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1]):
            live = live[(lengths[live] > j) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = phrases[live, -1 - j] + 1
            lo[live] = self.first[c] + self.matrix.rank(c, lo[live])
            hi[live] = self.first[c] + self.matrix.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[rows[live]]
            out[live[done]] = self.samples[self.place[rows[live[done]]]] + steps[live[done]]
            live = live[~done]
            c = self.matrix.access(rows[live])
            rows[live] = self.first[c] + self.matrix.rank(c, rows[live])
            steps[live] += 1
        return out


@dataclass
class Phrases:
    """Test phrases of one benchmark block over a vocabulary of its words (symbol 0 is any other word)."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]  # of each window
    pairs: np.ndarray  # neighbouring symbols of any phrase, first * (words + 1) + second, sorted
    shortest: int

    @staticmethod
    def of(rows: list[tuple[str, bytes]], width: int) -> Phrases:
        owners: dict[tuple, set[str]] = defaultdict(set)
        vocabulary: dict[bytes, int] = {}
        for item, text in rows:
            w = [vocabulary.setdefault(x, len(vocabulary) + 1) for x in words(text)]
            for i in range(max(1, len(w) - width + 1)) if w else ():
                owners[tuple(w[i : i + width])].add(item)
        found = list(owners)
        windows = np.zeros((len(found), width), np.int64)
        for i, w in enumerate(found):
            windows[i, width - len(w) :] = w
        pairs = {a * (len(vocabulary) + 1) + b for w in found for a, b in zip(w, w[1:])}
        lengths = np.array([len(w) for w in found], np.int64)
        return Phrases(vocabulary, windows, lengths, [sorted(owners[w]) for w in found], np.array(sorted(pairs), np.int64), int(lengths.min(initial=width)))

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ids, symbols) of the runs that could hold a phrase, each run followed by a symbol 0 (place -1)."""
        known = ids > 0
        code = ids[:-1] * (len(self.vocabulary) + 1) + ids[1:]
        at = np.searchsorted(self.pairs, code)
        pair = known[:-1] & known[1:] & (at < len(self.pairs)) if len(self.pairs) else np.zeros(len(code), bool)
        pair[pair] = self.pairs[at[pair]] == code[pair]
        starts = np.flatnonzero(known & ~np.concatenate([[False], pair]))  # a run goes on over valid pairs
        ends = np.flatnonzero(known & ~np.concatenate([pair, [False]])) + 1
        keep = ends - starts >= self.shortest
        starts, ends = starts[keep], ends[keep]
        sizes = ends - starts + 1
        if not len(sizes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(first - starts, sizes)
        last = np.zeros(len(place), bool)
        last[first + sizes - 1] = True
        symbols = ids[np.minimum(place, len(ids) - 1)]
        symbols[last] = 0
        place[last] = -1
        return place, symbols


def shard_hits(texts: list[bytes], p: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """For each text: its number of words, merged (from, to) word spans that are hit, items found."""
    counts, parts = [], []
    get = p.vocabulary.get
    for t in texts:
        w = words(t)
        counts.append(len(w))
        parts.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
        parts.append(np.zeros(1, np.int64))  # nothing crosses documents
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    place, symbols = p.candidates(ids) if len(p.windows) and len(ids) else (ids[:0], ids[:0])
    if not len(symbols):
        return counts, spans, items
    index = FMIndex(symbols, max(1, len(p.vocabulary).bit_length()))
    lo, hi = index.search(p.windows, p.lengths)
    sizes = hi - lo
    which = np.repeat(np.arange(len(lo)), sizes)
    at = place[index.locate(np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - lo, sizes))]
    if not len(at):
        return counts, spans, items
    edge = np.bincount(at, minlength=len(ids) + 1) - np.bincount(at + p.lengths[which], minlength=len(ids) + 1)
    hit = np.concatenate([[False], np.cumsum(edge)[: len(ids)] > 0, [False]])
    change = np.flatnonzero(hit[1:] != hit[:-1])
    begins = np.cumsum(np.array(counts) + 1) - np.array(counts) - 1
    for s, e in zip(change[::2].tolist(), change[1::2].tolist()):
        d = int(np.searchsorted(begins, s, "right")) - 1
        spans[d].append((s - int(begins[d]), e - int(begins[d])))
    doc = np.searchsorted(begins, at, "right") - 1
    for d, k in np.unique(np.column_stack([doc, which]), axis=0).tolist():
        items[d] += p.items[k]
    return counts, spans, [sorted(set(x)) for x in items]


ADDED = "n_words long, word_spans array<struct<lo:long,hi:long>>, items array<string>"
_SPAN = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _search(docs: DataFrame, phrases: Phrases, text_col: str, all_rows: bool) -> DataFrame:
    names = docs.columns
    column = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    added = StructType.fromDDL(ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, text_col, SHARD_BYTES):
                counts, spans, items = shard_hits(utf8(batch.column(column)), shared.value)
                pairs = pa.array([[{"lo": a, "hi": b} for a, b in s] for s in spans], _SPAN)
                out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pairs, pa.array(items, pa.list_(pa.string()))], [*names, *added.names])
                yield out if all_rows else out.take(pa.array([i for i, s in enumerate(spans) if s], pa.int64()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields]))


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` (but for those named like a result) with n_words, word_spans and items.

    word_spans: merged [lo, hi) word positions inside occurrences of any window of ``width`` consecutive words of
    an item (a shorter item is one window). items: ids, as strings, of items with an occurring window. Null texts
    have no words; items without words or id have no windows; repeated items count once.
    """
    spark = docs.sparkSession
    keep = docs.drop(*StructType.fromDDL(ADDED).names)
    tests = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    total = tests.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(1.5 * total / block_bytes)) if total > block_bytes else 1
    load = lambda b: Phrases.of([(r["item"], r["text"].encode()) for r in tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()], width)
    if blocks == 1:
        return _search(keep, load(0), text_col, True)
    row = materialize(keep.withColumn("lodestar_row", F.monotonically_increasing_id()), "rows")
    only = row.select("lodestar_row", text_col)
    found = None
    for b in range(blocks):
        part = _search(only, load(b), text_col, b == 0).drop(text_col)
        found = part if found is None else found.union(part)
    found = materialize(found, "hits")
    spans = F.sort_array(F.flatten(F.collect_list("word_spans")))
    merged = found.groupBy("lodestar_row").agg(F.max("n_words").alias("n_words"), spans.alias("s"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    union = F.expr("""aggregate(s, cast(array() as array<struct<lo:bigint,hi:bigint>>), (a, x) ->
        case when size(a) > 0 and a[size(a) - 1].hi >= x.lo
        then concat(slice(a, 1, size(a) - 1), array(named_struct('lo', a[size(a) - 1].lo, 'hi', greatest(a[size(a) - 1].hi, x.hi))))
        else concat(a, array(x)) end)""")
    merged = merged.select("lodestar_row", "n_words", union.alias("word_spans"), "items")
    return row.join(merged, "lodestar_row").drop("lodestar_row")


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    places = [m.span() for m in WORD.finditer(text.lower())]
    out, at = [], 0
    for lo, hi in spans:
        out.append(text[at : places[lo][0]])
        at = places[hi - 1][1]
    return b"".join([*out, text[at:]])


def without_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of find_hits with hit words cut from the text, and without its columns. Texts left without a word go."""
    names = found.columns
    column, span_column, out = names.index(text_col), names.index("word_spans"), [c for c in names if c not in StructType.fromDDL(ADDED).names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, text_col):
                texts, spans = batch.column(column).to_pylist(), batch.column(span_column).to_pylist()
                new, keep = [], []
                for i, (t, s) in enumerate(zip(texts, spans)):
                    cut = cut_words(t.encode(), [(x["lo"], x["hi"]) for x in s]).decode() if s else t
                    if not s or words(cut.encode()):
                        keep.append(i)
                    new.append(cut)
                kept = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([(pa.array(new, pa.string()) if n == text_col else batch.column(names.index(n))).take(kept) for n in out], out)

    return found.mapInArrow(run, StructType([found.schema[c] for c in out]))


def without_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, all columns of whatever names, with benchmark passages cut from the texts. Texts left without a word go."""
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), F.col(text_col).alias("text"))
    cut = without_spans(find_hits(packed, benchmark))
    return cut.select(*[F.col("text").alias(c) if c == text_col else F.col(f"others.`{c}`").alias(c) for c in docs.columns])


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_hits(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("word_spans") > 0).alias("contaminated"))


OP8_SQL = r"""
with lowered as (select row_number() over () as rid, doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') as parts from documents),
doc as (select rid, doc_id, list_filter(parts, lambda x: x <> '') as w from lowered),
item as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
win as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as s from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) as i from item where len(w) > 0)),
sizes as (select distinct n from win),
place as (select rid, i, n, array_to_string(w[i : i + n - 1], ' ') as s from (select rid, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from doc, sizes where len(w) >= n)),
hit as (select rid, i, place.n, item_id from place join win on place.n = win.n and place.s = win.s),
hits as (select rid, count(distinct j) as n_hit from (select rid, unnest(generate_series(i, i + n - 1)) as j from (select distinct rid, i, n from hit)) group by rid),
items as (select rid, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hit group by rid)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hits using (rid) left join items using (rid)
"""
