"""Exact substring deduplication by sorting the suffixes at anchors, deep-shallow.

Every window of ``size`` bytes has an anchor: the place of the smallest hash of its 32-byte strings, leftmost
on ties. Equal windows have their anchors at equal places, so two windows are equal only if their anchors'
hashes are, the bytes before the anchors agree to the left end and the bytes after agree to the right end.
Only (hash, place, extent) of anchors is shuffled, one per about ``size``/2 bytes. Anchors whose whole extent
is byte for byte the same are counted as one class before they meet. For the classes of one hash that differ,
the suffixes after the anchor and the mirrored prefixes before it are each sorted deep-shallow; at every split
of a window into left and right part, windows are equal if both parts are in the same run of sorted strings.

A hash with more than ``GROUP_LIMIT`` different classes is not sorted in one task: its windows are counted one
by one, keyed by their own hash, in a plain distributed aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestar.llm.common import bucketed, discard, leave, materialize, sliced, table, utf8
from lodestar.llm.suffixsort import deep_shallow

GRAM = 32
SIZE = 400
GROUP_LIMIT = 32_768
#: Words of a run that counts as a repeated passage.
RUN_WORDS = 51
BLOCK = 1 << 20
_M = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64)) for i in range(5)]
_C = np.uint64(0xD6E8FEB86659FD93)


def anchors(text: np.ndarray, size: int, doublings: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last, hash): anchors of all windows of ``size`` bytes (or word hashes), and the window starts each one owns."""
    h = text.astype(np.uint64)
    for i in range(doublings):
        h = h[: -(1 << i)] * _M[i] + h[1 << i :]
    h ^= h >> np.uint64(29)
    h *= _C
    h ^= h >> np.uint64(32)
    wide = size - (1 << doublings) + 1
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(key) // wide)
    block = np.full(rows * wide, np.uint64(2**64 - 1))
    block[: len(key)] = key
    block = block.reshape(rows, wide)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(text) - size + 1
    least = np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n])
    first = np.flatnonzero(np.diff(least, prepend=~least[:1]))
    place = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return place, first, np.append(first[1:], n) - 1, h[place].view(np.int64)


SEGMENT = "rid long, g1 long, g2 long, s0 long, s1 long, anchors array<struct<h:long,c1:long,c2:long,a:long,s0:long,s1:long>>"
_ANCHOR = ("h", "c1", "c2", "a", "s0", "s1")
#: Anchors of a text lie in segments that end where a hash of an anchor's extent says so, or after this many.
LONGEST = 64


def word_hashes(text: bytes) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in text.split()], np.uint64)


def units(text: bytes, words: bool) -> np.ndarray:
    """What windows are counted in: the bytes of a text, or a 64-bit hash of each of its words."""
    return word_hashes(text) if words else np.frombuffer(text, np.uint8)


def text_anchors(x: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(h, c1, c2, a, s0, s1) of the anchors of all windows; c1 and c2 are a hash of all that the anchor's windows cover."""
    parts = []
    for b in range(0, len(x) - size + 1, BLOCK):
        part = x[b : b + BLOCK + size - 1]
        a, s0, s1, h = anchors(part, size, 5 if x.itemsize == 1 else 3)
        raw, w = part.tobytes(), x.itemsize
        both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[i * w : (j + size) * w], k) for i, j, k in zip(s0.tolist(), s1.tolist(), (a - s0).tolist())]), np.int64).reshape(-1, 2)
        parts.append((h, both[:, 0], both[:, 1], a + b, s0 + b, s1 + b))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 6


def segment_starts(c1: np.ndarray) -> np.ndarray:
    """Where segments begin: after every anchor whose extent's hash is a multiple of four, and at every LONGEST-th of a longer run."""
    cut = np.concatenate([[0], np.flatnonzero(c1[:-1] & 3 == 0) + 1, [len(c1)]])
    long = np.flatnonzero(np.diff(cut) > LONGEST)
    more = [np.arange(cut[i], cut[i + 1], LONGEST) for i in long.tolist()]
    return np.unique(np.concatenate([cut[:-1], *more]))


def _segments(size: int, words: bool):
    """Windows that a text's anchors own follow each other without a gap, so a segment owns all windows from s0 to s1."""
    schema = pa.schema([("rid", pa.int64()), ("g1", pa.int64()), ("g2", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()), ("anchors", pa.list_(pa.struct([(n, pa.int64()) for n in _ANCHOR])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                found, rid, lengths, digests = [], [], [], []
                for r, t in zip(batch["rid"].to_pylist(), utf8(batch["text"])):
                    x = units(t, words)
                    if len(x) < size:
                        continue
                    own = text_anchors(x, size)
                    start = segment_starts(own[1])
                    end = np.append(start[1:], len(own[1]))
                    raw = np.column_stack(own[1:3]).tobytes()
                    digests += [xxhash.xxh3_128_digest(raw[16 * i : 16 * j]) for i, j in zip(start.tolist(), end.tolist())]
                    found.append(own)
                    lengths.append(end - start)
                    rid.append(np.full(len(start), r))
                if not rid:
                    continue
                column = [np.concatenate(c) for c in zip(*found)]
                n = np.concatenate(lengths)
                end = np.cumsum(n)
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, end).astype(np.int32)), pa.StructArray.from_arrays([pa.array(c) for c in column], list(_ANCHOR)))
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in (np.concatenate(rid), both[:, 0], both[:, 1], column[4][end - n], column[5][end - 1])], lists], schema=schema)

    return run


CONTEXT = "h long, n long, k long, rid long, a long, s0 long, width long, bytes binary"


def _contexts(size: int, words: bool):
    names = [f.split()[0] for f in CONTEXT.split(", ")]
    schema = pa.schema([(n, pa.binary() if n == "bytes" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text", 1 << 20):
                rows = []
                for rid, t, marks in zip(batch["rid"].to_pylist(), utf8(batch["text"]), batch["marks"].to_pylist()):
                    x = units(t, words)
                    rows += [(m["h"], m["n"], m["k"], rid, m["a"], m["s0"], m["s1"] - m["s0"] + 1, x[m["s0"] : m["s1"] + size].tobytes()) for m in marks]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows) if rows else [[]] * len(names), schema.types)], schema=schema)

    return run


def repeated(group: np.ndarray, place: np.ndarray, width: np.ndarray, data: list[bytes], size: int, keep_first: bool, rank: np.ndarray, unit: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of the windows (by start in ``data``) that occur elsewhere, or earlier by ``rank`` if the first is kept.

    Places and widths are counted in units of ``unit`` bytes.
    """
    sides = []
    for strings in ([d[p * unit :] for d, p in zip(data, place.tolist())], [d[: p * unit][::-1] for d, p in zip(data, place.tolist())]):
        order, lcp = deep_shallow(strings, group)
        lcp = np.where(lcp < 0, -1, lcp // unit)
        most = np.zeros(len(data), np.int64)
        most[order] = np.maximum(lcp, np.append(lcp[1:], -1))
        sides.append((order, lcp, most))
    (r_order, r_lcp, r_most), (l_order, l_lcp, l_most) = sides
    most, least = place, place - width + 1  # units of the left part
    rows, offsets = [], []
    ids_l, ids_r = np.empty(len(data), np.int64), np.empty(len(data), np.int64)
    for left in range(int(max(0, least.min(initial=0))), int(most.max(initial=-1)) + 1):
        live = np.flatnonzero((least <= left) & (left <= most) & (l_most >= left) & (r_most >= size - left))
        if len(live) < 2:
            continue
        ids_l[l_order] = np.cumsum(l_lcp < left)
        ids_r[r_order] = np.cumsum(r_lcp < size - left)
        live = live[np.argsort(rank[live], kind="stable")] if keep_first else live
        key = ids_l[live] * (len(data) + 1) + ids_r[live]
        _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        hit = count[inverse] > 1
        if keep_first:
            hit[first] = False
        rows.append(live[hit])
        offsets.append(place[live[hit]] - left)
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(offsets)) if rows else (none, none)


def _solve(size: int, keep_first: bool, unit: int, chunk: int = 40_000):
    schema = pa.schema([("rid", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def emit(t: pa.Table) -> pa.RecordBatch:
        col = {c: t[c].to_numpy() for c in ("h", "n", "rid", "a", "s0", "width")}
        group = np.unique(col["h"], return_inverse=True)[1]
        rank = np.empty(t.num_rows, np.int64)
        rank[np.lexsort((col["a"], col["rid"]))] = np.arange(t.num_rows)
        row, offset = repeated(group, col["a"] - col["s0"], col["width"], t["bytes"].to_pylist(), size, keep_first, rank, unit)
        if not keep_first:
            own = col["n"][row] == 1  # classes of several copies are removed whole
            row, offset = row[own], offset[own]
        order = np.lexsort((offset, row))
        row, offset = row[order], offset[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(row)) - 1 if len(row) else begin
        base = col["s0"][row[begin]]
        return pa.RecordBatch.from_arrays([pa.array(col["rid"][row[begin]]), pa.array(base + offset[begin]), pa.array(base + offset[last] + size)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < chunk:
                continue
            rows = pa.Table.from_batches(held)
            h = rows["h"].to_numpy()
            cut = int(np.argmax(h == h[-1]))  # the last group may go on
            if cut:
                yield emit(rows.slice(0, cut))
                held, count = rows.slice(cut).to_batches(), count - cut
        if count:
            yield emit(pa.Table.from_batches(held))

    return run


def _windows(size: int, unit: int):
    """Each window of a context: its hash, and where it is."""
    schema = pa.schema([(n, pa.int64()) for n in ("w1", "w2", "n", "rid", "s")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "bytes", 1 << 18):
                digests, n, rid, s = [], [], [], []
                for r in batch.select(["n", "rid", "s0", "width", "bytes"]).to_pylist():
                    digests += [xxhash.xxh3_128_digest(r["bytes"][i * unit : (i + size) * unit]) for i in range(r["width"])]
                    n += [r["n"]] * r["width"]
                    rid += [r["rid"]] * r["width"]
                    s += range(r["s0"], r["s0"] + r["width"])
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), *[pa.array(v, pa.int64()) for v in (n, rid, s)]], schema=schema)

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str, other: list[str] = ()) -> DataFrame:
    """The rows with a unique rid, in a table bucketed by it: joins on rid do not move the texts again."""
    return bucketed(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), *other), "rid", "texts")


def repeated_spans(docs: DataFrame, size: int = SIZE, keep_first: bool = False, limit: int = GROUP_LIMIT, words: bool = False) -> DataFrame:
    """(rid, spans): arrays of (lo, hi) of the rows of ``docs`` (rid, text) that are covered by repeated windows; they may overlap.

    Sizes and spans are counted in bytes, or with ``words`` in words, whatever white space is between them. Equal
    segments of anchors are counted first, and all but the first of each are covered whole; what is compared
    anchor by anchor are different segments.
    """
    spark = docs.sparkSession
    found = materialize(docs.select("rid", "text").mapInArrow(_segments(size, words), SEGMENT), "segments")
    place = F.struct("rid", "s0")
    kinds = materialize(found.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("p"), F.min_by("anchors", place).alias("anchors")), "kinds")
    same = kinds.where("n > 1").select("g1", "g2", F.col("p.rid").alias("r0"), F.col("p.s0").alias("a0"))
    copies = found.drop("anchors").join(same, ["g1", "g2"])
    if keep_first:
        copies = copies.where("rid <> r0 or s0 <> a0")
    span = lambda df: df.select("rid", F.col("s0").alias("lo"), (F.col("s1") + size).alias("hi"))
    spans = span(copies)

    each = kinds.select("n", F.col("p.rid").alias("rid"), F.explode("anchors").alias("x")).select("n", "rid", "x.*")
    several = materialize(each.groupBy("h").count().where("count > 1").select("h"), "several")
    shared = materialize(each.join(several, "h", "left_semi"), "shared")
    rep = F.min(F.struct("rid", "a", "s0", "s1")).alias("rep")
    classes = materialize(shared.groupBy("h", "c1", "c2").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("places"), rep).select("h", "c1", "c2", "n", "places", "rep.*"), "classes")
    per_hash = materialize(classes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "hashes")
    again = classes.where("places > 1").select("h", "c1", "c2", F.col("rid").alias("r0"), F.col("a").alias("a0"))
    whole = shared.join(again, ["h", "c1", "c2"])
    if keep_first:
        whole = whole.where("rid <> r0 or a <> a0")
    spans = spans.union(span(whole))

    marks = classes.join(per_hash, "h").groupBy("rid").agg(F.collect_list(F.struct("h", "n", "k", "a", "s0", "s1")).alias("marks"))
    unit = 8 if words else 1
    contexts = docs.select("rid", "text").join(marks, "rid").mapInArrow(_contexts(size, words), CONTEXT)
    made = [found, kinds, several, shared, classes, per_hash]
    if not per_hash.where(F.col("k") > limit).isEmpty():
        contexts = materialize(contexts, "contexts")
        every = materialize(contexts.where(F.col("k") > limit).mapInArrow(_windows(size, unit), "w1 long, w2 long, n long, rid long, s long"), "windows")
        made += [contexts, every]
        twice = every.groupBy("w1", "w2").agg(F.sum("n").alias("total"), F.min(F.struct("rid", "s")).alias("first")).where("total > 1")
        hits = every.join(twice, ["w1", "w2"])
        hits = hits.where("rid <> first.rid or s <> first.s") if keep_first else hits
        spans = spans.union(hits.select("rid", F.col("s").alias("lo"), (F.col("s") + size).alias("hi")))
        contexts = contexts.where(F.col("k") <= limit)
    dealt = contexts.repartition("h").sortWithinPartitions("h")
    spans = spans.union(dealt.mapInArrow(_solve(size, keep_first, unit), "rid long, lo long, hi long"))
    out = materialize(spans.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    discard(spark, *made)
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for lo, hi in spans:
        out.append(data[at:lo])
        at = hi
    return b"".join([*out, data[at:]])


def on_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without characters that they cover only in part."""
    out = []
    for lo, hi in spans:
        while lo < hi and data[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return out


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long"


def with_spans(docs: DataFrame, size: int = SIZE, keep_first: bool = False, limit: int = GROUP_LIMIT) -> DataFrame:
    """The rows of a keyed table with ``spans``: arrays of (lo, hi), null where nothing repeats."""
    return docs.join(repeated_spans(docs, size, keep_first, limit), "rid", "left")


def digests(rows: DataFrame) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated_words) of the rows of with_spans; without ``word_spans`` the last is 0."""
    rows = rows if "word_spans" in rows.columns else rows.withColumn("word_spans", F.lit(None).cast(rows.schema["spans"].dataType))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                out = []
                for t, *found in zip(utf8(batch["text"]), batch["spans"].to_pylist(), batch["word_spans"].to_pylist()):
                    cut, again = (merge([(x["lo"], x["hi"]) for x in s or []]) for s in found)
                    out.append((len(t), sum(b - a for a, b in cut), len(cut), hashlib.sha256(kept(t, cut)).hexdigest(), sum(b - a for a, b in again)))
                cols = [pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(list(zip(*out)) or [[]] * 5)]
                yield pa.RecordBatch.from_arrays([batch["id"], *cols], ["id", *[f.split()[0] for f in DIGEST.split(", ")]])

    return rows.select("id", "text", "spans", "word_spans").mapInArrow(run, f"id {kind}, {DIGEST}")


def _cut(docs: DataFrame, spans_of: Callable[[DataFrame], DataFrame], in_bytes: Callable[[bytes, list[tuple[int, int]]], list[tuple[int, int]]], text_col: str) -> DataFrame:
    """``docs`` without the spans (rid, lo, hi) that ``spans_of`` finds; rows whose text is cut down to white space go."""
    names = docs.columns
    others = [c for c in names if c != text_col]
    packed = docs.select(F.struct(*[F.col(c) for c in others]).alias("others"), F.col(text_col).alias("text"), F.lit(0).alias("zero"))
    rows = keyed(packed, "zero", "text", ["others"])
    leave(rows)
    rows = rows.join(spans_of(rows), "rid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                new, keep = [], []
                for i, (t, s) in enumerate(zip(batch["text"].to_pylist(), batch["spans"].to_pylist())):
                    if s:
                        data = t.encode()
                        t = kept(data, in_bytes(data, merge([(x["lo"], x["hi"]) for x in s]))).decode()
                        if not t.strip():
                            new.append(t)
                            continue
                    new.append(t)
                    keep.append(i)
                yield pa.RecordBatch.from_arrays([batch["others"], pa.array(new, pa.string())], ["others", "text"]).take(pa.array(keep, pa.int64()))

    out = rows.select("others", "text", "spans").mapInArrow(run, StructType([rows.schema["others"], StructField("text", StringType())]))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"others.{c}").alias(c) for c in names])


def without_repeats(docs: DataFrame, size: int, keep_first: bool = True, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with repeated windows cut from the texts, on whole characters; the first copy of each stays if ``keep_first``.

    Rows whose text is cut down to white space go; null and short texts stay as they are. "First" is by the rows'
    place in the input.
    """
    return _cut(docs, lambda rows: repeated_spans(rows, size, keep_first), on_characters, text_col)


# Passages measured in words.


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word: what lies between ASCII white space."""
    x = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], ~((x == 32) | ((x >= 9) & (x <= 13))), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def without_repeated_words(docs: DataFrame, words: int, text_col: str = "text") -> DataFrame:
    """``docs`` without the runs of ``words`` words that an earlier place has too, whatever white space is between them.

    Rows whose text is cut down to white space go; null and short texts stay as they are.
    """

    def in_bytes(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        start, end = word_bounds(data)
        return [(int(start[lo]), int(end[hi - 1])) for lo, hi in spans]

    return _cut(docs, lambda rows: repeated_spans(rows, words, keep_first=True, words=True), in_bytes, text_col)


def op4_substrings(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts have no bytes; texts under 400 bytes lose none; repeated rows count as different texts.

    n_repeated_words: words inside runs of ``RUN_WORDS`` words (between ASCII white space) that also start anywhere else,
    so passages of over 50 words show even where they are shorter than 400 bytes.
    """
    docs = keyed(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = [repeated_spans(docs), repeated_spans(docs, RUN_WORDS, words=True).withColumnRenamed("spans", "word_spans")]
    out = materialize(digests(docs.join(found[0], "rid", "left").join(found[1], "rid", "left")).withColumnRenamed("id", "doc_id"), "digests")
    discard(spark, docs, *found)
    return out


OP4_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, hex(encode(coalesce(text, ''))) as h from documents),
w as (select r, s, md5(substr(h, 2 * s + 1, 800)) as k from (select r, h, unnest(generate_series(0, length(h) // 2 - 400)) as s from d where length(h) >= 800)),
again as (select k from w group by k having count(*) > 1),
hit as (select r, s, lag(s) over (partition by r order by s) as p from w semi join again using (k)),
run as (select r, s, sum(case when p is null or s > p + 400 then 1 else 0 end) over (partition by r order by s) as g from hit),
span as (select r, min(s) as lo, max(s) + 400 as hi from run group by r, g),
seg as (select r, lo, hi, lag(hi, 1, 0) over (partition by r order by lo) as before from span),
cut as (select r, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' order by lo) as k, max(hi) as e, sum(hi - lo) as removed, count(*) as n from seg join d using (r) group by r),
word as (select r, list_filter(string_split_regex(t, '[\x09-\x0D ]+'), lambda x: x <> '') as x from d),
word_run as (select r, s, md5(array_to_string(x[s : s + 50], ' ')) as k from (select r, x, unnest(generate_series(1, len(x) - 50)) as s from word where len(x) >= 51)),
word_again as (select k from word_run group by k having count(*) > 1),
word_hit as (select r, s, lag(s) over (partition by r order by s) as p from word_run semi join word_again using (k)),
word_cut as (select r, sum(least(51, s - coalesce(p, s - 51))) as n_repeated_words from word_hit group by r)
select doc_id, length(h) // 2 as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(n, 0) as n_spans,
  sha256(unhex(case when e is null then h else k || substr(h, 2 * e + 1) end)) as kept_sha256, coalesce(n_repeated_words, 0)::bigint as n_repeated_words
from d left join cut using (r) left join word_cut using (r)
"""
