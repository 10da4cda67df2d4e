"""SimHash near-duplicate groups with pivot distance tables.

Fingerprints are made inside the tasks that read the texts. Distinct fingerprints (copies are collapsed
before anything is compared) are dealt to blocks: 64 bits are cut into six parts, and two fingerprints
that differ in at most three bits agree on at least three whole parts, so each of the 20 choices of three
parts is a block key of about 32 bits. Inside a block every fingerprint has a row of a pivot distance
table - its Hamming distances to many reference fingerprints. By the triangle inequality two fingerprints
within distance t differ by at most t in every coordinate, so a pair whose largest coordinate difference
is over t is discarded; survivors are verified by their exact distance. A block gives only the edges of a
spanning forest of its links, so a block of n near copies gives at most n-1 rows and loses no connection.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bucketed, discard, fresh, leave, map_batches, materialize, sliced, table, utf8
from lodestar.llm.components import connected_components

PIVOTS = np.random.default_rng(7).integers(0, 2**64, (24, 1), dtype=np.uint64)
#: A block with more distinct fingerprints than this is dealt again by a fourth part of its other bits.
BLOCK_LIMIT = 16_384


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the word shingles of a text: bit i is 1 if set in over half of the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(flat, 42)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(flat)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[s:e], 42) for s, e in zip(starts, ends[width - 1 :])], np.uint64)
    ones, step = np.zeros(64, np.int64), 1 << 15
    for i in range(0, len(hashes), step):
        part = hashes[i : i + step].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of each row's whole text; null and wordless texts give 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, "text")):
            fp = np.array([fingerprint(t, width) for t in utf8(batch["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(fp)], ["id", "fp"])

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fp long")


def part_masks(parts: int, lo: int = 0, hi: int = 64) -> list[int]:
    cuts = [lo + (hi - lo) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in range(x, y)) for x, y in zip(cuts, cuts[1:])]


def signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def block_masks(radius: int) -> list[int]:
    """Masks of the chosen parts: radius+3 parts, any 3 of which may be the ones that agree."""
    return [sum(c) for c in combinations(part_masks(radius + 3), 3)]


def forest(group: np.ndarray, fp: np.ndarray, radius: int, pivots: np.ndarray = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that span the links inside each group. Memory is linear in the rows, never in the pairs.

    fp: (rows, words) of fingerprint bits; pivots: (pivots, words).
    """
    distance = lambda x, y: np.bitwise_count(x ^ y).sum(-1, dtype=np.int16)
    first = distance(fp, pivots[0])
    order = np.lexsort((fp[:, 0], first, group))
    group, fp, first = group[order], fp[order], first[order]
    coords = np.stack([distance(fp, p) for p in pivots[1:]], 1)
    n = len(fp)
    root = np.arange(n)
    out_a: list[int] = []
    out_b: list[int] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, k = np.arange(n), 1
    while len(left):
        left = left[left + k < n]
        right = left + k
        near = (group[left] == group[right]) & (first[right] - first[left] <= radius)
        left = left[near]  # sorted by the first pivot: a pair too far apart ends its row
        right = left + k
        a, b = left, right
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        for c in range(0, coords.shape[1], 6):  # largest coordinate difference, some pivots at a time
            keep = (np.abs(coords[a, c : c + 6] - coords[b, c : c + 6]) <= radius).all(1)
            a, b = a[keep], b[keep]
        linked = distance(fp[a], fp[b]) <= radius
        joined = False
        for i, j in zip(a[linked].tolist(), b[linked].tolist()):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                out_a.append(i)
                out_b.append(j)
                joined = True
        if joined:
            while (root[root] != root).any():
                root = root[root]
        k += 1
    return order[np.array(out_a, np.int64)], order[np.array(out_b, np.int64)]


def _block_edges(radius: int, words: tuple[str, ...] = ("fp",), pivots: np.ndarray = PIVOTS, chunk: int = 100_000):
    def emit(rows: pa.Table) -> pa.RecordBatch:
        key, part, rep = (rows[c].to_numpy() for c in ("key", "part", "rep"))
        fp = np.column_stack([rows[w].to_numpy() for w in words])
        change = np.ones(len(key), bool)
        change[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        group = np.cumsum(change)
        size = np.bincount(group)[group]
        some = np.flatnonzero(size > 1)
        a, b = forest(group[some], fp[some].view(np.uint64), radius, pivots)
        return pa.RecordBatch.from_arrays([pa.array(rep[some][a]), pa.array(rep[some][b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < chunk:
                continue
            rows = pa.Table.from_batches(held)
            key, part = rows["key"].to_numpy(), rows["part"].to_numpy()
            cut = int(np.argmax((key == key[-1]) & (part == part[-1])))  # the last group may go on
            if cut:
                yield emit(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                count -= cut
        if count:
            yield emit(pa.Table.from_batches(held))

    return run


def linked_pairs(classes: DataFrame, radius: int = 3, limit: int = BLOCK_LIMIT) -> DataFrame:
    """Edges (a, b) between the representatives of distinct fingerprints that span all links within ``radius`` bits.

    classes: (fp, rep), one row for each distinct fingerprint, rep not null.
    """
    masks = block_masks(radius)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])
    rows = classes.select("fp", "rep", F.posexplode(keys).alias("part", "key"))
    hot = materialize(rows.groupBy("part", "key").count().where(F.col("count") > limit).select("part", "key"), "hot")
    if not hot.isEmpty():
        free = [[i for i in range(64) if not m >> i & 1] for m in masks]
        cut = [[sum(1 << i for i in bits[j :: radius + 1]) for j in range(radius + 1)] for bits in free]
        fine = F.array(*[F.array(*[F.lit(signed(m)) for m in row]) for row in cut])
        narrow = F.transform(fine[F.col("part")], lambda m: F.col("fp").bitwiseAND(m))
        again = rows.join(hot, ["part", "key"], "left_semi").select("fp", "rep", "part", "key", F.posexplode(narrow).alias("sub", "more"))
        again = again.select("fp", "rep", (F.lit(1000) + F.col("part") * 100 + F.col("sub")).cast("int").alias("part"), F.xxhash64("key", "more").alias("key"))
        rows = rows.join(hot, ["part", "key"], "left_anti").select("fp", "rep", "part", "key").union(again)
    dealt = rows.select("part", "key", "fp", "rep").repartition("part", "key").sortWithinPartitions("part", "key")
    kind = classes.schema["rep"].dataType.simpleString()
    return map_batches(dealt, _block_edges(radius), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most ``radius`` bits.

    Defined results: a null or wordless text has fingerprint 0 and links like any other; rows with equal
    texts share a fingerprint and a component; a repeated id gives a row each time; a row with a null id is
    no node itself and takes the component of its fingerprint (null if no row with an id is near).
    Extra columns are ignored. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, width), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    edges = linked_pairs(classes.where("rep is not null"), radius)
    parts = connected_components(edges, "a", "b")
    of = classes.join(parts, classes.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return prints.join(of, "fp", "left").select("id", "fp", "component")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# Groups by the similarity of shingle sets, with wide fingerprints and pivots as the filter.

#: Every SAMPLE-th row (by a hash) is counted to find frequent shingles; at most MOST_FREQUENT of them are told to the tasks.
SAMPLE, LEAST_OFTEN, MOST_FREQUENT = 16, 4, 500_000
#: Keys with more rows than this are linked by way of representatives first, in at most STAR_ROUNDS rounds.
STAR_LIMIT, STAR_ROUNDS = 16, 3
#: Keys whose rows are still apart then, and more than this, are dealt to several blocks.
DEAL = 4096
#: Of 256 bits, sets alike in 0.8 differ in 39 on the average (deviation 6), unrelated ones in 128 (deviation 8). A pair
#: over FAR bits apart is discarded unless a set has fewer shingles than SMALL, whose bits say too little.
FAR, SMALL, REFERENCES = 80, 16, 12
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
FINGERPRINT = ("f0", "f1", "f2", "f3")
#: 256 parities of a set: two sets differ in at least as many elements as their parities differ in bits.
PARITY = ("p0", "p1", "p2", "p3")
BITS = (*FINGERPRINT, *PARITY)
PRINT = "id long, c1 long, c2 long, n int, prefix array<long>, " + ", ".join(f"{f} long" for f in BITS)


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted hashes of the different word shingles; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    flat = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(flat)]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(flat[s:e]) for s, e in zip(starts, ends[min(width, len(words)) - 1 :])], np.uint64).view(np.int64))


def wide_fingerprint(shingles: np.ndarray, step: int = 1 << 13) -> np.ndarray:
    """SimHash of 256 bits as four unsigned words; zero for an empty set."""
    ones = np.zeros(256, np.int64)
    for i in range(0, len(shingles), step):
        h = shingles[i : i + step, None].view(np.uint64) * _ODD
        h ^= h >> np.uint64(32)
        h *= _ODD[::-1]
        h ^= h >> np.uint64(29)
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(ones * 2 > len(shingles)).view(np.uint64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Of each of 256 buckets of hashes, whether the set has an odd number in it; four unsigned words."""
    buckets = (shingles.view(np.uint64) * _ODD[1]) >> np.uint64(56)
    return np.packbits(np.bincount(buckets.astype(np.int64), minlength=256) & 1).view(np.uint64)


def most_different(similarity: float) -> float:
    """Two sets of this similarity or more differ in at most so many elements for each element they have."""
    return (1 - similarity) / (1 + similarity)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def _shingle_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, "text", 1 << 20)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(t, width) for t in utf8(batch["text"])]))], ["s"])

    return run


def _set_rows(width: int):
    """Sets for comparing pairs keep 32 bits of each hash, which miscounts about one shingle in 50,000 pairs."""
    cut = lambda t: np.unique(shingle_set(t, width).view(np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, "text", 1 << 20)):
            yield pa.RecordBatch.from_arrays([batch["id"], _lists([cut(t) for t in utf8(batch["text"])])], ["id", "shingles"])

    return run


def prefix_length(n: int, similarity: float) -> int:
    """Of two sets alike in ``similarity`` or more, the first so many elements in any common order share one."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def _print_rows(width: int, similarity: float, shared: Broadcast):
    """shared: sorted frequent shingles and their counts. Rare shingles come first in a prefix, so a key has few rows."""

    def prefix(s: np.ndarray) -> np.ndarray:
        frequent, often = shared.value
        weight = np.zeros(len(s), np.int64)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
            weight = np.where(frequent[at] == s, often[at], 0)
        return s[np.lexsort((s, weight))[: prefix_length(len(s), similarity)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, "text", 1 << 20)):
            sets = [shingle_set(t, width) for t in utf8(batch["text"])]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            bits = np.array([np.concatenate([wide_fingerprint(s), parities(s)]) for s in sets]).view(np.int64)
            columns = [batch["id"], pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([len(s) for s in sets], pa.int32()), _lists([prefix(s) for s in sets]), *[pa.array(bits[:, k]) for k in range(len(BITS))]]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PRINT.split(", ")])

    return run


def _pairs(similarity: float, chunk: int = 50_000, most: int = 1 << 18):
    """Pairs of one key whose components differ, whose sizes and parities allow the similarity, and whose fingerprints are near.

    Inside a chunk every fingerprint has a row of distances to reference fingerprints taken from the chunk itself; a pair
    that differs too much in a coordinate is discarded, and the rest by their own distance, then by their parities.
    """
    share = most_different(similarity)
    distance = lambda x, y: np.bitwise_count(x ^ y).sum(-1, dtype=np.int16)

    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, side, n, i, of = (rows[c].to_numpy() for c in ("key", "side", "n", "id", "component"))
        fp = np.column_stack([rows[f].to_numpy() for f in FINGERPRINT]).view(np.uint64)
        odd = np.column_stack([rows[p].to_numpy() for p in PARITY]).view(np.uint64)
        order = np.lexsort((n, key))
        key, side, n, i, of, fp, odd = key[order], side[order], n[order], i[order], of[order], fp[order], odd[order]
        coords = np.stack([distance(fp, p) for p in fp[:: max(1, len(fp) // REFERENCES)][:REFERENCES]], 1)
        left, k = np.arange(len(key)), 1
        while len(left):
            left = left[left + k < len(key)]
            right = left + k
            left = left[(key[left] == key[right]) & (n[left] >= similarity * n[right] - 1e-9)]  # by size: a pair too far apart ends its row
            a, b = left, left + k
            live = (of[a] != of[b]) & ((side[a] < 0) | (side[a] != side[b]))
            a, b = a[live], b[live]
            near = n[a] < SMALL
            near[~near] = (np.abs(coords[a[~near]] - coords[b[~near]]) <= FAR).all(1)
            a, b = a[near], b[near]
            near = (n[a] < SMALL) | (distance(fp[a], fp[b]) <= FAR)
            a, b = a[near], b[near]
            near = distance(odd[a], odd[b]) <= share * (n[a] + n[b]) + 1e-6
            a, b = a[near], b[near]
            a, b = np.where(i[a] < i[b], a, b), np.where(i[a] < i[b], b, a)
            for s in range(0, len(a), most):
                x, y = a[s : s + most], b[s : s + most]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i[x], i[y], n[x], n[y])], ["a", "b", "na", "nb"])
            k += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < chunk:
                continue
            rows = pa.Table.from_batches(held)
            key = rows["key"].to_numpy()
            cut = int(np.argmax(key == key[-1]))  # the last key may go on
            if cut:
                yield from emit(rows.slice(0, cut))
                held, count = rows.slice(cut).to_batches(), count - cut
        if count:
            yield from emit(pa.Table.from_batches(held))

    return run


def near(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows (id, n, fingerprint, parities) that may have the similarity.

    Their fingerprints are near, or their sets too small to tell, and their parities differ in few bits.
    """
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.array(*FINGERPRINT).alias(f"f{c}"), F.array(*PARITY).alias(f"p{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda u, v: u + v)
    alike = (F.least("na", "nb") < SMALL) | (apart("fa", "fb") <= FAR)
    return both.where(alike & (apart("pa", "pb") <= most_different(similarity) * (F.col("na") + F.col("nb")) + 1e-6)).select("a", "b")


def verified(pairs: DataFrame, source: DataFrame, similarity: float, width: int = 5) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity; sets are made of the texts that occur in a pair."""
    spark = pairs.sparkSession
    pairs = materialize(pairs, "pairs")
    members = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = materialize(map_batches(source.join(members, "id", "left_semi"), _set_rows(width), "id long, shingles array<int>"), "sets")
    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    out = materialize(shared.where(F.col("shared") >= similarity * (F.col("total") - F.col("shared")) - 1e-9).select("a", "b"), "links")
    discard(spark, pairs, sets)
    return out


def candidates(rows: DataFrame, similarity: float, limit: int = DEAL) -> DataFrame:
    """(a, b) of rows (key, id, n, rows, component, fingerprint, parities) that are near and share enough keys for the similarity.

    With prefixes of p of n elements, the overlap is at most the shared keys and the longer rest n - p. A key of over
    ``limit`` rows is cut into sides by a hash of the id, and every two sides meet in a block of their own.
    """
    base = ["key", "id", "n", "component", *BITS]
    tagged = rows.where(F.col("rows") <= limit).select(*base, F.lit(-1).cast("long").alias("side"))
    hot = rows.where(F.col("rows") > limit).withColumn("sides", F.ceil(F.col("rows") / limit).cast("long"))
    hot = hot.withColumn("own", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("sides"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
    block = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    tagged = tagged.union(hot.select(block.alias("key"), *base[1:], F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side")))
    dealt = tagged.repartition("key").sortWithinPartitions("key")
    met = map_batches(dealt, _pairs(similarity), "a long, b long, na int, nb int").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("met"))
    rest = lambda n: F.ceil(similarity * F.col(n) - 1e-9) - 1
    enough = F.col("met") + F.greatest(rest("na"), rest("nb")) >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-6
    return met.where(enough).select("a", "b")


def similar_groups(docs: DataFrame, id_col: str, text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component) under links of word shingle sets with at least this Jaccard similarity; wordless texts are alike.

    Two such sets share a shingle among the first of each (prefix filter, rare ones first), so shared shingles make the
    blocks in which fingerprints meet; every pair left by the pivots and the parities is verified on the sets (64-bit hashes). Any common
    order of shingles will do, so the frequent ones may come from a part of the rows. Ids are whole numbers, unique and
    not null; ``docs`` should be bucketed by them.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    some = map_batches(source.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(SAMPLE)) == 0), _shingle_rows(width), "s long")
    often = some.groupBy("s").count().where(F.col("count") >= LEAST_OFTEN).orderBy(F.desc("count"), "s").limit(MOST_FREQUENT).toArrow()
    s, count = often["s"].to_numpy(), often["count"].to_numpy()
    order = np.argsort(s)
    shared = spark.sparkContext.broadcast((s[order], count[order]))
    prints = materialize(map_batches(source, _print_rows(width, similarity, shared), PRINT), "prints")
    whole = F.min_by(F.struct("n", "prefix", *BITS), "id").alias("x")
    full = materialize(prints.groupBy("c1", "c2").agg(F.min("id").alias("id"), whole).select("c1", "c2", "id", "x.*"), "classes")
    ids = materialize(prints.select("id", "c1", "c2"), "ids")
    discard(spark, prints)
    prefixes = full.select(F.explode("prefix").alias("key"), "id")
    keys = materialize(prefixes.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "keys")
    rows = materialize(prefixes.join(keys, "key").select("key", "id", "rows"), "shared")
    classes = materialize(full.drop("prefix"), "classes")
    discard(spark, full, keys)
    made = [ids, classes, rows]

    edges = None
    alone = rows.withColumn("component", F.col("id"))
    for r in range(STAR_ROUNDS):
        wide = alone.where(F.col("rows") > STAR_LIMIT)
        pick = F.min(F.struct(F.xxhash64(F.lit(r), "id").alias("x"), F.col("id").alias("a"), F.col("component").alias("own"))).alias("star")
        stars = wide.groupBy("key").agg(pick, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key", "star")
        met = wide.join(stars, "key").where("component <> star.own").groupBy("id").agg(F.min("star")["a"].alias("x"), F.min(F.struct("rows", "key", "star.a"))["a"].alias("y"))
        met = met.select("id", F.explode(F.array_distinct(F.array("x", "y"))).alias("to"))  # the first of its stars, and that of its rarest key
        star = met.select(F.least("to", "id").alias("a"), F.greatest("to", "id").alias("b")).distinct()
        new = verified(near(star, classes, similarity), source, similarity, width)
        made.append(new)
        if new.isEmpty():
            break
        edges = new if edges is None else edges.union(new)
        parts = materialize(connected_components(edges, "a", "b"), "parts")
        made.append(parts)
        alone = rows.join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "rows", F.coalesce("component", "id").alias("component"))
    several = alone.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    last = materialize(alone.join(several, "key", "left_semi").join(classes.select("id", "n", *BITS), "id"), "apart")
    new = verified(candidates(last, similarity), source, similarity, width)
    parts = connected_components(new if edges is None else edges.union(new), "a", "b")
    of = classes.select("c1", "c2", "id").join(parts, classes.id == parts.node, "left").select("c1", "c2", F.coalesce("component", "id").alias("component"))
    out = materialize(ids.join(of, ["c1", "c2"]).select("id", "component"), "groups")
    discard(spark, *made, last, new)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of every near-duplicate group: the smallest id, null ids last; equal ids by their place.

    Texts without words stay: there is nothing in them that another has too.
    """
    row = fresh("lodestar_row", docs.columns)
    rows = bucketed(docs.withColumn(row, F.monotonically_increasing_id()), row, "rows")
    wordless = F.coalesce(F.col(text_col), F.lit("")).rlike(r"^[\x09-\x0d\x20]*$")
    leave(rows)
    groups = similar_groups(rows.where(~wordless), row, text_col, width, similarity)
    ranked = rows.select(F.col(row).alias("id"), F.col(id_col).alias("own")).join(groups, "id", "left")
    ranked = ranked.groupBy(F.coalesce("component", "id").alias("component")).agg(F.min(F.struct(F.col("own").isNull(), F.col("own"), F.col("id"))).alias("k"))
    return rows.join(ranked.select(F.col("k.id").alias(row)), row, "left_semi").select(docs.columns)
