"""Edit-aware token counts: a segment tree of pre-tokens per document.

A leaf holds a few dozen neighbouring pre-tokens with their texts and token counts; inner nodes hold the sums of
characters and tokens below. An edit finds its leaves by the character sums, splits again only the touched
text plus boundary context (on the left as far as a pre-token could look ahead, on the right until a new
boundary meets an old one) and updates the sums on the paths to the root. Tokens never cross pre-tokens, so the
root's sum is the count of the edited text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestar.llm.common import sliced, table

LEAF = 48
CACHE = 300_000
#: A pre-token may depend on this many characters behind its end, and on the white space that follows.
AHEAD = 3


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Counter:
    """Pre-tokens of a text, and tokens of a pre-token through a bounded cache."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.iterate = regex.compile(public_tokenizers.PATTERN).finditer
        self.known: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        if len(self.known) > CACHE:
            self.known.clear()
        known, encode = self.known, self.encoding.encode_ordinary
        for p in set(parts):
            if p not in known:
                known[p] = len(encode(p))
        return [known[p] for p in parts]


@lru_cache(1)
def counter(path: str) -> Counter:
    return Counter(path)


class TokenTree:
    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        self.recounted = 0
        parts = counter.split(text)
        self.build(parts, counter.counts(parts))

    def build(self, parts: list[str], counts: list[int]) -> None:
        self.parts = [parts[i : i + LEAF] for i in range(0, len(parts), LEAF)] or [[]]
        self.counts = [counts[i : i + LEAF] for i in range(0, len(counts), LEAF)] or [[]]
        self.width = 1 << (len(self.parts) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (p, c) in enumerate(zip(self.parts, self.counts)):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(map(len, p)), sum(c)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for leaf in self.parts for p in leaf)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one for the end), and where it starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def update(self, leaf: int) -> None:
        node = self.width + leaf
        self.chars[node], self.tokens[node] = sum(map(len, self.parts[leaf])), sum(self.counts[leaf])
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters [start, end) of the current text; places outside it are moved inside."""
        size = self.chars[1]
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        leaf, pos = self.find(start)
        k = 0
        while k < len(self.parts[leaf]) and pos + len(self.parts[leaf][k]) <= start:
            pos += len(self.parts[leaf][k])
            k += 1
        left = self.parts[leaf][k][: start - pos] if k < len(self.parts[leaf]) else ""
        while pos and not _settled(left):  # back to a boundary that the edit cannot change
            while k == 0:
                leaf -= 1
                k = len(self.parts[leaf])
            k -= 1
            left = self.parts[leaf][k] + left
            pos -= len(self.parts[leaf][k])
        # old pre-tokens are taken leaf by leaf until a new boundary meets an old one behind the edit
        last, taken = leaf, self.parts[leaf][k:]
        while True:
            old = "".join(taken)
            more = last + 1 < len(self.parts)
            if pos + len(old) >= end:
                body = left + new + old[end - pos :]
                shift = len(new) - (end - start)
                at, ends = 0, {0: 0}
                for i, p in enumerate(taken):
                    at += len(p)
                    ends[at] = i + 1
                fresh, met, here = [], None, 0
                for m in self.counter.iterate(body):
                    fresh.append(m[0])
                    here = m.end()
                    if here >= len(left) + len(new) and here - shift in ends and (not more or _settled(body[here : here + 512])):
                        met = ends[here - shift]
                        break
                if met is not None or not more:
                    break
            last += 1
            taken = taken + self.parts[last]
        self._replace(leaf, k, fresh, len(taken) if met is None else met, last)

    def _replace(self, leaf: int, k: int, fresh: list[str], gone: int, last: int) -> None:
        """``fresh`` instead of ``gone`` pre-tokens from the k-th of ``leaf``; they end in leaf ``last`` at most."""
        self.recounted += len(fresh)
        drop = min(gone, len(self.parts[leaf]) - k)
        self.parts[leaf] = self.parts[leaf][:k] + fresh + self.parts[leaf][k + drop :]
        self.counts[leaf] = self.counts[leaf][:k] + self.counter.counts(fresh) + self.counts[leaf][k + drop :]
        for other in range(leaf + 1, last + 1):
            gone -= drop
            drop = min(gone, len(self.parts[other]))
            if drop:
                self.parts[other], self.counts[other] = self.parts[other][drop:], self.counts[other][drop:]
        if len(self.parts[leaf]) > 8 * LEAF:  # too much in one leaf: new leaves, from the counts already known
            self.build([p for x in self.parts for p in x], [c for x in self.counts for c in x])
        else:
            for x in range(leaf, last + 1):
                self.update(x)


def _settled(text: str) -> bool:
    """Pre-tokens that end before ``text`` do not depend on what comes behind it."""
    return len(text) >= AHEAD and not text.isspace()


ADDED = ("n_tokens", "n_pretokens", "n_tokens_edited", "n_recounted")


def counted(docs: DataFrame, text_col: str = "text", edits_col: str = "edits", path: str | None = None) -> DataFrame:
    """All columns of ``docs`` (but for those named like a result) with the token counts before and after its edits.

    edits: array of (start, end, text), each applied to the text that the one before left; places outside the text
    are moved inside. Null texts count as empty; null edits, lists or parts of one change nothing. n_recounted:
    pre-tokens that the edits made the counter look at again.
    """
    path = path or byte_bpe_path()
    keep = docs.drop(*ADDED)
    names = keep.columns
    text_at, edits_at = names.index(text_col), names.index(edits_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for whole in batches:
            for batch in sliced(whole, text_col):
                rows = []
                for text, edits in zip(batch.column(text_at).to_pylist(), batch.column(edits_at).to_pylist()):
                    tree = TokenTree(text or "", c)
                    before, size = tree.total, sum(map(len, tree.parts))
                    for e in edits or ():
                        if e and None not in e.values():
                            tree.edit(e["start"], e["end"], e["text"])
                    rows.append((before, size, tree.total, tree.recounted))
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(list(v), pa.int64()) for v in cols]], [*names, *ADDED])

    return keep.mapInArrow(run, StructType([*keep.schema.fields, *[StructField(n, LongType()) for n in ADDED]]))


def sample_edits(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Four edits from hashes of the id: a word put in, a stretch taken out, a stretch replaced, an end added."""
    size = F.coalesce(F.length(text_col), F.lit(0)).cast("long")
    at = lambda k: F.pmod(F.xxhash64(F.lit(k), F.col(id_col).cast("string")), size + 1)
    edit = lambda start, more, text: F.struct(start.alias("start"), (start + more).cast("long").alias("end"), F.lit(text).alias("text"))
    return F.array(edit(at(1), F.lit(0), " inserted"), edit(at(2), F.lit(25), ""), edit(at(3), F.lit(12), "re-written, 42"), edit(size * 2, F.lit(0), "\nThe end."))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counted(docs.withColumn("edits", sample_edits())).select("doc_id", *ADDED)
