"""Full-text search over a bag of words (id, term, tf): conditions, TF-IDF cosine and BM25."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.match import Condition, condition
from lodestar.functions.text import bag_of_words
from lodestar.scratch import written

K1, B = 1.2, 0.75
#: The document frequencies of at most so many terms are told to every task; rows of other terms are shuffled.
COMMON_TERMS = 100_000


@dataclass
class TextIndex:
    """Postings (id, term, tf, df) and documents (id, length, norm) of a text column, with the corpus' totals.

    ``documents`` has every row, also those without terms.
    """

    id_col: str
    analyzer: str
    postings: DataFrame
    documents: DataFrame
    n: int
    average_length: float

    @property
    def lengths(self) -> DataFrame:
        return self.documents

    @property
    def ids(self) -> DataFrame:
        return self.documents.select(self.id_col)

    def rows_of(self, terms: list[str]) -> DataFrame:
        return self.postings.where(F.col("term").isin(terms))

    terms_of = rows_of

    def vocabulary(self) -> DataFrame:
        """(term, df, idf)."""
        return self.postings.groupBy("term").agg(F.max("df").alias("df")).withColumn("idf", F.log10(F.lit(float(self.n)) / F.col("df")))


class FreshIndex(TextIndex):
    """The same of a table that has no stored index. Each part is made when it is first asked for.

    Conditions only need the bag of words, in one pass over the texts; scores need it several times, so it is written.
    """

    def __init__(self, docs: DataFrame, id_col: str, analyzer: str, bag: DataFrame):
        self.id_col, self.analyzer, self.docs, self.bag = id_col, analyzer, docs, bag

    @cached_property
    def n(self) -> int:
        return self.docs.count()

    @cached_property
    def stored(self) -> DataFrame:
        return written(self.bag, "bag")

    @cached_property
    def frequencies(self) -> DataFrame:
        """(term, df)."""
        return written(_frequencies(self.stored), "frequencies")

    @cached_property
    def postings(self) -> DataFrame:
        return with_frequencies(self.stored, self.frequencies)

    @cached_property
    def documents(self) -> DataFrame:
        w = (1 + F.log10("tf")) * F.log10(F.lit(float(self.n)) / F.col("df"))
        stats = self.postings.groupBy(self.id_col).agg(F.sum("tf").alias("length"), F.sqrt(F.sum(w * w)).alias("norm"))
        return self.ids.join(stats, self.id_col, "left").select(self.id_col, F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("norm", F.lit(0.0)).alias("norm"))

    @cached_property
    def lengths(self) -> DataFrame:
        stats = self.stored.groupBy(self.id_col).agg(F.sum("tf").alias("length"))
        return self.ids.join(stats, self.id_col, "left").select(self.id_col, F.coalesce("length", F.lit(0)).alias("length"))

    @cached_property
    def average_length(self) -> float:
        return self.lengths.agg(F.avg("length")).first()[0] or 1.0

    @property
    def ids(self) -> DataFrame:
        return self.docs.select(self.id_col)

    def terms_of(self, terms: list[str]) -> DataFrame:
        return self.bag.where(F.col("term").isin(terms)).select(self.id_col, "term")

    def rows_of(self, terms: list[str]) -> DataFrame:
        some = F.col("term").isin(terms)
        return self.stored.where(some).join(self.frequencies.where(some), "term")

    def vocabulary(self) -> DataFrame:
        return _frequencies(self.bag).withColumn("idf", F.log10(F.lit(float(self.n)) / F.col("df")))


def _frequencies(bag: DataFrame) -> DataFrame:
    return bag.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def with_frequencies(bag: DataFrame, frequencies: DataFrame, most: int | None = None) -> DataFrame:
    """``bag`` with df. The commonest terms, ``most`` of them or fewer, have nearly all the rows, which stay where they are.

    Rows of other terms are counted where they meet: only they are shuffled, once, and no frequencies with them.
    """
    room, least = COMMON_TERMS if most is None else most, 1 << 62
    step = F.floor(F.log2("df") * 8).alias("step")
    for r in frequencies.groupBy(step).agg(F.count(F.lit(1)).alias("terms"), F.min("df").alias("df")).orderBy(F.desc("step")).collect():  # a few hundred rows
        room -= r["terms"]
        if room < 0:
            break
        least = r["df"]
    common = F.broadcast(frequencies.where(F.col("df") >= least))
    rare = bag.join(common, "term", "left_anti").withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term")))
    return bag.join(common, "term").unionByName(rare)


def text_index(docs: DataFrame, id_col: str, text_col: str, analyzer: str = "spanish", bag: DataFrame | None = None) -> FreshIndex:
    return FreshIndex(docs, id_col, analyzer, bag_of_words(docs, id_col, text_col, analyzer) if bag is None else bag)


def _read(index: TextIndex, query: str | Condition) -> Condition:
    return query if isinstance(query, Condition) else condition(query, index.analyzer)


def matching(index: TextIndex, query: str | Condition) -> DataFrame:
    """(id) of the documents that meet the condition. Only postings of its terms are read; all documents only if none of them may match."""
    c = _read(index, query)
    if c.tree is None:
        return index.ids.limit(0)
    found = index.terms_of(c.terms).groupBy(index.id_col).agg(F.collect_set("term").alias("terms"))
    if c.holds(set()):
        found = index.ids.join(found, index.id_col, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    return found.where(c.column(F.col("terms"))).select(index.id_col)


def _weights(index: TextIndex, terms: Counter) -> DataFrame:
    """(id, term, tf, df, q) of the query's terms; q is how often the query has the term."""
    counts = F.create_map(*[F.lit(x) for t, n in sorted(terms.items()) for x in (t, float(n))])
    return index.rows_of(sorted(terms)).withColumn("q", counts[F.col("term")])


def tfidf_scores(index: TextIndex, terms: Counter) -> DataFrame:
    """(id, score): cosine of the weights (1 + log10 tf) * log10(N / df); 0 where a norm is 0."""
    idf = F.log10(F.lit(float(index.n)) / F.col("df"))
    w = _weights(index, terms)
    dot = w.groupBy(index.id_col).agg(F.sum((1 + F.log10("q")) * idf * (1 + F.log10("tf")) * idf).alias("dot"))
    squares = w.groupBy("term").agg(F.max(((1 + F.log10("q")) * idf) ** 2).alias("s")).agg(F.sqrt(F.sum("s")).alias("qnorm"))
    both = dot.join(index.documents, index.id_col).join(F.broadcast(squares))  # one row: the query's norm
    score = F.when((F.col("norm") > 0) & (F.col("qnorm") > 0), F.col("dot") / (F.col("norm") * F.col("qnorm"))).otherwise(0.0)
    return both.select(index.id_col, score.alias("score"))


def bm25_scores(index: TextIndex, terms: Counter, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) with idf ln(1 + (N - df + 0.5) / (df + 0.5)), times how often the query has the term."""
    idf = F.log1p((F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = _weights(index, terms).join(index.lengths, index.id_col)
    tf, part = F.col("tf"), F.col("length") / F.lit(index.average_length or 1.0)
    one = F.col("q") * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * part))
    return w.groupBy(index.id_col).agg(F.sum(one).alias("score"))


SCORES = {"TFIDF": tfidf_scores, "BM25": bm25_scores}


def ranked(index: TextIndex, query: str | Condition, k: int | None = None, scoring: str = "TFIDF", allowed: DataFrame | None = None) -> DataFrame:
    """(id, score) of the matching documents, best first, ties by id.

    ``allowed`` (ids) restricts the candidates before the top k; the corpus' statistics stay those of all
    documents. Documents that match without a positive term score 0.
    """
    c = _read(index, query)
    hits = matching(index, c)
    if allowed is not None:
        hits = hits.join(allowed.select(index.id_col), index.id_col, "left_semi")
    out = hits.withColumn("score", F.lit(0.0)) if not c.positive else hits.join(SCORES[scoring](index, c.positive), index.id_col, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    out = out.orderBy(F.col("score").desc(), index.id_col)
    return out if k is None else out.limit(k)
