"""Recommendations from a catalog of items: by vector, by visual words or by text, under conditions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.geo import within_radius
from lodestar.indexes.ivf import Cells
from lodestar.operators.nearest import nearest_vectors
from lodestar.operators.search import TextIndex, ranked

MOST = 60


@dataclass
class Conditions:
    """Optional limits: price up to, within km of a place, category."""

    most_price: float | None = None
    near: tuple[float, float] | None = None
    km: float | None = None
    category: str | None = None

    def column(self) -> Column | None:
        parts = []
        if self.most_price is not None:
            parts.append(F.col("price") <= self.most_price)
        if self.near is not None and self.km is not None:
            parts.append(within_radius(F.col("lon"), F.col("lat"), self.near, self.km))
        if self.category is not None:
            parts.append(F.col("category") == self.category)
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out


def recommend(items: DataFrame, method: str, k: int, id_col: str = "id", conditions: Conditions | None = None, query: Sequence[float] | str | None = None, like: int | None = None, vectors: Cells | None = None, text: TextIndex | None = None, probes: int = 5) -> DataFrame:
    """Up to k (1 to 60) items, best first.

    method: "embedding" (through the vector index), "exact" (all vectors), "text" or "bovw" (through a text index of
    words or visual words). ``like`` takes the query from a stored item, which is left out of the answer.
    """
    k = min(max(k, 1), MOST)
    where = (conditions or Conditions()).column()
    if like is not None:
        row = items.where(F.col(id_col) == like).select("embedding").first()
        query = row["embedding"] if row and query is None else query
        other = F.col(id_col) != like
        where = other if where is None else where & other
    if method == "exact":
        return nearest_vectors(items, "embedding", query, k, id_col, "COSINE", where)
    if method == "embedding":
        return vectors.search(query, k, id_col, probes, where)
    if method in ("text", "bovw"):
        allowed = None if where is None else items.where(where).select(F.col(id_col).alias(text.id_col))
        return ranked(text, query, k, "TFIDF", allowed)
    raise ValueError("the method is embedding, exact, text or bovw")
