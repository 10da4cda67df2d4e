"""Nearest neighbours, exact: vectors by L2 or cosine distance, places by great-circle distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.geo import haversine_km
from lodestar.functions.vector import DISTANCES
from lodestar.operators.rows import top_k


def nearest_vectors(df: DataFrame, vector_col: str, query: Sequence[float], k: int, id_col: str, metric: str = "COSINE", where: Column | None = None) -> DataFrame:
    """The k rows nearest to ``query`` with their distance, ties by id; filtered before ranking."""
    df = df if where is None else df.where(where)
    return top_k(df.withColumn("distance", DISTANCES[metric](F.col(vector_col), query)), "distance", k, id_col)


def nearest_places(df: DataFrame, lon_col: str, lat_col: str, center: tuple[float, float], k: int, id_col: str, where: Column | None = None) -> DataFrame:
    df = df if where is None else df.where(where)
    return top_k(df.withColumn("km", haversine_km(F.col(lon_col), F.col(lat_col), *center)), "km", k, id_col)
