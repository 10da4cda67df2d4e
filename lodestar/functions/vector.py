"""Distances between float arrays as higher-order expressions, summed in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float] | Column) -> Column:
    return values if isinstance(values, Column) else F.array(*[F.lit(float(v)) for v in values])


def same_size(a: Column, b: Column) -> Column:
    """``a``, with an error where both vectors are there and have different dimensions."""
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimensions"))).otherwise(a)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column, b: Sequence[float] | Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    b = vector(b)
    return F.sqrt(F.aggregate(F.zip_with(same_size(a, b), b, square), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Sequence[float] | Column) -> Column:
    """One minus the cosine; 1 where either side has length zero."""
    b = vector(b)
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, F.lit(1.0)).otherwise(1 - _dot(same_size(a, b), b) / norms)


DISTANCES = {"L2": l2_distance, "COSINE": cosine_distance}


def rounded(x: Column) -> Column:
    """Six decimals, without negative zero."""
    return F.round(x, 6) + F.lit(0.0)
