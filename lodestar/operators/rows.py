"""Filters, order, top-k and pages on DataFrames."""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
FLIPPED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def cut_bytes(text: str, n: int) -> str:
    """At most n bytes of UTF-8, on a character boundary."""
    return text.encode()[:n].decode(errors="ignore")


def cut_bytes_column(text: Column, n: int) -> Column:
    """cut_bytes as an expression: characters are added as long as their bytes fit."""
    raw = F.encode(text, "UTF-8")
    next_byte = lambda p: F.conv(F.hex(F.substring(raw, p + 1, 1)), 16, 10).cast("int")
    starts = lambda p: F.coalesce(~next_byte(p).between(0x80, 0xBF), F.lit(True))
    size = F.when(F.octet_length(text) <= n, F.octet_length(text))
    for p in range(n, max(-1, n - 4), -1):
        size = size.when(starts(p), F.lit(p))
    fits = F.octet_length(text) <= n
    return F.when(fits, text).otherwise(F.decode(F.substring(raw, F.lit(1), size.otherwise(0)), "UTF-8"))


def compare(column: str, op: str, value, size: int | None = None, flipped: bool = False) -> Column:
    """``column op value`` (or ``value op column`` if flipped). A text is cut to the column's byte size first."""
    if isinstance(value, str) and size is not None:
        value = cut_bytes(value, size)
    return COMPARE[FLIPPED[op] if flipped else op](F.col(column), F.lit(value))


def bounds(conditions: Sequence[tuple[str, str, float]]) -> dict[str, tuple]:
    """(low, low included, high, high included) per column: the tightest; on ties the strict one."""
    out: dict[str, tuple] = {}
    for column, op, v in conditions:
        low, low_in, high, high_in = out.get(column, (None, True, None, True))
        if op in ("=", ">", ">=") and (low is None or v > low or (v == low and op == ">")):
            low, low_in = v, op != ">"
        if op in ("=", "<", "<=") and (high is None or v < high or (v == high and op == "<")):
            high, high_in = v, op != "<"
        out[column] = (low, low_in, high, high_in)
    return out


def within_bounds(conditions: Sequence[tuple[str, str, float]]) -> Column:
    """One range per column instead of all conditions; `!=` stays as it is."""
    out = F.lit(True)
    for column, (low, low_in, high, high_in) in bounds(conditions).items():
        if low is not None:
            out = out & COMPARE[">=" if low_in else ">"](F.col(column), F.lit(low))
        if high is not None:
            out = out & COMPARE["<=" if high_in else "<"](F.col(column), F.lit(high))
    for column, op, v in conditions:
        if op == "!=":
            out = out & (F.col(column) != F.lit(v))
    return out


def top_k(df: DataFrame, key: Column | str, k: int | None, tie: str, descending: bool = False) -> DataFrame:
    """Ordered by ``key`` and then by ``tie`` ascending, also for descending keys; all rows if k is None."""
    key = F.col(key) if isinstance(key, str) else key
    out = df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col(tie).asc())
    return out if k is None else out.limit(k)


def page(ordered: DataFrame, number: int, size: int) -> DataFrame:
    """The ``number``-th page (from 1) of an ordered result."""
    if number < 1 or size < 1:
        raise ValueError("pages and their size count from 1")
    return ordered.offset((number - 1) * size).limit(size)


def page_of(ordered: DataFrame, number: int, size: int) -> tuple[DataFrame, int]:
    """A page, and how many rows the whole result has."""
    return page(ordered, number, size), ordered.count()
