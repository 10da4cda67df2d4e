"""Column types of tables: whole numbers, floats, texts of bounded bytes, points and vectors, never null."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators.rows import cut_bytes, cut_bytes_column

MOST_CHARS, DEFAULT_TEXT, MOST_DIMENSIONS = 4000, 1024, 1000


class ValueProblem(ValueError):
    """A value that a column's type does not take."""


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # INT, FLOAT, CHAR, POINT or VECTOR
    size: int = 0  # bytes of a CHAR, dimension of a VECTOR
    key: bool = False

    def __post_init__(self) -> None:
        if self.kind not in ("INT", "FLOAT", "CHAR", "POINT", "VECTOR"):
            raise ValueError(f"no such type: {self.kind}")
        most = {"CHAR": MOST_CHARS, "VECTOR": MOST_DIMENSIONS}.get(self.kind)
        if most and not 1 <= self.size <= most:
            raise ValueError(f"the size of {self.kind} is from 1 to {most}")
        if self.key and self.kind in ("POINT", "VECTOR"):
            raise ValueError("a key is a number or a text")

    def spark(self) -> T.StructField:
        point = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
        kinds = {"INT": T.IntegerType(), "FLOAT": T.DoubleType(), "CHAR": T.StringType(), "POINT": point, "VECTOR": T.ArrayType(T.FloatType(), False)}
        return T.StructField(self.name, kinds[self.kind], True, {"kind": self.kind, "size": self.size, "key": self.key})

    def value(self, v):
        """A Python value in the column's domain; ValueProblem where it is not in it."""
        bad = ValueProblem(f"{self.name}: {v!r} is no {self.kind}")
        number = isinstance(v, (int, float)) and not isinstance(v, bool) and (isinstance(v, int) or math.isfinite(v))
        if self.kind == "INT":
            if not number or v != int(v) or not -(2**31) <= v < 2**31:
                raise bad
            return int(v)
        if self.kind == "FLOAT":
            if not number:
                raise bad
            return float(v) + 0.0
        if self.kind == "CHAR":
            if not isinstance(v, str):
                raise bad
            return cut_bytes(v, self.size).rstrip("\0")
        if isinstance(v, str):
            v = [float(x) for x in re.findall(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", v)]
        try:
            numbers = [float(x) for x in v]
        except (TypeError, ValueError):
            raise bad from None
        if len(numbers) != (2 if self.kind == "POINT" else self.size) or not all(map(math.isfinite, numbers)):
            raise bad
        if self.kind == "POINT":
            return {"lon": numbers[0] + 0.0, "lat": numbers[1] + 0.0}
        if any(abs(x) > 3.4028234663852886e38 for x in numbers):
            raise bad
        return numbers

    def from_text(self, text: Column) -> Column:
        """The column's value from CSV text, null where it has none. Numbers are trimmed, texts are not."""
        trimmed = F.trim(text)
        if self.kind == "INT":
            return F.when(trimmed.rlike(r"^[-+]?\d+$"), F.try_to_number(F.regexp_replace(trimmed, r"^\+", ""), F.lit("S9999999999")).cast("decimal(20,0)").try_cast("int"))
        if self.kind == "FLOAT":
            d = trimmed.try_cast("double")
            return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d + 0.0)
        if self.kind == "CHAR":
            return cut_bytes_column(text, self.size)
        numbers = F.transform(F.regexp_extract_all(text, F.lit(r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
        if self.kind == "POINT":
            return F.when(F.size(numbers) == 2, F.struct(F.element_at(numbers, 1).alias("lon"), F.element_at(numbers, 2).alias("lat")))
        return F.when(F.size(numbers) == self.size, numbers.cast("array<float>"))


def column(declaration: str) -> Field:
    """``name INT|INTEGER|FLOAT|CHAR(n)|VARCHAR(n)|TEXT[(n)]|POINT|VECTOR(n) [PRIMARY KEY]``."""
    m = re.fullmatch(r"\s*(\w+)\s+(\w+)(?:\((\d+)\))?(\s+primary\s+key)?\s*", declaration, re.IGNORECASE)
    if not m:
        raise ValueError(f"not a column: {declaration!r}")
    kind = {"INTEGER": "INT", "VARCHAR": "CHAR", "TEXT": "CHAR"}.get(m[2].upper(), m[2].upper())
    size = int(m[3]) if m[3] else DEFAULT_TEXT if m[2].upper() == "TEXT" else 0
    return Field(m[1].lower(), kind, size, bool(m[4]))
