"""Named indexes of tables. Each knows the data folders it was built over, so a search never gives old rows.

Key and vector indexes get a further segment for every folder that an insert added; text and place indexes, and all
indexes after a delete, are written again before their next use. Segments hold whole rows, as Parquet.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.vector import DISTANCES
from lodestar.indexes import inverted
from lodestar.indexes.ivf import PROBES, Cells, train_centres
from lodestar.indexes.keys import HashedKeys, OrderedKeys, check_unique
from lodestar.indexes.tiles import Tiles
from lodestar.operators import search
from lodestar.operators.hybrid import SELECTIVITY
from lodestar.operators.rows import top_k
from lodestar.sources.tables import ROW, Table, TableError, Tables

# Per kind: the column types it suits, its options with their defaults, and whether inserts add segments.
KINDS = {
    "BTREE": (("INT", "FLOAT", "CHAR"), {}, True),
    "HASH": (("INT", "FLOAT", "CHAR"), {"buckets": 32}, True),
    "RTREE": (("POINT",), {"per_tile": 100_000}, False),
    "INVERTED": (("CHAR",), {"analyzer": "spanish"}, False),
    "IVF": (("VECTOR",), {"lists": None, "metric": "COSINE"}, True),
}
#: What a condition may use: the kinds of index, best first, and the fixed share of rows it is taken to keep.
USES = {"=": (("HASH", "BTREE"), "="), "range": (("BTREE",), "range"), "spatial": (("RTREE",), "spatial"), "text": (("INVERTED",), "text")}
LON, LAT = "_lon", "_lat"


class Indexes:
    """All indexes of the tables below one folder; their names are unique there."""

    def __init__(self, tables: Tables):
        self.tables, self.spark = tables, tables.spark

    def _names(self, table: str) -> list[str]:
        fs, p = self.tables._fs(f"{self.tables.root}/{table}/indexes")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def names(self) -> dict[str, str]:
        """Index to table."""
        return {i: t for t in self.tables.names() for i in self._names(t)}

    def of(self, table: Table) -> list[Index]:
        return [Index.read(table, name) for name in self._names(table.name)]

    def create(self, table: Table, name: str, column: str, kind: str = "BTREE", **options) -> Index:
        """One index of a kind per column. A key's BTREE or HASH makes the table keep it unique from then on."""
        field = next((f for f in table.fields if f.name == column), None)
        if kind not in KINDS or field is None:
            raise TableError(f"no column {column} or no kind of index {kind}")
        types, known, _ = KINDS[kind]
        if field.kind not in types:
            raise TableError(f"{kind} does not suit {field.kind}")
        if set(options) - set(known):
            raise TableError(f"unknown option: {', '.join(sorted(set(options) - set(known)))}")
        if name in self.names():
            raise TableError(f"there is an index {name}")
        if any((i.column, i.kind) == (column, kind) for i in self.of(table)):
            raise TableError(f"{column} has an index of kind {kind}")
        if field.key and kind in ("BTREE", "HASH") and not table.checked:
            check_unique(table.rows(), column)
            table.checked = True
            table._commit(table.folders, table.next_row)
        index = Index(table, name, column, kind, {**known, **options}, [], 0)
        index.fresh()
        return index

    def open(self, table: Table, name: str) -> Index:
        if name not in self._names(table.name):
            raise TableError(f"there is no index {name}")
        return Index.read(table, name)

    def drop(self, name: str) -> None:
        table = self.names().get(name)
        if table is None:
            raise TableError(f"there is no index {name}")
        fs, p = self.tables._fs(f"{self.tables.root}/{table}/indexes/{name}")
        fs.delete(p, True)

    def paths(self, table: Table, conditions: Sequence[tuple[str, str]]) -> DataFrame:
        """(path, structure, index, estimated_rows, chosen) for conditions (column, "=" | "range" | "spatial" | "text").

        The ways to read the rows, by the fixed selectivities; nothing but a count is run.
        """
        n, indexes = table.rows().count(), self.of(table)
        found = [("scan", "SEQUENTIAL" if table.sequential else "HEAP", None, float(n))]
        for column, kind in conditions:
            kinds, share = USES[kind]
            found += [(f"{kind} on {column}", i.kind, i.name, n * SELECTIVITY[share]) for k in kinds for i in indexes if i.column == column and i.kind == k]
        best = min(range(len(found)), key=lambda i: found[i][3])
        rows = [(*f, i == best) for i, f in enumerate(found)]
        return self.spark.createDataFrame(rows, "path string, structure string, index string, estimated_rows double, chosen boolean")


class Index:
    def __init__(self, table: Table, name: str, column: str, kind: str, options: dict, segments: list[dict], version: int):
        self.table, self.name, self.column, self.kind, self.options = table, name, column, kind, options
        self.segments, self.version = segments, version
        self.spark, self.path = table.spark, f"{table.path}/indexes/{name}"

    @staticmethod
    def read(table: Table, name: str) -> Index:
        base = f"{table.path}/indexes/{name}/versions"
        fs, p = table.tables._fs(base)
        last = max(int(s.getPath().getName()) for s in fs.listStatus(p))
        meta = json.loads(table.spark.read.text(f"{base}/{last}", wholetext=True).first()[0])
        return Index(table, name, meta["column"], meta["kind"], meta["options"], meta["segments"], last)

    @property
    def stale(self) -> bool:
        return not self.version or [f for s in self.segments for f in s["covers"]] != self.table.folders

    def fresh(self) -> Index:
        """Brought up to the table as it is opened here."""
        if not self.stale:
            return self
        covered = [f for s in self.segments for f in s["covers"]]
        added = self.table.folders[len(covered) :]
        if covered and KINDS[self.kind][2] and self.table.folders[: len(covered)] == covered:
            segments = [*self.segments, self._segment(added)]
        else:
            segments = [self._segment(self.table.folders)]
        fs, p = self.table.tables._fs(f"{self.path}/versions/{self.version + 1}")
        if fs.exists(p):
            raise TableError("another writer was first: open the index again")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps({"column": self.column, "kind": self.kind, "options": self.options, "segments": segments}).encode()))
        out.close()
        self.segments, self.version = segments, self.version + 1
        return self

    def _segment(self, folders: list[str]) -> dict:
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        rows = self.table.rows(True, folders)
        if self.kind != "INVERTED" and rows.isEmpty():
            return {"folder": None, "covers": list(folders)}
        if self.kind == "BTREE":
            OrderedKeys.build(rows, folder, self.column)
        elif self.kind == "HASH":
            HashedKeys.build(rows, folder, self.column, self.options["buckets"])
        elif self.kind == "RTREE":
            point = F.col(self.column)
            Tiles.build(rows.withColumn(LON, point["lon"]).withColumn(LAT, point["lat"]), folder, LON, LAT, self.options["per_tile"])
        elif self.kind == "INVERTED":
            inverted.build(rows, folder, ROW, self.column, self.options["analyzer"])
        else:
            Cells.build(rows, folder, self.column, ROW, metric=self.options["metric"], centres=self._centres(rows))
        return {"folder": folder, "covers": list(folders)}

    def _centres(self, rows: DataFrame) -> np.ndarray:
        """Learned once from a bounded sample; kept over inserts and deletes, learned again where there were none."""
        path = f"{self.path}/centres"
        fs, p = self.table.tables._fs(f"{path}/_SUCCESS")
        if fs.exists(p):
            return np.array([r["centre"] for r in self.spark.read.parquet(path).orderBy("cell").collect()])
        centres = train_centres(rows, self.column, ROW, self.options["lists"], self.options["metric"])
        if len(centres):
            self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(path)
        return centres

    def _union(self, of: Callable[[str], DataFrame]) -> DataFrame:
        empty = self.table.rows(True, [])
        return reduce(DataFrame.unionByName, [of(s["folder"]) for s in self.fresh().segments if s["folder"]] or [empty])

    def _only(self, *kinds: str) -> None:
        if self.kind not in kinds:
            raise TableError(f"{self.name} is {self.kind}, not {' or '.join(kinds)}")

    def equal(self, value) -> DataFrame:
        self._only("BTREE", "HASH")
        opened = (lambda p: OrderedKeys(self.spark, p, self.column)) if self.kind == "BTREE" else (lambda p: HashedKeys(self.spark, p, self.column, self.options["buckets"]))
        return self._union(lambda p: opened(p).equal(value)).drop(ROW)

    def between(self, low=None, high=None, low_included: bool = True, high_included: bool = True) -> DataFrame:
        self._only("BTREE")
        found = self._union(lambda p: OrderedKeys(self.spark, p, self.column).between(low, high, low_included, high_included))
        return found.orderBy(self.column, ROW).drop(ROW)

    def _places(self, of: Callable[[Tiles], DataFrame]) -> DataFrame:
        self._only("RTREE")
        return self._union(lambda p: of(Tiles(self.spark, p, LON, LAT)).drop(LON, LAT))

    def in_radius(self, center: tuple[float, float], km: float) -> DataFrame:
        return self._places(lambda t: t.in_radius(center, km)).drop(ROW)

    def in_box(self, p: tuple[float, float], q: tuple[float, float]) -> DataFrame:
        return self._places(lambda t: t.in_box(p, q)).drop(ROW)

    def nearest_places(self, center: tuple[float, float], k: int) -> DataFrame:
        """The k nearest rows, exactly, ties by order of insertion."""
        return self._places(lambda t: t.nearest(center, k, ROW).drop("km")).drop(ROW)

    def text(self) -> search.TextIndex:
        self._only("INVERTED")
        return inverted.load(self.spark, self.fresh().segments[0]["folder"])

    def matching(self, query: str) -> DataFrame:
        return self.table.rows(True).join(search.matching(self.text(), query), ROW, "left_semi").drop(ROW)

    def ranked(self, query: str, k: int | None = None, scoring: str = "TFIDF") -> DataFrame:
        hits = search.ranked(self.text(), query, k, scoring)
        return self.table.rows(True).join(hits, ROW).orderBy(F.col("score").desc(), ROW).drop(ROW)

    def nearest(self, query: Sequence[float], k: int, probes: int = PROBES) -> DataFrame:
        """The k nearest rows of the probed cells of all segments."""
        self._only("IVF")
        self.fresh()
        size = next(f.size for f in self.table.fields if f.name == self.column)
        if len(query) != size:
            raise ValueError(f"{len(query)} numbers for vectors of {size}")
        metric, centres = self.options["metric"], self._centres(self.table.rows(True))

        def cells(path: str) -> DataFrame:
            rows = self.spark.read.parquet(path)
            probed = Cells(self.spark, path, self.column, metric, centres).probed(query, probes) if len(centres) else [0]
            return rows.where(F.col("cell").isin(probed)).drop("cell")

        return top_k(self._union(cells).withColumn("distance", DISTANCES[metric](F.col(self.column), query)), "distance", k, ROW).drop(ROW)
