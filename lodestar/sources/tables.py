"""Tables of Parquet snapshots that take inserts, CSV loads and deletes.

Every change writes a new folder and then a new version that names its folders, so readers see a whole version
or the one before. Rows have a hidden number in order of insertion. Inserts append a folder; deletes and
compaction rewrite. All file work goes through Spark and Hadoop's file system.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestar.indexes.keys import DuplicateKey, check_unique
from lodestar.types import Field, ValueProblem, column

ROW = "_rid"
#: About so many bytes in a file after compaction.
FILE_BYTES = 256 << 20


class TableError(ValueError):
    pass


class Tables:
    """The tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self) -> list[str]:
        fs, p = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def create(self, name: str, columns: Sequence[str], sequential: bool = False, checked: bool | None = None) -> Table:
        """``sequential`` tables need a key, keep it unique and are read in its order; others check it only if ``checked``."""
        fields = [column(c) for c in columns]
        if not fields or len({f.name for f in fields}) < len(fields):
            raise TableError("a table has columns of different names")
        keys = [f for f in fields if f.key]
        if len(keys) > 1 or (sequential and not keys):
            raise TableError("a table has at most one key, a sequential table has one")
        if name in self.names():
            raise TableError(f"there is a table {name}")
        table = Table(self, name, fields, sequential, sequential if checked is None else checked, [], 0, 0)
        table._commit([], 0)
        return table

    def open(self, name: str) -> Table:
        fs, p = self._fs(f"{self.root}/{name}/versions")
        if not fs.exists(p):
            raise TableError(f"there is no table {name}")
        last = max(int(s.getPath().getName()) for s in fs.listStatus(p))
        meta = json.loads(self.spark.read.text(f"{self.root}/{name}/versions/{last}", wholetext=True).first()[0])
        return Table(self, name, [Field(**f) for f in meta["fields"]], meta["sequential"], meta["checked"], meta["folders"], meta["next_row"], last)

    def drop(self, name: str) -> None:
        self.open(name)
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)


class Table:
    def __init__(self, tables: Tables, name: str, fields: list[Field], sequential: bool, checked: bool, folders: list[str], next_row: int, version: int):
        self.tables, self.name, self.fields, self.sequential, self.checked = tables, name, fields, sequential, checked
        self.folders, self.next_row, self.version = folders, next_row, version
        self.spark, self.path = tables.spark, f"{tables.root}/{name}"
        self.key = next((f.name for f in fields if f.key), None)
        self.schema = StructType([StructField(ROW, LongType(), False), *[f.spark() for f in fields]])

    def _commit(self, folders: list[str], next_row: int) -> None:
        meta = {"fields": [vars(f) for f in self.fields], "sequential": self.sequential, "checked": self.checked, "folders": folders, "next_row": next_row}
        fs, p = self.tables._fs(f"{self.path}/versions/{self.version + 1}")
        if fs.exists(p):
            raise TableError("another writer was first: open the table again")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        self.folders, self.next_row, self.version = folders, next_row, self.version + 1

    def rows(self, row_numbers: bool = False, folders: list[str] | None = None) -> DataFrame:
        """All rows, or those of some folders: in key order for sequential tables, else in order of insertion when sorted by the hidden number."""
        folders = self.folders if folders is None else folders
        df = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)
        return df if row_numbers else df.drop(ROW)

    def ordered(self) -> DataFrame:
        return self.rows(True).orderBy(*([self.key] if self.sequential else []), ROW).drop(ROW)

    def _write(self, df: DataFrame, files: int | None = None) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        number = [files] if files else []
        if self.sequential:
            dealt = df.repartitionByRange(*number, self.key).sortWithinPartitions(self.key)
        else:
            dealt = df.repartitionByRange(files, ROW).sortWithinPartitions(ROW) if files else df
        dealt.write.parquet(f"{self.path}/{folder}")
        return folder

    def _append(self, df: DataFrame, size: int) -> int:
        """df has the hidden number already."""
        if not size:
            return 0
        if self.checked and self.key:
            check_unique(df, self.key)
            clash = df.join(self.rows(), self.key, "left_semi").select(self.key).first()
            if clash:
                raise DuplicateKey(f"the key {clash[0]!r} is in the table")
        self._commit([*self.folders, self._write(df)], self.next_row + size)
        return size

    def insert(self, values: Iterable[Sequence]) -> int:
        """Add rows given as tuples. Rows before the first bad one are kept, then its problem is raised."""
        good, problem, seen = [], None, set()
        place = next((i for i, f in enumerate(self.fields) if f.key), None)
        for row in values:
            try:
                if len(row) != len(self.fields):
                    raise ValueProblem(f"{len(row)} values for {len(self.fields)} columns")
                row = tuple(f.value(v) for f, v in zip(self.fields, row))
                if self.checked and place is not None:
                    if row[place] in seen:
                        raise DuplicateKey(f"the key {row[place]!r} is given twice")
                    seen.add(row[place])
            except ValueError as e:
                problem = e
                break
            good.append(row)
        if self.checked and place is not None and good:
            known = {r[0] for r in self.rows().where(F.col(self.key).isin([r[place] for r in good])).select(self.key).collect()}
            first = next((i for i, r in enumerate(good) if r[place] in known), None)
            if first is not None:
                problem, good = DuplicateKey(f"the key {good[first][place]!r} is in the table"), good[:first]
        if good:
            df = self.spark.createDataFrame([(self.next_row + i, *r) for i, r in enumerate(good)], self.schema)
            self._commit([*self.folders, self._write(df)], self.next_row + len(good))
        if problem:
            raise problem
        return len(good)

    def copy_csv(self, path: str, delimiter: str = ",") -> int:
        """Load a CSV file. Its first line is skipped if it names the columns; blank lines are skipped.

        A wrong number of fields or a bad number fails the whole load, with the line's content.
        """
        names = [f.name for f in self.fields]
        lines = self.spark.read.option("header", False).option("sep", delimiter).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(", ".join(f"c{i} string" for i in range(len(names))) + ", _bad string").csv(path)
        raw = [F.col(f"c{i}") for i in range(len(names))]
        first = self.spark.read.text(path).limit(1).collect()
        header = bool(first) and [x.strip().strip('"').lower() for x in first[0][0].split(delimiter)] == names
        if header:
            is_header = F.lit(True)
            for c, n in zip(raw, names):
                is_header = is_header & (F.lower(F.trim(c)) == n)
            lines = lines.where(~F.coalesce(is_header, F.lit(False)))
        typed = [f.from_text(F.coalesce(c, F.lit(""))) for f, c in zip(self.fields, raw)]
        whole = F.concat_ws(delimiter, *raw)
        wrong = F.col("_bad").isNotNull()
        for t in typed:
            wrong = wrong | t.isNull()
        checked = F.when(wrong, F.raise_error(F.concat(F.lit("bad line: "), F.coalesce("_bad", whole))).cast("long")).otherwise(F.monotonically_increasing_id())
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        lines.select(checked.alias(ROW), *[t.alias(n) for t, n in zip(typed, names)]).write.parquet(staged)  # numbers rise with the lines
        read = self.spark.read.parquet(staged)
        try:
            rows, last = read.agg(F.count(F.lit(1)), F.max(ROW)).first()  # row numbers have gaps between partitions
            self._append(read.withColumn(ROW, F.col(ROW) + self.next_row), int(-1 if last is None else last) + 1)
            return rows
        finally:
            fs, p = self.tables._fs(staged)
            fs.delete(p, True)

    def delete(self, where: Column | None = None) -> int:
        """Remove the rows that meet a condition (all rows without one)."""
        gone = self.rows().count() if where is None else self.rows().where(where).count()
        if gone:
            left = [] if where is None else [self._write(self.rows(True).where(~F.coalesce(where, F.lit(False))))]
            self._commit(left, self.next_row)
        return gone

    def compact(self) -> None:
        """One folder of few files instead of many; sequential tables are dealt by key again."""
        fs, _ = self.tables._fs(self.path)
        sizes = [s.getLen() for f in self.folders for s in fs.listStatus(self.tables._fs(f"{self.path}/{f}")[1]) if s.getPath().getName().endswith(".parquet")]
        files = max(1, -(-sum(sizes) // FILE_BYTES))
        if len(self.folders) > 1 or len(sizes) > files:
            self._commit([self._write(self.rows(True), files)], self.next_row)

    def info(self) -> dict:
        """What a client lists: columns, order, rows, folders, files and bytes."""
        files, size = 0, 0
        for folder in self.folders:
            fs, p = self.tables._fs(f"{self.path}/{folder}")
            s = fs.getContentSummary(p)
            files, size = files + s.getFileCount(), size + s.getLength()
        return {"name": self.name, "columns": [vars(f) for f in self.fields], "sequential": self.sequential, "rows": self.rows().count(), "folders": len(self.folders), "files": files, "bytes": size, "version": self.version}
