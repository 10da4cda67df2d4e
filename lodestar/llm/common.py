"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark sends rows to Python in batches of up to 10,000 rows and 64 MB; texts need less of it at once. Shuffle files
#: of a written table are of no more use.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(4 << 20)), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": (None, "true")}


def tune(spark: SparkSession) -> None:
    """Settings of this session that still have Spark's own values."""
    for key, (default, value) in SETTINGS.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where none is set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    own = tempfile.mkdtemp(prefix="lodestar-shared-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and fixes row order and ids."""
    spark = df.sparkSession
    tune(spark)
    path = new_path(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lodestar_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete materialized tables (or paths) that nothing reads any more."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "lodestar_path", None)
        if name := getattr(t, "lodestar_table", None):
            spark.sql(f"drop table if exists {name}")
        if path:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


_LEFT: list[DataFrame] = []


def leave(*tables: DataFrame) -> None:
    """Tables that a result still reads: ``release`` deletes them once it has been written."""
    _LEFT.extend(tables)


def release(spark: SparkSession) -> None:
    tune(spark)
    discard(spark, *_LEFT)
    _LEFT.clear()


def bucketed(df: DataFrame, key: str, kind: str) -> DataFrame:
    """``df`` as a table bucketed by ``key``, in the shared folder: joins on it do not move the rows again."""
    spark = df.sparkSession
    tune(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"lodestar_{kind}_{uuid.uuid4().hex}", new_path(spark, kind)
    df.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.lodestar_table, out.lodestar_path = name, path
    return out


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def make_dir(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def held_out(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, is zero. A null id counts as the text ''."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def utf8(values: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b"" if v is None else v for v in values.cast(pa.binary()).to_pylist()]


def sliced(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of ``column`` (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def text_crc(value: object) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())
