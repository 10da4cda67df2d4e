"""Key indexes: a key-ordered copy for equality and ranges, and hash partitions for equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class DuplicateKey(ValueError):
    pass


def check_unique(df: DataFrame, key: str) -> None:
    again = df.groupBy(key).count().where("count > 1").select(key).first()
    if again:
        raise DuplicateKey(f"the key {again[0]!r} occurs more than once")


class OrderedKeys:
    """Rows range-partitioned and sorted by a key: row groups' minimum and maximum answer equality and ranges."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    @staticmethod
    def build(df: DataFrame, path: str, key: str, partitions: int | None = None, unique: bool = False) -> OrderedKeys:
        if unique:
            check_unique(df, key)
        dealt = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
        dealt.sortWithinPartitions(key).write.mode("overwrite").parquet(path)
        return OrderedKeys(df.sparkSession, path, key)

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def equal(self, value) -> DataFrame:
        return self.table().where(F.col(self.key) == F.lit(value))

    def between(self, low=None, high=None, low_included: bool = True, high_included: bool = True) -> DataFrame:
        """Rows of a range in key order; None leaves an end open."""
        c, keep = F.col(self.key), F.lit(True)
        if low is not None:
            keep = keep & (c >= low if low_included else c > low)
        if high is not None:
            keep = keep & (c <= high if high_included else c < high)
        return self.table().where(keep).orderBy(self.key)


class HashedKeys:
    """Rows partitioned by a hash of the key: equality reads one folder."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    @staticmethod
    def bucket(key: Column, buckets: int) -> Column:
        return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(buckets)).cast("int")

    @staticmethod
    def build(df: DataFrame, path: str, key: str, buckets: int = 32, unique: bool = False) -> HashedKeys:
        if unique:
            check_unique(df, key)
        dealt = df.withColumn("bucket", HashedKeys.bucket(F.col(key), buckets)).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)
        return HashedKeys(df.sparkSession, path, key, buckets)

    def equal(self, value) -> DataFrame:
        """Rows of one key. The bucket is a constant, so partitions are pruned before files are listed."""
        import zlib

        b = zlib.crc32(str(value).encode()) % self.buckets
        return self.spark.read.parquet(self.path).where((F.col("bucket") == b) & (F.col(self.key) == F.lit(value))).drop("bucket")
