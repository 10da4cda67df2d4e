"""Made-up employees, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = "Ana Luis Eva Juan Rosa Pedro Lucia Mario Carla Hugo".split()
LAST = "Vega Soto Luna Rios Paz Mora Cruz Leon Gil Rey".split()
DEPARTMENTS = "Sales Support Legal Finance Design Research".split()


def employees(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """id 1..n, name, dept and salary from 1025 to 15000."""
    pick = lambda words, k: F.array(*[F.lit(w) for w in words])[F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(len(words))).cast("int")]
    salary = F.lit(1025) + F.pmod(F.xxhash64(F.lit(seed), F.lit(3), "id"), F.lit(1_397_501)) / 100
    rows = spark.range(1, n + 1).select(F.col("id").cast("int").alias("id"))
    return rows.select("id", F.concat_ws(" ", pick(FIRST, 0), pick(LAST, 1)).alias("name"), pick(DEPARTMENTS, 2).alias("dept"), F.round(salary, 2).alias("salary"))
