"""The text index as Parquet tables: postings sorted by term, documents, vocabulary and the corpus' totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.search import TextIndex, text_index


def build(docs: DataFrame, path: str, id_col: str, text_col: str, analyzer: str = "spanish") -> TextIndex:
    """Analyze once, write; searches then read only the row groups of their terms."""
    spark = docs.sparkSession
    index = text_index(docs, id_col, text_col, analyzer)
    index.postings.repartitionByRange("term").sortWithinPartitions("term", id_col).write.mode("overwrite").parquet(f"{path}/postings")
    index.documents.write.mode("overwrite").parquet(f"{path}/documents")
    totals = spark.range(1).select(F.lit(id_col).alias("id_col"), F.lit(analyzer).alias("analyzer"), F.lit(index.n).cast("long").alias("n"), F.lit(float(index.average_length)).alias("average_length"))
    totals.write.mode("overwrite").parquet(f"{path}/totals")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> TextIndex:
    t = spark.read.parquet(f"{path}/totals").first()
    return TextIndex(t["id_col"], t["analyzer"], spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/documents"), t["n"], t["average_length"])
