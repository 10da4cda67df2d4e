"""From raw documents to packed training sequences in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the
columns of ``documents``. The result of a stage is written as Parquet and read again as the next one's docs; only then
is the next stage called, which deletes the tables that the one before left for its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, packing, quality, simhash, substrings
from lodestar.llm.common import discard, fresh, materialize, release, table

#: Passages of this many words (over 50) that a text shares with an earlier place are cut.
REPEAT_WORDS = 51


def same_columns(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; n_chars is that of the text as it is now."""
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else kept.select(docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    score = fresh("lodestar_score", docs.columns)
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality")
    return quality.scored(docs, model, score_col=score).where(F.col(score) >= 0.3).drop(score)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return same_columns(substrings.without_repeated_words(docs, REPEAT_WORDS), docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return same_columns(decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark")), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_copies),
    ("substrings", repeated_passages),
    ("decontamination", benchmark_passages),
    ("packing", packed),
]

#: Neither the network, XXH64 fingerprints nor the tokenizer can be written in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(spark, before)
        before = docs
    release(spark)
    return docs
