"""Vector cells: k-means centres over a bounded sample, rows partitioned by their nearest centre.

A search ranks the centres on the driver (their number is bounded), reads the folders of the nearest cells and
ranks their rows exactly. With all cells probed the answer is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lodestar.functions.vector import DISTANCES
from lodestar.operators.rows import top_k

SAMPLE_ROWS, MOST_CELLS, PROBES = 50_000, 4096, 5


def distances(metric: str, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if metric == "L2":
        return np.sqrt(((rows - query) ** 2).sum(1))
    norms = np.linalg.norm(rows, axis=1) * np.linalg.norm(query)
    return np.where(norms > 0, 1 - rows @ query / np.where(norms > 0, norms, 1), 1.0)


def _nearest(metric: str, rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Per row the nearest centre, by one matrix product; rows without a direction go to the first."""
    if metric == "L2":
        return np.argmin((centres**2).sum(1) - 2 * (rows @ centres.T), axis=1)
    norms = np.linalg.norm(centres, axis=1)
    dots = (rows @ centres.T) / np.where(norms > 0, norms, 1)
    sizes = np.linalg.norm(rows, axis=1)[:, None]
    return np.argmin(np.where((sizes > 0) & (norms > 0), 1 - dots / np.where(sizes > 0, sizes, 1), 1.0), axis=1)


def train_centres(df: DataFrame, vector_col: str, id_col: str, cells: int | None = None, metric: str = "COSINE", seed: int = 42) -> np.ndarray:
    """Centres from at most SAMPLE_ROWS rows chosen by a hash of their id; the root of the row count unless given."""
    n = df.count()
    cells = min(cells or max(1, int(n**0.5)), MOST_CELLS, max(n, 1))
    usable = df.where(F.col(vector_col).isNotNull())
    if metric == "COSINE":  # vectors of length zero have no direction
        usable = usable.where(F.exists(vector_col, lambda x: x != 0))
    sample = usable.orderBy(F.xxhash64(F.lit(seed), id_col)).limit(SAMPLE_ROWS)
    sample = sample.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"))
    if sample.isEmpty():
        return np.zeros((0, 0))
    if cells == 1:
        size = len(sample.first()["features"])
        return np.zeros((1, size))
    model = KMeans(k=cells, seed=seed, maxIter=20, distanceMeasure="cosine" if metric == "COSINE" else "euclidean").fit(sample)
    return np.array(model.clusterCenters())


def nearest_cell(vector: Column, centres: np.ndarray, metric: str = "COSINE") -> Column:
    """Number of the nearest centre, the smallest on ties; -1 for null vectors."""
    @F.pandas_udf(IntegerType())
    def assign(rows: pd.Series) -> pd.Series:
        out = np.full(len(rows), -1, np.int32)
        known = np.flatnonzero(rows.notna().to_numpy())
        step = max(1, (1 << 22) // len(centres))
        for s in range(0, len(known), step):
            some = known[s : s + step]
            out[some] = _nearest(metric, np.stack(rows.iloc[some].to_list()).astype(float), centres)
        return pd.Series(out)

    return assign(vector)


class Cells:
    def __init__(self, spark: SparkSession, path: str, vector_col: str, metric: str, centres: np.ndarray):
        self.spark, self.path, self.vector_col, self.metric, self.centres = spark, path, vector_col, metric, centres

    @staticmethod
    def build(df: DataFrame, path: str, vector_col: str, id_col: str, cells: int | None = None, metric: str = "COSINE", seed: int = 42, centres: np.ndarray | None = None) -> Cells:
        centres = train_centres(df, vector_col, id_col, cells, metric, seed) if centres is None else centres
        cell = nearest_cell(F.col(vector_col), centres, metric) if len(centres) else F.lit(0)
        df.withColumn("cell", cell).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)
        return Cells(df.sparkSession, path, vector_col, metric, centres)

    def add(self, rows: DataFrame) -> None:
        """New rows go to the nearest existing cells; the centres stay."""
        rows.withColumn("cell", nearest_cell(F.col(self.vector_col), self.centres, self.metric)).write.mode("append").partitionBy("cell").parquet(self.path)

    def probed(self, query: Sequence[float], probes: int = PROBES) -> list[int]:
        return np.argsort(distances(self.metric, np.asarray(query, float), self.centres), kind="stable")[:probes].tolist()

    def search(self, query: Sequence[float], k: int | None, id_col: str, probes: int = PROBES, where: Column | None = None, metric: str | None = None) -> DataFrame:
        """The k nearest rows of the nearest cells. Another metric than the index's, or no limit, scans all cells exactly."""
        rows = self.spark.read.parquet(self.path)
        metric = metric or self.metric
        if k is not None and metric == self.metric:
            rows = rows.where(F.col("cell").isin(self.probed(query, probes)))
        rows = rows.drop("cell") if where is None else rows.drop("cell").where(where)
        return top_k(rows.withColumn("distance", DISTANCES[metric](F.col(self.vector_col), query)), "distance", k, id_col)
