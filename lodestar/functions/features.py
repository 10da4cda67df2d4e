"""Features of media rows: shorter vectors, and histograms of visual words."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.indexes.ivf import nearest_cell


def shortened(df: DataFrame, vector_col: str, size: int, out_col: str = "short") -> DataFrame:
    """Principal components (fitted on all rows; only the covariance comes to the driver), scaled to length one."""
    rows = df.withColumn("_v", array_to_vector(F.col(vector_col).cast("array<double>")))
    model = PCA(k=size, inputCol="_v", outputCol="_p").fit(rows.select("_v"))
    scaled = Normalizer(inputCol="_p", outputCol="_n").transform(model.transform(rows))
    return scaled.withColumn(out_col, vector_to_array("_n", "float32")).drop("_v", "_p", "_n")


def visual_words(descriptors: DataFrame, id_col: str, vector_col: str, centres: np.ndarray, metric: str = "L2") -> DataFrame:
    """(id, words): how often each centre is the nearest of an id's descriptors, as text like ``v3:2 v17:1``."""
    counts = descriptors.groupBy(id_col, nearest_cell(F.col(vector_col), centres, metric).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("w", "n"))).alias("l"))  # one entry per centre at most
    return listed.select(id_col, F.array_join(F.transform("l", lambda x: F.concat(F.lit("v"), x["w"], F.lit(":"), x["n"])), " ").alias("words"))
