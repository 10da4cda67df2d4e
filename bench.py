"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query is run once to compile, then three times; the median counts. Indexes are built once and reported
under build_*, since the numbers to compare with are of searches in built indexes.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar import queries as q
from lodestar.functions.geo import within_radius
from lodestar.indexes import inverted
from lodestar.indexes.ivf import Cells
from lodestar.indexes.tiles import Tiles
from lodestar.operators import search
from lodestar.operators.nearest import nearest_places, nearest_vectors
from lodestar.scratch import table

RUNS = 3


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    work = f"file://{tempfile.mkdtemp(prefix='lodestar-bench-')}"
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", work)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, f):
        start = time.perf_counter()
        out = f()
        times[name] = round(time.perf_counter() - start, 4)
        return out

    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    text = timed("build_inverted", lambda: inverted.build(docs, f"{work}/text", "doc_id", "text", "english"))
    cells = timed("build_ivf", lambda: Cells.build(vectors, f"{work}/ivf", "embedding", "vec_id", 44))
    tiles = timed("build_tiles", lambda: Tiles.build(q.geo(spark, d), f"{work}/tiles", "lon", "lat", 100))
    v0 = q.vector_of(spark, d, 0)
    lon, lat = F.col("lon"), F.col("lat")
    headline = {
        "filter_eq": lambda: q.QUERIES["filter_eq"](spark, d),
        "range_merge": lambda: q.QUERIES["range_merge"](spark, d),
        "top_k_desc": lambda: q.QUERIES["top_k_desc"](spark, d),
        "vec_knn_exact": lambda: nearest_vectors(vectors, "embedding", v0, 10, "vec_id"),
        "vec_knn_ivf_5": lambda: cells.search(v0, 10, "vec_id", 5),
        "geo_radius_scan": lambda: q.geo(spark, d).where(within_radius(lon, lat, q.CENTER, 2.5)),
        "geo_radius_tiles": lambda: tiles.in_radius(q.CENTER, 2.5),
        "geo_knn_scan": lambda: nearest_places(q.geo(spark, d), "lon", "lat", q.CENTER, 10, "vec_id"),
        "geo_knn_tiles": lambda: tiles.nearest(q.CENTER, 10, "vec_id"),
        "match_and_3": lambda: search.matching(text, "thor AND thin AND heer"),
        "match_or_3": lambda: search.matching(text, "thor OR thin OR heer"),
        "tfidf_top10": lambda: search.ranked(text, "thor thin heer", 10),
        "bm25_top10": lambda: search.ranked(text, "thor thin heer", 10, "BM25"),
        "hybrid_all": lambda: q.QUERIES["hybrid_all"](spark, d),
        "events_windowed": lambda: q.QUERIES["events_windowed"](spark, d),
        "events_sessions": lambda: q.QUERIES["events_sessions"](spark, d),
    }
    for name, f in headline.items():
        runs = []
        for k in range(RUNS + 1):
            start = time.perf_counter()
            f().collect()
            if k:
                runs.append(time.perf_counter() - start)
        times[name] = round(median(runs), 4)
    value = round(sum(times[n] for n in headline), 4)
    print(json.dumps({"metric": "headline queries, sum of median seconds", "value": value, "unit": "sec", "queries": times, "sf": d.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
