"""Spatial tiles: points packed into slabs of longitude and, inside them, of latitude.

Slab borders come from approximate quantiles, so no window ranks the whole table in one task. The small table
of tile boxes (one row per tile) is read by the driver and turned into a list of tiles to scan.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.geo import haversine_km, radius_box, within_box, within_radius

#: Most tiles, so that the table of boxes stays small enough for the driver.
MOST_TILES = 16_384


class Tiles:
    def __init__(self, spark: SparkSession, path: str, lon: str, lat: str):
        self.spark, self.path, self.lon, self.lat = spark, path, lon, lat

    @staticmethod
    def build(df: DataFrame, path: str, lon: str, lat: str, per_tile: int = 100_000) -> Tiles:
        """Sort-tile-recursive packing with about ``per_tile`` points in a tile (more once there are MOST_TILES)."""
        spark, n = df.sparkSession, df.count()
        side = max(1, math.ceil(math.sqrt(min(MOST_TILES, -(-n // per_tile)))))
        cuts = [i / side for i in range(1, side)]
        lons = df.approxQuantile(lon, cuts, 0.1 / side) if cuts and n else []
        slab = lambda c, edges: sum((F.when(c > e, 1).otherwise(0) for e in edges), F.lit(0))
        slabbed = df.withColumn("slab", slab(F.col(lon), lons).cast("int"))
        edges = slabbed.groupBy("slab").agg(F.percentile_approx(lat, F.array(*[F.lit(c) for c in cuts]), F.lit(100 * side)).alias("edges")) if cuts else None
        if edges is None:
            tiled = slabbed.withColumn("tile", F.lit(0))
        else:
            inner = F.size(F.filter("edges", lambda e: F.col(lat) > e))
            tiled = slabbed.join(F.broadcast(edges), "slab", "left").withColumn("tile", F.col("slab") * side + F.coalesce(inner, F.lit(0))).drop("edges")  # at most 128 slabs
        tiled.drop("slab").repartition("tile").sortWithinPartitions("tile").write.mode("overwrite").partitionBy("tile").parquet(f"{path}/points")
        boxes = spark.read.parquet(f"{path}/points").groupBy("tile").agg(F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"), F.count(F.lit(1)).alias("points"))
        boxes.coalesce(1).write.mode("overwrite").parquet(f"{path}/boxes")
        return Tiles(spark, path, lon, lat)

    def boxes(self) -> list:
        return self.spark.read.parquet(f"{self.path}/boxes").collect()

    def scan(self, tiles: list[int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/points").where(F.col("tile").isin(tiles)).drop("tile")

    def in_box(self, p: tuple[float, float], q: tuple[float, float]) -> DataFrame:
        west, east, south, north = min(p[0], q[0]), max(p[0], q[0]), min(p[1], q[1]), max(p[1], q[1])
        hit = [b["tile"] for b in self.boxes() if b["west"] <= east and b["east"] >= west and b["south"] <= north and b["north"] >= south]
        return self.scan(hit).where(within_box(F.col(self.lon), F.col(self.lat), p, q))

    def in_radius(self, center: tuple[float, float], km: float) -> DataFrame:
        """Tiles whose box meets the circle's box (all tiles near a pole or the date line), then the exact distance."""
        box = radius_box(*center, km * (1 + 1e-9) + 1e-9)
        hit = [b["tile"] for b in self.boxes() if box is None or (b["west"] <= box[2] and b["east"] >= box[0] and b["south"] <= box[3] and b["north"] >= box[1])]
        return self.scan(hit).where(within_radius(F.col(self.lon), F.col(self.lat), center, km))

    def nearest(self, center: tuple[float, float], k: int, id_col: str) -> DataFrame:
        """The k nearest, ties by id, exactly: the tiles around the centre that hold k points bound the k-th distance."""
        boxes = sorted(self.boxes(), key=lambda b: max(b["west"] - center[0], 0, center[0] - b["east"]) ** 2 + max(b["south"] - center[1], 0, center[1] - b["north"]) ** 2)
        close, held = [], 0
        for b in boxes:
            close.append(b["tile"])
            held += b["points"]
            if held >= k:
                break
        km = haversine_km(F.col(self.lon), F.col(self.lat), *center)
        near = self.scan(close).select(km.alias("km")).orderBy("km").limit(k).agg(F.max("km"), F.count(F.lit(1))).first()
        rows = self.in_radius(center, near[0]) if near[1] == k else self.scan([b["tile"] for b in boxes])
        return rows.withColumn("km", km).orderBy("km", id_col).limit(k)
