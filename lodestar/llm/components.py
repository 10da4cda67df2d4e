"""Connected components by randomised contraction, on DataFrames only.

Every round each node follows the neighbour (or itself) with the smallest random priority; edges are
rewritten between the followed nodes. Expected rounds grow with the logarithm of the component size,
whatever the order of the ids. Priorities change each round, so sorted chains shrink as fast as others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import discard, materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): component is the smallest node reachable. Only nodes that have an edge are returned.

    Nulls and self-links are ignored; repeated edges count once.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = pairs.union(pairs.select("v", "u")).distinct()
    work, hops = materialize(both, "edges"), []
    while not work.isEmpty():
        seed = len(hops)
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("p"), F.col(c).alias("n"))
        best = work.groupBy("u").agg(F.min(rank("v")).alias("m"))
        hop = materialize(best.select("u", F.least("m", rank("u"))["n"].alias("to")), "hop")
        hops.append(hop)
        left = work.join(hop, "u").select(F.col("to").alias("x"), F.col("v"))
        right = hop.select(F.col("u").alias("v"), F.col("to").alias("y"))
        after = left.join(right, "v").where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct()
        new = materialize(after, "edges")
        discard(spark, work)
        work = new
    if not hops:
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    label = hops[0].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for hop in hops[1:]:
        step = hop.select(F.col("u").alias("root"), F.col("to").alias("next"))
        label = label.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    least = label.groupBy("root").agg(F.min("node").alias("component"))
    return label.join(least, "root").select("node", "component")
