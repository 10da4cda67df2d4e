from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.indexes.ivf import Cells
from lodestar.indexes.keys import DuplicateKey, HashedKeys, OrderedKeys
from lodestar.indexes.tiles import Tiles
from lodestar.operators import hybrid
from lodestar.operators.nearest import nearest_places, nearest_vectors
from lodestar.recommend import Conditions, recommend


def ids(df, name="id"):
    return [r[name] for r in df.collect()]


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(4)
    xy = np.concatenate([r.normal(0, 0.2, (300, 2)), r.uniform(-3, 3, (300, 2)), [[1, 1]] * 5])
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, lon double, lat double")


def test_tiles_answer_like_a_scan(spark, points, tmp_path):
    tiles = Tiles.build(points, f"file://{tmp_path}/t", "lon", "lat", per_tile=40)
    assert len(tiles.boxes()) > 8 and sum(b["points"] for b in tiles.boxes()) == points.count()
    from lodestar.functions.geo import haversine_km, within_box

    for center, km in (((0, 0), 30), ((1, 1), 0), ((5, 5), 100), ((-2.5, 2), 200)):
        want = points.where(haversine_km(F.col("lon"), F.col("lat"), *center) <= km)
        assert sorted(ids(tiles.in_radius(center, km))) == sorted(ids(want))
        for k in (1, 7, 1000):
            assert ids(tiles.nearest(center, k, "id")) == ids(nearest_places(points, "lon", "lat", center, k, "id"))
    assert sorted(ids(tiles.in_box((0.5, -1), (-0.5, 2)))) == sorted(ids(points.where(within_box(F.col("lon"), F.col("lat"), (0.5, -1), (-0.5, 2)))))
    plan = tiles.in_radius((0, 0), 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [tile" in plan


def test_key_indexes(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 10) for i in range(200)], "id int, g int")
    ordered = OrderedKeys.build(df, f"file://{tmp_path}/o", "id", 4, unique=True)
    assert ids(ordered.between(10, 20)) == list(range(10, 21))
    assert ids(ordered.between(10, 20, False, False)) == list(range(11, 20))
    assert ids(ordered.between(high=3)) == [0, 1, 2, 3] and ids(ordered.equal(7)) == [7] and ids(ordered.equal(-1)) == []
    hashed = HashedKeys.build(df, f"file://{tmp_path}/h", "g", 4)
    assert sorted(ids(hashed.equal(3))) == list(range(3, 200, 10)) and hashed.equal(11).count() == 0
    assert "PartitionFilters: [isnotnull(bucket" in hashed.equal(3)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(DuplicateKey):
        OrderedKeys.build(df, f"file://{tmp_path}/x", "g", unique=True)


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(1)
    centres = r.normal(0, 1, (6, 12))
    rows = [(i, [float(x) for x in centres[i % 6] + r.normal(0, 0.3, 12)], float(i % 50), "c" + str(i % 4), -77.0, -12.0) for i in range(400)]
    rows.append((400, [0.0] * 12, 1.0, "c0", -77.0, -12.0))
    return spark.createDataFrame(rows, "id long, embedding array<float>, price double, category string, lon double, lat double")


def test_cells(spark, vectors, tmp_path):
    cells = Cells.build(vectors, f"file://{tmp_path}/c", "embedding", "id", 10)
    query = [float(x) for x in vectors.where("id = 3").first()["embedding"]]
    exact = ids(nearest_vectors(vectors, "embedding", query, 10, "id"))
    recall = [len(set(ids(cells.search(query, 10, "id", p))) & set(exact)) for p in (1, 3, 10)]
    assert recall == sorted(recall) and recall[-1] == 10 and ids(cells.search(query, 10, "id", 10)) == exact
    assert "PartitionFilters: [cell" in cells.search(query, 10, "id", 2)._jdf.queryExecution().executedPlan().toString()
    assert ids(cells.search(query, 10, "id", 1, metric="L2")) == ids(nearest_vectors(vectors, "embedding", query, 10, "id", "L2"))
    assert len(ids(cells.search(query, None, "id", 1))) == 401
    cells.add(vectors.where("id = 3").withColumn("id", F.lit(999).cast("long")))
    assert set(ids(cells.search(query, 2, "id", 1))) == {3, 999}


def test_hybrid(spark, vectors, tmp_path):
    cells = Cells.build(vectors, f"file://{tmp_path}/c", "embedding", "id", 10)
    query = [float(x) for x in vectors.where("id = 3").first()["embedding"]]
    where = F.col("price") <= 2
    pre, plan = hybrid.hybrid_nearest(vectors, cells, query, 10, "id", where, ["range"], strategy="pre")
    assert plan.strategy == "pre" and ids(pre) == ids(nearest_vectors(vectors, "embedding", query, 10, "id", where=where))
    post, plan = hybrid.hybrid_nearest(vectors, cells, query, 10, "id", where, ["range"], probes=1, strategy="post")
    found = ids(post)
    assert set(found) <= set(ids(vectors.where(where))) and (hybrid.warning(len(found), 10, plan) is None) == (len(found) == 10)
    assert hybrid.choose(cells, 401, 10, ["=", "="], 2).strategy == "pre"
    assert hybrid.choose(cells, 100_000, 10, ["range"], 5).strategy == "post" and hybrid.choose(cells, 401, 10, []).strategy == "post"
    with pytest.raises(ValueError):
        hybrid.choose(cells, 401, 10, [], strategy="both")


def test_recommendations(spark, vectors, tmp_path):
    cells = Cells.build(vectors, f"file://{tmp_path}/c", "embedding", "id", 10)
    c = Conditions(20.0, (-77.0, -12.0), 1.0, "c1")
    exact = recommend(vectors, "exact", 5, like=1, conditions=c).collect()
    assert exact and all(r["price"] <= 20 and r["category"] == "c1" and r["id"] != 1 for r in exact)
    assert ids(recommend(vectors, "embedding", 5, like=1, conditions=c, vectors=cells, probes=10)) == [r["id"] for r in exact]
    assert recommend(vectors, "exact", 1000, like=1).count() == 60
    with pytest.raises(ValueError):
        recommend(vectors, "magic", 5, like=1)


def test_hybrid_auto_finds_k_when_k_pass(spark, vectors, tmp_path):
    cells = Cells.build(vectors, f"file://{tmp_path}/c", "embedding", "id", 10)
    query = [float(x) for x in vectors.where("id = 3").first()["embedding"]]
    far = [r["id"] for r in cells.search(query, None, "id").collect()][-12:]  # the farthest rows: none in the nearest cell
    for where, count in ((F.col("id").isin(far), 10), (F.col("id") >= 0, 10)):
        rows, plan = hybrid.hybrid_nearest(vectors, cells, query, 10, "id", where, ["range"], probes=1)
        found = ids(rows)
        assert len(found) == count
        if plan.strategy == "pre":
            assert found == ids(nearest_vectors(vectors, "embedding", query, 10, "id", where=where))
    rows, plan = hybrid.hybrid_nearest(vectors, cells, query, 10, "id", F.col("id").isin(far), ["range"], probes=1, rows=100_000)
    assert plan.strategy == "pre" and len(ids(rows)) == 10
