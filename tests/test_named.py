from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestar.functions.geo import within_radius
from lodestar.functions.match import condition
from lodestar.functions.text import words
from lodestar.indexes.keys import DuplicateKey
from lodestar.operators.rows import page_of
from lodestar.sources.named import Indexes
from lodestar.sources.tables import TableError, Tables

PLACES = ["id INT PRIMARY KEY", "name CHAR(20)", "place POINT", "review CHAR(80)", "v VECTOR(3)"]
ROWS = [(i, f"n{i % 4}", (-77.0 + i / 100, -12.0), "red shoes" if i % 2 else "blue shirt", (1.0, i / 10, 0.0)) for i in range(20)]


@pytest.fixture
def made(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/db").create("places", PLACES)
    t.insert(ROWS)
    return t, Indexes(t.tables)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_searches_follow_inserts_and_deletes(made):
    t, indexes = made
    key, same = indexes.create(t, "by_id", "id"), indexes.create(t, "by_name", "name", "HASH", buckets=4)
    place = indexes.create(t, "by_place", "place", "RTREE", per_tile=5)
    text = indexes.create(t, "by_text", "review", "INVERTED", analyzer="english")
    vec = indexes.create(t, "by_vector", "v", "IVF", lists=4, metric="L2")

    def check(rows):
        assert ids(key.between(5, 30)) == [r[0] for r in sorted(rows) if 5 <= r[0] <= 30]
        assert sorted(ids(same.equal("n1"))) == [r[0] for r in sorted(rows) if r[1] == "n1"]
        assert sorted(ids(place.in_radius((-77.0, -12.0), 6))) == sorted(ids(t.rows().where(within_radius(F.col("place.lon"), F.col("place.lat"), (-77.0, -12.0), 6))))
        assert sorted(ids(text.matching("shoes AND NOT blue"))) == [r[0] for r in sorted(rows) if r[3] == "red shoes"]
        assert ids(vec.nearest((1.0, 0.57, 0.0), 3, probes=9)) == [r[0] for r in sorted(rows, key=lambda r: abs(r[4][1] - 0.57))][:3]

    check(ROWS)
    new = [(30, "n1", (-77.0, -12.01), "red shoes", (1.0, 0.56, 0.0))]
    t.insert(new)
    assert key.stale and text.stale
    check(ROWS + new)
    assert len(key.segments) == len(vec.segments) == 2 and len(text.segments) == 1
    t.delete(within_radius(F.col("place.lon"), F.col("place.lat"), (-77.0, -12.0), 2))
    t.delete(condition("shirt", "raw").column(words(F.col("review"))) & (F.col("id") > 10))
    kept = set(ids(t.rows()))
    assert 0 not in kept and 12 not in kept and 13 in kept
    check([r for r in ROWS + new if r[0] in kept])
    assert len(key.segments) == 1
    again = indexes.open(t.tables.open("places"), "by_id")
    assert not again.stale and ids(again.equal(13)) == [13]
    with pytest.raises(ValueError):
        vec.nearest((1.0, 2.0), 3)


def test_rules_of_indexes(made):
    t, indexes = made
    indexes.create(t, "a", "id", "HASH")
    with pytest.raises(DuplicateKey):
        t.insert([ROWS[3]])
    for wrong in (("a", "name", "HASH", {}), ("b", "id", "HASH", {}), ("b", "place", "BTREE", {}), ("b", "name", "IVF", {}), ("b", "name", "HASH", {"lists": 2}), ("b", "none", "HASH", {}), ("b", "name", "LSM", {})):
        with pytest.raises(TableError):
            indexes.create(t, wrong[0], wrong[1], wrong[2], **wrong[3])
    found = indexes.paths(t, [("id", "="), ("name", "range")]).collect()
    assert [(r["structure"], r["index"], r["chosen"]) for r in found] == [("HEAP", None, False), ("HASH", "a", True)]
    indexes.drop("a")
    assert indexes.names() == {}
    with pytest.raises(TableError):
        indexes.drop("a")


def test_empty_table_and_pages(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/db").create("places", PLACES)
    indexes = Indexes(t.tables)
    key, vec, text, place = indexes.create(t, "k", "id"), indexes.create(t, "v", "v", "IVF"), indexes.create(t, "t", "review", "INVERTED"), indexes.create(t, "p", "place", "RTREE")
    assert ids(key.between()) == ids(vec.nearest((1, 2, 3), 2)) == ids(text.matching("x")) == ids(place.in_radius((0, 0), 9)) == []
    t.insert(ROWS)
    assert ids(place.nearest_places((-77.0, -12.0), 3)) == [0, 1, 2] and ids(place.in_box((-77.005, -13), (-76.995, -11))) == [0]
    assert ids(key.equal(7)) == ids(vec.nearest((1, 0.7, 0), 1, probes=99)) == [7]
    t.delete()
    assert ids(key.between()) == ids(vec.nearest((1, 2, 3), 2)) == ids(place.in_radius((-77.0, -12.0), 9)) == []
    t.insert(ROWS)
    assert ids(vec.nearest((1, 0.7, 0), 1, probes=99)) == [7]
    rows, total = page_of(t.rows().orderBy("id"), 2, 6)
    assert ids(rows) == [6, 7, 8, 9, 10, 11] and total == 20
    t.delete(F.col("id") < 5)
    t.compact()
    assert t.info()["rows"] == 15 and sorted(ids(t.rows())) == list(range(5, 20))
