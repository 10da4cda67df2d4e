from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions.geo import haversine_km, radius_box, within_box, within_radius
from lodestar.functions.match import MatchError, condition
from lodestar.functions.register import register
from lodestar.functions.vector import cosine_distance, l2_distance
from lodestar.operators import rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_distances(spark):
    q = [1.0, 0.0]
    vectors = [(1, 0), (0, 1), (-1, 0), (3, 4), (0, 0)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "i int, v array<float>")
    got = df.orderBy("i").select(l2_distance(F.col("v"), q), cosine_distance(F.col("v"), q)).collect()
    assert [r[0] for r in got] == pytest.approx([0, math.sqrt(2), 2, math.sqrt(20), 1])
    assert [r[1] for r in got] == pytest.approx([0, 1, 2, 0.4, 1])


def test_places(spark):
    km = one(spark, haversine_km(-77.03, -12.0464, -77.0305, -12.1215))
    assert 8.2 < km < 8.5
    assert one(spark, haversine_km(0, 0, 180, 0)) == pytest.approx(math.pi * 6371.0088)
    points = spark.createDataFrame([(0.0, 0.0), (0.5, 0.5), (1.0, 1.0), (179.9, 0.0), (0.0, 89.9)], "lon double, lat double")
    lon, lat = F.col("lon"), F.col("lat")
    assert points.where(within_box(lon, lat, (1, 0), (0, 1))).count() == 3
    for center, km in (((0, 0), 79.0), ((-179.9, 0.0), 30.0), ((90.0, 89.9), 30.0)):
        plain = points.where(haversine_km(lon, lat, *center) <= km).count()
        assert points.where(within_radius(lon, lat, center, km)).count() == plain > 0
    assert radius_box(-179.9, 0, 30) is None and radius_box(0, 89.9, 30) is None
    with pytest.raises(ValueError):
        within_radius(lon, lat, (0, 0), -1)


def test_analyzers(spark):
    assert tx.query_terms("Los perros corrían rápidamente por la casa") == ["perr", "corri", "rapid", "cas"]
    assert tx.query_terms("The running shoes are blue", "english") == ["run", "shoe", "blue"]
    assert tx.query_terms("v3:2 v17 v3", "raw") == ["v3", "v3", "v17", "v3"]
    docs = spark.createDataFrame([(1, "v3:2 v17 v3 :9"), (2, None), (3, "")], "id int, text string")
    assert sorted(map(tuple, tx.bag_of_words(docs, "id", "text", "raw").collect())) == [(1, "v17", 1), (1, "v3", 3)]
    docs = spark.createDataFrame([(1, "gato gatos GATO perro"), (2, "Camión ÑANDÚ"), (3, None), (4, "de la")], "id int, text string")
    got = sorted(map(tuple, tx.bag_of_words(docs, "id", "text").collect()))
    assert got[:2] == [(1, "gat", 3), (1, "perr", 1)] and {r[0] for r in got} == {1, 2}
    with pytest.raises(ValueError):
        tx.bag_of_words(docs, "id", "text", "klingon")


DOCS = {1: {"gato", "perro"}, 2: {"gato"}, 3: {"perro", "casa"}, 4: set(), 5: {"t", "shirt"}}


@pytest.mark.parametrize(
    ("text", "want"),
    [("gato AND perro", {1}), ("gato OR casa", {1, 2, 3}), ("gato AND NOT perro", {2}), ("NOT gato", {3, 4, 5}), ("gato perro", {1, 2, 3}), ("(gato OR casa) AND perro", {1, 3}), ("gato (perro)", {1}), ("t-shirt AND t", {5}), ("NOT NOT gato", {1, 2})],
)
def test_conditions(spark, text, want):
    c = condition(text, "raw" if "-" not in text else "english")
    if "-" in text:
        c = condition("t shirt".replace(" ", " AND "), "raw")
    assert {i for i, t in DOCS.items() if c.holds(t)} == want
    df = spark.createDataFrame([(i, sorted(t)) for i, t in DOCS.items()], "i int, terms array<string>")
    assert {r["i"] for r in df.where(c.column(F.col("terms"))).collect()} == want


@pytest.mark.parametrize("text", ["gato AND", "(gato OR perro", "gato )", "AND gato", "NOT", "()"])
def test_malformed_conditions(text):
    with pytest.raises(MatchError):
        condition(text)


def test_stopwords_are_neutral():
    assert condition("de la").tree is None and condition("de AND la").tree is None
    assert condition("gato AND de").terms == ["gat"]
    assert condition("gato AND NOT perro perro").positive == {"gat": 1, "perr": 1}


def test_bytes_are_cut_on_characters(spark):
    for text in ("abcdefgh", "aññ", "ñññ", "ññña", "世界", "🙂🙂", "", "abcd🙂"):
        assert one(spark, rows.cut_bytes_column(F.lit(text), 5)) == rows.cut_bytes(text, 5)
    assert [rows.cut_bytes(t, 5) for t in ("abcdefgh", "aññ", "ñññ")] == ["abcde", "aññ", "ññ"]


def test_bounds_and_pages(spark):
    assert rows.bounds([("a", ">", 1), ("a", ">=", 1), ("a", "<=", 9), ("a", "<", 10)]) == {"a": (1, False, 9, True)}
    df = spark.range(25)
    assert [r[0] for r in rows.page(df.orderBy("id"), 3, 10).collect()] == [20, 21, 22, 23, 24]
    tied = spark.createDataFrame([(i, i % 3) for i in range(9)], "i int, k int")
    assert [r["i"] for r in rows.top_k(tied, "k", 4, "i", True).collect()] == [2, 5, 8, 1]
    with pytest.raises(ValueError):
        rows.page(df, 0, 10)


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("select has_all('El Camión rojo', array('camion', 'rojo')), has_any('azul', array('rojo')), cosine_distance(array(1, 0), array(0, 0)), within_box(0.5, 0.5, 1, 1, 0, 0)").first()
    assert tuple(row) == (True, False, 1.0, True)


def test_accents_go_without_python(spark):
    texts = ["Ñandú ½ ﬁn ⅷ Kelvin K İstanbul ™ x² …éa", "日本 á̧b C", "", None, "plain ASCII 7"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = docs.select("id", tx.words(F.col("text")).alias("w"))
    assert {r["id"]: r["w"] for r in out.collect()} == {i: None if t is None else re.findall("[a-z0-9]+", tx.plain(t)) for i, t in enumerate(texts)}
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_counts_need_no_shuffle_unless_ids_repeat(spark):
    rows = [(1, "b a b"), (2, None), (3, ""), (4, "z"), (None, "a")]
    bag = tx.tally(spark.createDataFrame(rows, "id int, text string"), "id", tx.words(F.col("text")))
    assert set(map(tuple, bag.collect())) == {(1, "a", 1), (1, "b", 2), (4, "z", 1), (None, "a", 1)}
    assert "Exchange" not in bag._jdf.queryExecution().executedPlan().toString()
    twice = tx.tally(spark.createDataFrame([*rows, (1, "b c"), (None, "a a")], "id int, text string"), "id", tx.words(F.col("text")))
    assert set(map(tuple, twice.collect())) == {(1, "a", 1), (1, "b", 3), (1, "c", 1), (4, "z", 1), (None, "a", 3)}
    stems = tx.bag_of_words(spark.createDataFrame([(1, "running runs the"), (2, None), (3, "run")], "id int, text string"), "id", "text", "english")
    assert set(map(tuple, stems.collect())) == {(1, "run", 2), (3, "run", 1)}
