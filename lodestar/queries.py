"""Registered queries over the driver's tables, each with the DuckDB SQL of the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.datagen import employees
from lodestar.functions import features
from lodestar.functions import text as tx
from lodestar.functions.geo import haversine_km, within_box, within_radius
from lodestar.functions.match import condition
from lodestar.functions.register import register
from lodestar.functions.vector import cosine_distance, rounded
from lodestar.indexes import inverted
from lodestar.indexes.ivf import Cells, nearest_cell, train_centres
from lodestar.indexes.keys import HashedKeys, OrderedKeys
from lodestar.indexes.tiles import Tiles
from lodestar.operators import hybrid, rows, search
from lodestar.operators.nearest import nearest_places, nearest_vectors
from lodestar.recommend import Conditions, recommend
from lodestar.scratch import new_folder, table
from lodestar.sources.named import Indexes
from lodestar.sources.tables import Tables
from lodestar.streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CENTER = (-77.03, -12.1)


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return keep


# Views that stand for the fixtures, in both engines.

GEO = "geo as (select vec_id, -77.03 + embedding[1]::double / 5 as lon, -12.1 + embedding[2]::double / 5 as lat from embeddings)"
KM = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(lat + 12.1) / 2), 2) + cos(radians(-12.1)) * cos(radians(lat)) * pow(sin(radians(lon + 77.03) / 2), 2))))"
Q0 = "q as (select embedding::double[] as v from embeddings where vec_id = 0)"
COS = "case when list_dot_product(e, v) is null or list_dot_product(e, e) = 0 or list_dot_product(v, v) = 0 then 1.0 else 1 - list_dot_product(e, v) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v, v))) end"
VEC = "vec as (select vec_id, label, embedding::double[] as e from embeddings)"
ITEMS = "items as (select vec_id as id, p_brand as category, p_retailprice as price, -77.03 + embedding[1]::double / 5 as lon, -12.1 + embedding[2]::double / 5 as lat, text, embedding::double[] as e from embeddings join documents on doc_id = vec_id join part on p_partkey = vec_id)"
BAG = "bag as (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents) group by all)"
STATS = "n as (select count(*) as n from documents), df as (select term, count(*) as df from bag group by term), w as (select doc_id, bag.term, tf, df, (1 + log10(tf)) * log10(n / df) as w from bag join df using (term), n), norm as (select doc_id, sqrt(sum(w * w)) as norm, sum(tf) as length from w group by doc_id), docs as (select documents.doc_id, coalesce(norm, 0) as norm, coalesce(length, 0) as length from documents left join norm using (doc_id))"
R6 = "round({}, 6) + 0.0"


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.lit(-77.03) + e[0].cast("double") / 5).alias("lon"), (F.lit(-12.1) + e[1].cast("double") / 5).alias("lat"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", (F.lit(-77.03) + e[0].cast("double") / 5).alias("lon"), (F.lit(-12.1) + e[1].cast("double") / 5).alias("lat"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), F.col("p_retailprice").alias("price"))
    return vectors.join(texts, "id").join(parts, "id")


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


def plain_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.tally(table(spark, sf_dir, "documents"), "doc_id", tx.words(F.col("text"), accents=False))


def plain_index(spark: SparkSession, sf_dir: str) -> search.TextIndex:
    """Lower-case words without stopwords or stems; queries are read word by word."""
    return search.text_index(table(spark, sf_dir, "documents"), "doc_id", "text", "raw", plain_bag(spark, sf_dir))


# Scans, projections, filters.


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def scan_all(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("select c_custkey as id, c_name as name, c_acctbal as balance, c_acctbal as again from customer")
def project_alias(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_acctbal").alias("again"))


def _comparison(name: str, op: str) -> None:
    @query(f"select c_custkey, c_acctbal from customer where c_custkey {op} 101", name)
    def run(spark, d):
        return table(spark, d, "customer").where(rows.compare("c_custkey", op, 101)).select("c_custkey", "c_acctbal")


for _name, _op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _comparison(f"filter_{_name}", _op)


@query("select c_custkey from customer where 100 <= c_custkey")
def filter_flip(spark, d):
    return table(spark, d, "customer").where(rows.compare("c_custkey", "<=", 100, flipped=True)).select("c_custkey")


@query("select c_custkey, c_acctbal from customer where c_acctbal between 100.5 and 5000")
def filter_between(spark, d):
    return table(spark, d, "customer").where(F.col("c_acctbal").between(100.5, 5000)).select("c_custkey", "c_acctbal")


@query("select c_custkey, c_acctbal from customer where c_acctbal between 5000 and 100")
def filter_between_empty(spark, d):
    return table(spark, d, "customer").where(F.col("c_acctbal").between(5000, 100)).select("c_custkey", "c_acctbal")


@query("select c_custkey, left(c_mktsegment, 5) as segment from customer where left(c_mktsegment, 5) = left('BUILDINGS AND MORE', 5)")
def filter_char_truncated(spark, d):
    cut = table(spark, d, "customer").select("c_custkey", rows.cut_bytes_column(F.col("c_mktsegment"), 5).alias("segment"))
    return cut.where(rows.compare("segment", "=", "BUILDINGS AND MORE", size=5))


@query("select c_custkey, c_acctbal from customer where c_custkey > 10 and c_custkey >= 10 and c_custkey < 900 and c_custkey <= 400 and c_acctbal > 0 and c_custkey != 77")
def range_merge(spark, d):
    conditions = [("c_custkey", ">", 10), ("c_custkey", ">=", 10), ("c_custkey", "<", 900), ("c_custkey", "<=", 400), ("c_acctbal", ">", 0), ("c_custkey", "!=", 77)]
    return table(spark, d, "customer").where(rows.within_bounds(conditions)).select("c_custkey", "c_acctbal")


@query("select doc_id, case when strlen(text) <= 9 then text else left(text, 9) end is not null as kept, n_chars from documents")
def char_cut(spark, d):
    cut = rows.cut_bytes_column(F.col("text"), 9)
    return table(spark, d, "documents").select("doc_id", (F.octet_length(cut) <= 9).alias("kept"), "n_chars")


# Order, top-k, pages.


@query("select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 20")
def top_k_asc(spark, d):
    return rows.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def top_k_desc(spark, d):
    return rows.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey", True)


@query("select c_custkey, -c_acctbal as c_acctbal from customer order by 2, 1 limit 15")
def order_by_alias(spark, d):
    return rows.top_k(table(spark, d, "customer").select("c_custkey", (-F.col("c_acctbal")).alias("c_acctbal")), "c_acctbal", 15, "c_custkey")


@query("select c_custkey from customer limit 0")
def limit_zero(spark, d):
    return rows.top_k(table(spark, d, "customer").select("c_custkey"), "c_custkey", 0, "c_custkey")


@query("select c_custkey, c_name from customer order by c_custkey limit 50 offset 100")
def page_3(spark, d):
    return rows.page(table(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey"), 3, 50)


@query("select o_orderkey, o_totalprice, o_orderstatus from orders order by o_orderstatus, o_orderkey")
def sort_full(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").orderBy("o_orderstatus", "o_orderkey")


# Key indexes.


@query("select o_orderkey, o_totalprice from orders where o_orderkey > 100 and o_orderkey <= 600 order by o_orderkey")
def seq_pk_order_range(spark, d):
    index = OrderedKeys.build(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), new_folder(spark, "ordered"), "o_orderkey", unique=True)
    return index.between(100, 600, low_included=False)


@query("select o_orderkey, o_custkey from orders where o_custkey = 37")
def ordered_equal(spark, d):
    return OrderedKeys.build(table(spark, d, "orders").select("o_orderkey", "o_custkey"), new_folder(spark, "ordered"), "o_custkey").equal(37)


@query("select o_orderkey, o_custkey from orders where o_custkey = 37")
def hashed_equal(spark, d):
    return HashedKeys.build(table(spark, d, "orders").select("o_orderkey", "o_custkey"), new_folder(spark, "hashed"), "o_custkey").equal(37)


# Places.


@query(f"with {GEO} select vec_id, {R6.format(KM)} as km from geo where {KM} <= 2.5")
def geo_radius(spark, d):
    g = geo(spark, d).where(within_radius(F.col("lon"), F.col("lat"), CENTER, 2.5))
    return g.select("vec_id", rounded(haversine_km(F.col("lon"), F.col("lat"), *CENTER)).alias("km"))


@query(f"with {GEO} select vec_id from geo where lon between -77.04 and -77.02 and lat between -12.12 and -12.09")
def geo_box(spark, d):
    return geo(spark, d).where(within_box(F.col("lon"), F.col("lat"), (-77.02, -12.12), (-77.04, -12.09))).select("vec_id")


@query(f"with {GEO} select vec_id, {R6.format(KM)} as km from geo order by {KM}, vec_id limit 10")
def geo_knn(spark, d):
    return nearest_places(geo(spark, d), "lon", "lat", CENTER, 10, "vec_id").select("vec_id", rounded(F.col("km")).alias("km"))


@query(f"with {GEO} select vec_id, {R6.format(KM)} as km from geo where vec_id % 7 < 3 order by {KM}, vec_id limit 10")
def geo_knn_filtered(spark, d):
    return nearest_places(geo(spark, d), "lon", "lat", CENTER, 10, "vec_id", F.col("vec_id") % 7 < 3).select("vec_id", rounded(F.col("km")).alias("km"))


def _tiles(spark, d) -> Tiles:
    return Tiles.build(geo(spark, d), new_folder(spark, "tiles"), "lon", "lat", per_tile=50)


@query(ORACLE_SQL["geo_radius"])
def geo_radius_tiles(spark, d):
    return _tiles(spark, d).in_radius(CENTER, 2.5).select("vec_id", rounded(haversine_km(F.col("lon"), F.col("lat"), *CENTER)).alias("km"))


@query(ORACLE_SQL["geo_box"])
def geo_box_tiles(spark, d):
    return _tiles(spark, d).in_box((-77.02, -12.12), (-77.04, -12.09)).select("vec_id")


@query(ORACLE_SQL["geo_knn"])
def geo_knn_tiles(spark, d):
    return _tiles(spark, d).nearest(CENTER, 10, "vec_id").select("vec_id", rounded(F.col("km")).alias("km"))


# Vectors.


@query(f"with {Q0}, {VEC} select vec_id, {R6.format(COS)} as distance from vec, q order by {COS}, vec_id limit 10")
def vec_knn_cosine(spark, d):
    return nearest_vectors(table(spark, d, "embeddings"), "embedding", vector_of(spark, d, 0), 10, "vec_id").select("vec_id", rounded(F.col("distance")).alias("distance"))


@query(f"with {Q0}, {VEC} select vec_id, {R6.format('list_distance(e, v)')} as distance from vec, q order by list_distance(e, v), vec_id limit 10")
def vec_knn_l2(spark, d):
    return nearest_vectors(table(spark, d, "embeddings"), "embedding", vector_of(spark, d, 0), 10, "vec_id", "L2").select("vec_id", rounded(F.col("distance")).alias("distance"))


@query("select vec_id, 1.0::double as distance from embeddings")
def vec_zero_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", cosine_distance(F.col("embedding"), [0.0] * 64).alias("distance"))


@query(ORACLE_SQL["vec_knn_cosine"])
def ivf_all_probes(spark, d):
    cells = Cells.build(table(spark, d, "embeddings"), new_folder(spark, "ivf"), "embedding", "vec_id", 12)
    return cells.search(vector_of(spark, d, 0), 10, "vec_id", probes=12).select("vec_id", rounded(F.col("distance")).alias("distance"))


def label_centres(spark, d) -> tuple[list[int], np.ndarray]:
    """Mean vector of each label: a bounded number of labels."""
    flat = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c")).orderBy("label").collect()
    return [r["label"] for r in means], np.array([[x["m"] for x in r["c"]] for r in means])


CENTRES = "flat as (select label, i, avg(embedding[i]::double) as m from embeddings, range(1, 65) t(i) group by label, i), centres as (select label, list(m order by i) as c from flat group by label)"


@query(f"with {Q0}, {VEC}, {CENTRES}, probe as (select label as cell from centres, q order by list_distance(c, v), label limit 3), own as (select vec_id, e, arg_min(centres.label, list_distance(c, e)) as cell from vec, centres group by vec_id, e) select vec_id, {R6.format('list_distance(e, v)')} as distance from own, q where cell in (select cell from probe) order by list_distance(e, v), vec_id limit 10")
def ivf_fixed_centroids(spark, d):
    _, centres = label_centres(spark, d)
    cells = Cells.build(table(spark, d, "embeddings"), new_folder(spark, "ivf"), "embedding", "vec_id", metric="L2", centres=centres)
    return cells.search(vector_of(spark, d, 0), 10, "vec_id", probes=3).select("vec_id", rounded(F.col("distance")).alias("distance"))


@query(f"with {VEC}, {CENTRES} select vec_id, arg_min(centres.label, list_distance(c, e)) as cell from vec, centres group by vec_id")
def kmeans_assign(spark, d):
    labels, centres = label_centres(spark, d)
    names = F.array(*[F.lit(x) for x in labels])
    return table(spark, d, "embeddings").select("vec_id", names[nearest_cell(F.col("embedding"), centres, "L2")].alias("cell"))


@query(f"with {VEC}, {CENTRES}, own as (select vec_id, vec.label, arg_min(centres.label, list_distance(c, e)) as w from vec, centres group by vec_id, vec.label), n as (select label, w, count(*) as n from own group by label, w) select label, string_agg('v' || w || ':' || n, ' ' order by w) as words from n group by label")
def visual_words(spark, d):
    """Vectors as descriptors of their label's row, label centres (numbered from 0) as words."""
    labels, centres = label_centres(spark, d)
    assert labels == list(range(len(labels)))
    return features.visual_words(table(spark, d, "embeddings"), "label", "embedding", centres)


@query()
def pca_shortened(spark, d):
    return features.shortened(table(spark, d, "embeddings"), "embedding", 16).select("vec_id", "short")


@query()
def kmeans_train(spark, d):
    centres = train_centres(table(spark, d, "embeddings"), "embedding", "vec_id", 12)
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")


@query()
def ivf_recall(spark, d):
    """Recall at 10 of one query for 1, 5 and all probes."""
    vectors, q = table(spark, d, "embeddings"), vector_of(spark, d, 0)
    cells = Cells.build(vectors, new_folder(spark, "ivf"), "embedding", "vec_id", 12)
    exact = nearest_vectors(vectors, "embedding", q, 10, "vec_id").select("vec_id")
    out = None
    for probes in (1, 5, 12):
        found = cells.search(q, 10, "vec_id", probes).select("vec_id").intersect(exact).agg((F.count(F.lit(1)) / 10).alias("recall")).withColumn("probes", F.lit(probes))
        out = found if out is None else out.union(found)
    return out


# Text.


@query(f"with {BAG} select * from bag")
def text_bow(spark, d):
    return plain_bag(spark, d)


@query("select doc_id, len(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')) as n from documents")
def text_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tx.words(F.col("text"))).cast("long").alias("n"))


@query("select doc_id, t as term, count(*) as tf from (select doc_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: string_split(x, ':')[1] <> '')) as p, string_split(p, ':')[1] as t from documents) group by all")
def text_tokens_raw(spark, d):
    return tx.bag_of_words(table(spark, d, "documents").withColumn("text", F.regexp_replace("text", ":[0-9]+(?=\\s|$)", "")), "doc_id", "text", "raw")


@query("select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')) as term from documents) where term not in (" + ", ".join(f"'{w}'" for w in tx.ENGLISH_STOPWORDS) + ") group by all")
def text_stopwords(spark, d):
    return tx.tally(table(spark, d, "documents"), "doc_id", tx.content_words(F.col("text"), "english"))


@query()
def text_bow_spanish(spark, d):
    return tx.bag_of_words(table(spark, d, "documents"), "doc_id", "text", "spanish")


@query()
def text_bow_english(spark, d):
    return tx.bag_of_words(table(spark, d, "documents"), "doc_id", "text", "english")


def _match(name: str, text: str, having: str) -> None:
    sql = f"with {BAG} select documents.doc_id from documents left join bag using (doc_id) group by documents.doc_id having {having}"
    has = {w: f"coalesce(bool_or(term = '{w}'), false)" for w in ("the", "thor", "heer", "ar", "zzzz")}
    for w, x in has.items():
        sql = sql.replace(f"<{w}>", x)

    @query(sql, name)
    def run(spark, d):
        return search.matching(plain_index(spark, d), text)


_match("match_and", "the AND thor", "<the> and <thor>")
_match("match_juxtaposed", "the (thor heer)", "<the> and <thor> and <heer>")
_match("match_or", "thor OR heer", "<thor> or <heer>")
_match("match_not", "the AND NOT thor", "<the> and not <thor>")
_match("match_complement", "NOT the", "not <the>")
_match("match_paren", "(thor OR heer) AND NOT (the AND ar)", "(<thor> or <heer>) and not (<the> and <ar>)")
_match("match_free", "thor heer zzzz", "<thor> or <heer> or <zzzz>")


@query("select doc_id from documents where false")
def match_stopword(spark, d):
    return search.matching(plain_index(spark, d), condition("the AND of", "english"))


TFIDF = f"with {BAG}, {STATS}, qw as (select term, log10(n / df) as qw from df, n where term in ('thor', 'heer', 'the')), s as (select doc_id, sum(w * qw) as dot from w join qw using (term) group by doc_id), score as (select doc_id, case when norm > 0 then dot / (norm * (select sqrt(sum(qw * qw)) from qw)) else 0 end as score from s join docs using (doc_id)) select doc_id, {R6.format('score')} as score from score"


@query(f"{TFIDF} order by score.score desc, doc_id limit 10")
def tfidf_topk(spark, d):
    return search.ranked(plain_index(spark, d), "thor heer the", 10).select("doc_id", rounded(F.col("score")).alias("score"))


@query(f"{TFIDF} where doc_id % 3 = 0 order by score.score desc, doc_id limit 10")
def tfidf_prefilter(spark, d):
    allowed = table(spark, d, "documents").where("doc_id % 3 = 0")
    return search.ranked(plain_index(spark, d), "thor heer the", 10, allowed=allowed).select("doc_id", rounded(F.col("score")).alias("score"))


@query(ORACLE_SQL["tfidf_prefilter"])
def tfidf_postfilter(spark, d):
    return search.ranked(plain_index(spark, d), "thor heer the").where("doc_id % 3 = 0").limit(10).select("doc_id", rounded(F.col("score")).alias("score"))


@query(f"with {BAG}, {STATS}, average as (select avg(length) as a from docs), s as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / a))) as score from w join docs using (doc_id), n, average where term in ('thor', 'heer', 'the') group by doc_id) select doc_id, {R6.format('score')} as score from s order by s.score desc, doc_id limit 10")
def bm25_topk(spark, d):
    return search.ranked(plain_index(spark, d), "thor heer the", 10, "BM25").select("doc_id", rounded(F.col("score")).alias("score"))


@query(f"with {BAG}, {STATS} select term, df, {R6.format('log10(n / df)')} as idf from df, n")
def vocab_df(spark, d):
    return plain_index(spark, d).vocabulary().select("term", "df", rounded(F.col("idf")).alias("idf"))


@query(f"with {BAG}, {STATS} select doc_id, length::bigint as length, {R6.format('norm')} as norm from docs")
def doc_norms(spark, d):
    return plain_index(spark, d).documents.select("doc_id", "length", rounded(F.col("norm")).alias("norm"))


@query()
def inverted_english(spark, d):
    index = inverted.build(table(spark, d, "documents"), new_folder(spark, "inverted"), "doc_id", "text", "english")
    return search.ranked(index, "thor AND (things OR NOT heer)", 20, "BM25")


BOVW = "bovw as (select vec_id, i, cast(floor(abs(embedding[i]::double) * 20) as bigint) as tf from embeddings, range(1, 65) t(i)), bag as (select vec_id as doc_id, 'v' || i as term, tf from bovw where tf > 0), documents as (select vec_id as doc_id from embeddings)"


@query(f"with {BOVW}, {STATS}, qw as (select term, (1 + log10(tf)) * log10(n / df) as qw from bag join df using (term), n where doc_id = 0), s as (select doc_id, sum(w * qw) as dot from w join qw using (term) group by doc_id), score as (select doc_id, case when norm > 0 then dot / (norm * (select sqrt(sum(qw * qw)) from qw)) else 0 end as score from s join docs using (doc_id)) select doc_id as vec_id, {R6.format('score')} as score from score order by round(score.score, 9) desc, doc_id limit 10")
def bovw_knn(spark, d):
    e = table(spark, d, "embeddings")
    parts = F.transform("embedding", lambda x, i: F.concat(F.lit("v"), i + 1, F.lit(":"), F.floor(F.abs(x.cast("double")) * 20)))
    docs = e.select("vec_id", F.array_join(parts, " ").alias("words"))
    index = search.text_index(docs, "vec_id", "words", "raw")
    own = docs.where("vec_id = 0").first()["words"]
    out = search.ranked(index, own)
    return out.orderBy(F.round("score", 9).desc(), "vec_id").limit(10).select("vec_id", rounded(F.col("score")).alias("score"))


# Ranking under conditions.

HYBRID = f"with {Q0}, {ITEMS} select id, price, {R6.format(COS)} as distance from items, q where price <= 950"


@query(f"{HYBRID} order by {COS}, id limit 10")
def hybrid_vec_price_pre(spark, d):
    it = items(spark, d)
    cells = Cells(spark, "", "embedding", "COSINE", np.zeros((12, 64)))
    out, _ = hybrid.hybrid_nearest(it, cells, vector_of(spark, d, 0), 10, "id", F.col("price") <= 950, ["range"], strategy="pre", rows=1)
    return out.select("id", "price", rounded(F.col("distance")).alias("distance"))


@query(f"{HYBRID} order by {COS}, id limit 10")
def hybrid_vec_price_post(spark, d):
    it = items(spark, d)
    cells = Cells.build(it, new_folder(spark, "ivf"), "embedding", "id", 8)
    out, _ = hybrid.hybrid_nearest(it, cells, vector_of(spark, d, 0), 10, "id", F.col("price") <= 950, ["range"], probes=8, strategy="post")
    return out.select("id", "price", rounded(F.col("distance")).alias("distance"))


@query()
def hybrid_auto(spark, d):
    it = items(spark, d)
    cells = Cells.build(it, new_folder(spark, "ivf"), "embedding", "id", 8)
    out, plan = hybrid.hybrid_nearest(it, cells, vector_of(spark, d, 0), 10, "id", F.col("price") <= 901, ["range"], probes=2)
    return out.select("id", "price", "distance", F.lit(plan.strategy).alias("strategy"))


@query(f"with {Q0}, {ITEMS} select id, {R6.format(COS)} as distance, {R6.format(KM)} as km from items, q where price < 980 and {KM} <= 4 and list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'the') order by {COS}, id limit 10")
def hybrid_all(spark, d):
    it = items(spark, d)
    where = (F.col("price") < 980) & within_radius(F.col("lon"), F.col("lat"), CENTER, 4) & condition("the", "raw").column(tx.words(F.col("text"), accents=False))
    out = nearest_vectors(it, "embedding", vector_of(spark, d, 0), 10, "id", where=where)
    return out.select("id", rounded(F.col("distance")).alias("distance"), rounded(haversine_km(F.col("lon"), F.col("lat"), *CENTER)).alias("km"))


@query(f"with {ITEMS}, {BAG}, {STATS}, qw as (select term, log10(n / df) as qw from df, n where term = 'thor'), s as (select doc_id, sum(w * qw) / (any_value(norm) * any_value(qw)) as score from w join qw using (term) join norm using (doc_id) group by doc_id) select id, price, {R6.format('score')} as score from items join s on doc_id = id where price < 990")
def hybrid_scores(spark, d):
    scores = search.tfidf_scores(plain_index(spark, d), condition("thor", "raw").positive).withColumnRenamed("doc_id", "id")
    return hybrid.with_scores(items(spark, d).where("price < 990"), scores, "id").select("id", "price", rounded(F.col("score")).alias("score"))


@query(f"with {Q0}, {ITEMS} select id, {R6.format(COS)} as distance from items, q where price <= 960 and {KM} <= 5 and id <> 0 order by {COS}, id limit 8")
def recommend_exact(spark, d):
    out = recommend(items(spark, d), "exact", 8, conditions=Conditions(960, CENTER, 5), like=0)
    return out.select("id", rounded(F.col("distance")).alias("distance"))


@query(f"with {Q0}, {ITEMS} select id, {R6.format(COS)} as distance from items, q where price <= 960 and id <> 0 order by {COS}, id limit 8")
def recommend_embedding(spark, d):
    it = items(spark, d)
    cells = Cells.build(it, new_folder(spark, "ivf"), "embedding", "id", 8)
    out = recommend(it, "embedding", 8, conditions=Conditions(960), like=0, vectors=cells, probes=8)
    return out.select("id", rounded(F.col("distance")).alias("distance"))


@query(f"with {ITEMS}, {BAG}, {STATS}, qw as (select term, log10(n / df) as qw from df, n where term = 'thor'), s as (select doc_id, sum(w * qw) / (any_value(norm) * any_value(qw)) as score from w join qw using (term) join norm using (doc_id) group by doc_id) select id, {R6.format('score')} as score from items join s on doc_id = id where price <= 960 order by round(score, 9) desc, id limit 8")
def recommend_text(spark, d):
    out = recommend(items(spark, d), "text", 8, conditions=Conditions(960), query="thor", text=plain_index(spark, d))
    return out.select(F.col("doc_id").alias("id"), rounded(F.col("score")).alias("score"))


@query(f"with {Q0}, {VEC}, {GEO} select vec_id, {R6.format(COS)} as distance, {R6.format(KM)} as km from vec join geo using (vec_id), q where {KM} <= 3 order by {COS}, vec_id limit 10")
def sql_functions(spark, d):
    """One statement of Spark SQL with the registered functions."""
    register(spark)
    table(spark, d, "embeddings").createOrReplaceTempView("lodestar_vectors")
    return spark.sql("""
        with q as (select embedding as v from lodestar_vectors where vec_id = 0),
        g as (select vec_id, embedding as e, -77.03d + double(embedding[0]) / 5 as lon, -12.1d + double(embedding[1]) / 5 as lat from lodestar_vectors),
        r as (select /*+ broadcast(q) */ vec_id, cosine_distance(e, v) as c, haversine_km(lon, lat, -77.03, -12.1) as km from g, q where within_radius(lon, lat, -77.03, -12.1, 3))
        select vec_id, round(c, 6) + 0.0d as distance, round(km, 6) + 0.0d as km from r order by c, vec_id limit 10""")


@query()
def explain_plan(spark, d):
    return hybrid.explain(geo_radius(spark, d))


# Tables that change.


def _emp(spark, d, sequential: bool = False):
    t = Tables(spark, new_folder(spark, "tables")).create("emp", ["id INT PRIMARY KEY", "name CHAR(30)", "dept CHAR(5)", "salary FLOAT"], sequential)
    source = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    csv = new_folder(spark, "csv")
    source.orderBy("c_custkey").write.option("header", False).csv(csv)
    t.copy_csv(csv)
    return t


@query("select c_custkey::int as id, c_name as name, left(c_mktsegment, 5) as dept, c_acctbal as salary from customer")
def copy_csv(spark, d):
    return _emp(spark, d, True).rows()


@query("select c_custkey::int as id, c_acctbal as salary from customer where not (c_acctbal < 0 or left(c_mktsegment, 5) = 'BUILD')")
def delete_where(spark, d):
    t = _emp(spark, d)
    t.delete((F.col("salary") < 0) | (F.col("dept") == "BUILD"))
    t.compact()
    return t.rows().select("id", "salary")


@query("select id::int as id, salary from (select c_custkey as id, c_acctbal as salary from customer union all values (900001, 1.5), (900002, 2.0)) where salary < 100")
def insert_then_select(spark, d):
    t = _emp(spark, d, True)
    t.insert([(900001, "new", "Sales and more", 1.5), (900002, "new", "x", 2)])
    return t.rows().where("salary < 100").select("id", "salary")


CHANGED = "changed as (select c_custkey::int as id, c_name as name, left(c_mktsegment, 5) as dept, c_acctbal as salary from customer where not c_name like '%42%' union all select 900001, 'two new words', 'Sales', 1.5)"


def _changed(spark, d, column: str, kind: str, **options):
    """A table with an index that was there before an insert and a delete."""
    t = _emp(spark, d)
    index = Indexes(t.tables).create(t, "by_it", column, kind, **options)
    t.insert([(900001, "two new words", "Sales", 1.5)])
    t.delete(F.col("name").contains("42"))
    return t, index


@query(f"with {CHANGED} select id, salary from changed where salary between 0 and 1000")
def index_range_after_changes(spark, d):
    return _changed(spark, d, "salary", "BTREE")[1].between(0, 1000).select("id", "salary")


@query(f"with {CHANGED} select id, name from changed where dept = 'Sales' or dept = 'BUILD'")
def index_equal_after_changes(spark, d):
    index = _changed(spark, d, "dept", "HASH", buckets=8)[1]
    return index.equal("Sales").union(index.equal("BUILD")).select("id", "name")


@query(f"with {CHANGED} select id, name from changed where name like '%new%' or name = 'Customer#000000007'")
def index_text_after_changes(spark, d):
    index = _changed(spark, d, "name", "INVERTED", analyzer="raw")[1]
    return index.matching("new OR Customer#000000007").select("id", "name")


@query("select c_custkey::int as id, c_name as name from customer where not list_contains(regexp_extract_all(lower(c_name), '[a-z0-9]+'), '000000007')")
def delete_by_text(spark, d):
    t = _emp(spark, d)
    t.delete(condition("000000007", "raw").column(tx.words(F.col("name"))))
    return t.rows().select("id", "name")


@query("select 'scan' as path, 'HEAP' as structure, null::varchar as index, count(*)::double as estimated_rows, false as chosen from customer union all select '= on id', 'HASH', 'by_it', count(*) * 0.1, true from customer")
def explain_paths(spark, d):
    t = _emp(spark, d)
    indexes = Indexes(t.tables)
    indexes.create(t, "by_it", "id", "HASH")
    return indexes.paths(t, [("id", "="), ("dept", "range")])


@query("select min(id) as low, max(id) as high, count(distinct id) as n from range(1, 1001) t(id)")
def generated_employees(spark, d):
    return employees(spark, 1000).agg(F.min("id").cast("long").alias("low"), F.max("id").cast("long").alias("high"), F.count_distinct("id").alias("n"))


# Event windows (the same code runs on streams).


@query('select time_bucket(interval 1 hour, ts) as start, time_bucket(interval 1 hour, ts) + interval 1 hour as "end", event_type, count(*) as n, round(sum(value), 4) as total from events group by all')
def events_windowed(spark, d):
    out = ev.windowed(table(spark, d, "events")).withColumn("total", F.round("total", 4))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", "total")


@query("with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as first from events), s as (select user_id, ts, sum(first) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, min(ts) as start, max(ts) + interval 30 minutes as \"end\", count(*) as n from s group by user_id, k")
def events_sessions(spark, d):
    out = ev.sessions(table(spark, d, "events"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("select count(distinct event_id) as n from events")
def events_distinct(spark, d):
    return ev.first_of_each(table(spark, d, "events")).agg(F.count(F.lit(1)).alias("n"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Vector ranking under price, place and text conditions."""
    return hybrid_all(spark, d)


__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
