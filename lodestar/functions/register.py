"""The functions under names of Spark SQL, so that one statement can filter, match and rank.

They are SQL functions, expanded by the analyzer into plain expressions: filters are still pushed down.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodestar.functions.geo import EARTH_KM
from lodestar.functions.text import normalize

FUNCTIONS = {
    "haversine_km(lon1 double, lat1 double, lon2 double, lat2 double) returns double": f"""
        2 * {EARTH_KM} * asin(least(1.0d, sqrt(power(sin(radians(lat2 - lat1) / 2), 2)
        + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))""",
    "within_box(lon double, lat double, lon1 double, lat1 double, lon2 double, lat2 double) returns boolean": """
        lon between least(lon1, lon2) and greatest(lon1, lon2) and lat between least(lat1, lat2) and greatest(lat1, lat2)""",
    "within_radius(lon double, lat double, center_lon double, center_lat double, km double) returns boolean": """
        haversine_km(lon, lat, center_lon, center_lat) <= km""",
    "l2_distance(a array<double>, b array<double>) returns double": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0.0d, (s, x) -> s + x))",
    "dot_product(a array<double>, b array<double>) returns double": "aggregate(zip_with(a, b, (x, y) -> x * y), 0.0d, (s, x) -> s + x)",
    "cosine_distance(a array<double>, b array<double>) returns double": """
        case when dot_product(a, a) = 0 or dot_product(b, b) = 0 then 1.0d
        else 1 - dot_product(a, b) / (sqrt(dot_product(a, a)) * sqrt(dot_product(b, b))) end""",
    "text_words(t string) returns array<string>": "regexp_extract_all(normalize_text(t), '([a-z0-9]+)', 1)",
    "has_all(t string, terms array<string>) returns boolean": "size(array_except(terms, text_words(t))) = 0",
    "has_any(t string, terms array<string>) returns boolean": "arrays_overlap(terms, text_words(t))",
}


def register(spark: SparkSession) -> None:
    spark.udf.register("normalize_text", normalize)
    for head, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
