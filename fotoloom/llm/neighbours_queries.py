"""Problem 3: the ten most similar photos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotoloom.llm.neighbours import nearest
from fotoloom.operators.canonical import drop_reimports
from fotoloom.sources.tables import spread, table

TOP_K = 10
DIM = 128
QUERY_STEP = 20


def _photos(spark: SparkSession, folder: str) -> DataFrame:
    return drop_reimports(spread(table(spark, folder, "photos"), "id")).select("id", "feature_vector")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The neighbours of each probe's photo."""
    photos = _photos(spark, folder)
    probes = table(spark, folder, "probe_photos").where("photo_id is not null").select("probe_no", F.col("photo_id").cast("long").alias("query_id"))
    asked = photos.join(probes.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi")
    found = nearest(photos, asked, "id", "feature_vector", "id", "feature_vector", TOP_K, DIM)
    return probes.join(found, "query_id").select("probe_no", F.col("neighbour_id").cast("int").alias("neighbour_id"))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The neighbours of every photo whose id is divisible by 20, among all photos."""
    photos = _photos(spark, folder)
    asked = photos.where(F.col("id") % QUERY_STEP == 0)
    found = nearest(photos, asked, "id", "feature_vector", "id", "feature_vector", TOP_K, DIM)
    return found.select(F.col("query_id").cast("int").alias("photo_id"), F.col("neighbour_id").cast("int").alias("neighbour_id"), "similarity", "rank")


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours}
SQL: dict[str, str] = {}  # approximate: tested for its recall against brute force
