"""Problem 2: photos of the same subject in the same period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotoloom.llm.clusters import complete_clusters, medoid_clusters, verified_records
from fotoloom.operators.canonical import drop_reimports, valid_date
from fotoloom.sources.tables import spread, table

MIN_SIMILARITY = 0.85
MAX_DAYS = 30
DIM = 128
LEAST = 3


def _verified(spark: SparkSession, folder: str, lone: bool) -> DataFrame:
    photos = drop_reimports(spread(table(spark, folder, "photos"), "id")).where(valid_date()).select("id", "date_taken", "feature_vector")
    return verified_records(photos, "id", "date_taken", "feature_vector", MIN_SIMILARITY, MAX_DAYS, DIM, lone=lone)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Members of the clusters of three or more in which all are alike and none is like a photo outside."""
    return complete_clusters(_verified(spark, folder, False), LEAST).select(F.col("cluster_id").cast("int").alias("cluster_id"), F.col("id").cast("int").alias("photo_id"))


def p2_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every photo with its cluster, named by the medoid, the cluster's size and its most typical photos."""
    found = medoid_clusters(_verified(spark, folder, True))
    return found.select(F.col("id").cast("int").alias("photo_id"), F.col("cluster_id").cast("int").alias("cluster_id"), "size", F.array_join("typical", "|").alias("typical"))


QUERIES = {"p2_found": p2_found, "p2_clusters": p2_clusters}
_KEPT = """
WITH kept AS (
    SELECT id, date_taken, CASE WHEN len(feature_vector) = 128 AND len(list_filter(feature_vector, lambda x: x IS NULL)) = 0
      AND len(list_filter(feature_vector, lambda x: x <> 0)) > 0 THEN feature_vector::DOUBLE[] END AS v
    FROM (SELECT *, row_number() OVER (PARTITION BY lower(file_path) ORDER BY id) AS nth FROM photos)
    WHERE nth = 1 AND date_taken >= TIMESTAMP '1990-01-01' AND date_taken <= imported_at),
  usable AS (SELECT id, date_taken, v::DOUBLE[128] AS v FROM kept WHERE v IS NOT NULL),
  alike AS (
    SELECT a.id, b.id AS other FROM usable a JOIN usable b ON a.date_taken - b.date_taken BETWEEN INTERVAL (-30) DAY AND INTERVAL 30 DAY
      AND (a.id = b.id OR array_cosine_similarity(a.v, b.v) >= 0.85)),
  around AS (SELECT id, list_sort(list(other)) AS closed FROM alike GROUP BY id)
"""
SQL = {
    "p2_found": f"""{_KEPT}
SELECT closed[1] AS cluster_id, unnest(closed) AS photo_id FROM around GROUP BY closed HAVING count(*) = len(closed) AND len(closed) >= 3""",
    # Rounds: whose best neighbour among those left (itself included) is itself, heads; whose best one is a head, joins it.
    "p2_clusters": f"""{_KEPT.replace("WITH", "WITH RECURSIVE", 1)},
  cosines AS (SELECT a.id, a.other, CASE WHEN a.id <> a.other THEN array_cosine_similarity(x.v, y.v) END AS s FROM alike a JOIN usable x ON x.id = a.id JOIN usable y ON y.id = a.other),
  degrees AS (SELECT id, count(*) - 1 AS degree, round(avg(s), 9) AS likeness FROM cosines GROUP BY id),
  ranked AS (SELECT *, row_number() OVER (ORDER BY degree DESC, id) AS place FROM degrees),
  edges AS (SELECT a.id, a.other, r.place FROM alike a JOIN ranked r ON r.id = a.other),
  rounds AS (
    SELECT id, NULL::INTEGER AS medoid, 0 AS n FROM usable
    UNION ALL
    SELECT id, CASE WHEN heads THEN best END, n + 1 FROM (
      SELECT b.id, b.best, b.n, coalesce(bool_or(b.best = b.id) OVER (PARTITION BY b.best), false) AS heads FROM (
        SELECT l.id, l.n, arg_min(e.other, e.place) AS best FROM rounds l JOIN edges e ON e.id = l.id JOIN rounds m ON m.id = e.other AND m.medoid IS NULL
        WHERE l.medoid IS NULL GROUP BY l.id, l.n) b)),
  member AS (SELECT id, medoid FROM rounds WHERE medoid IS NOT NULL),
  typical AS (SELECT medoid, list(id ORDER BY nth) AS typical FROM (
    SELECT m.medoid, m.id, row_number() OVER (PARTITION BY m.medoid ORDER BY d.degree DESC, d.likeness DESC NULLS LAST, m.id) AS nth FROM member m JOIN degrees d ON d.id = m.id)
    WHERE nth <= 3 GROUP BY medoid)
SELECT m.id AS photo_id, m.medoid AS cluster_id, count(*) OVER (PARTITION BY m.medoid) AS size, array_to_string(t.typical, '|') AS typical FROM member m JOIN typical t ON t.medoid = m.medoid""",
}
