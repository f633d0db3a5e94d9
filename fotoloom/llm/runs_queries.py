"""Problem 5: runs of the same picture along each device's photos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotoloom.functions.times import from_micros
from fotoloom.llm.runs import collapse_runs
from fotoloom.operators.canonical import device_key, drop_reimports, valid_date
from fotoloom.sources.tables import table

MAX_GAP_SECONDS = 15
MIN_SIMILARITY = 0.92
DIM = 128


def p5_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Each run with its number of photos and the time from first to last."""
    photos = drop_reimports(table(spark, folder, "photos"))
    line = photos.where(valid_date()).select(device_key().alias("device_key"), "date_taken", "id", "feature_vector").where("device_key is not null")
    runs = collapse_runs(line, "device_key", "date_taken", "id", "feature_vector", MAX_GAP_SECONDS, MIN_SIMILARITY, DIM)
    return runs.select(
        F.col("entity").alias("device_key"), F.col("first_id").cast("int").alias("first_photo_id"), F.col("last_id").cast("int").alias("last_photo_id"),
        F.col("events").alias("photos"), from_micros("first_t").alias("run_start"), "seconds",
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_runs(spark, folder).select("device_key", "first_photo_id", "last_photo_id")


_RUNS = """
WITH line AS (
    SELECT id, date_taken, lower(trim(device_id)) AS device_key, 
      CASE WHEN len(feature_vector) = 128 AND len(list_filter(feature_vector, lambda x: x IS NULL)) = 0 AND len(list_filter(feature_vector, lambda x: x <> 0)) > 0
        THEN feature_vector::DOUBLE[] END AS v
    FROM (SELECT *, row_number() OVER (PARTITION BY lower(file_path) ORDER BY id) AS nth FROM photos)
    WHERE nth = 1 AND date_taken >= TIMESTAMP '1990-01-01' AND date_taken <= imported_at AND trim(device_id) <> ''),
  beside AS (
    SELECT *, lag(v) OVER w AS v0, lag(date_taken) OVER w AS t0
    FROM line WINDOW w AS (PARTITION BY device_key ORDER BY date_taken, id)),
  marked AS (
    SELECT *, CASE WHEN v IS NOT NULL AND v0 IS NOT NULL AND date_taken - t0 <= INTERVAL 15 SECOND
      THEN CASE WHEN list_cosine_similarity(v, v0) >= 0.92 THEN 0 ELSE 1 END ELSE 1 END AS fresh FROM beside),
  numbered AS (
    SELECT *, sum(fresh) OVER (PARTITION BY device_key ORDER BY date_taken, id ROWS UNBOUNDED PRECEDING) AS run FROM marked)
"""
QUERIES = {"p5_found": p5_found, "p5_runs": p5_runs}
SQL = {
    "p5_found": f"""{_RUNS}
SELECT device_key, arg_min(id, (date_taken, id)) AS first_photo_id, arg_max(id, (date_taken, id)) AS last_photo_id
FROM numbered GROUP BY device_key, run HAVING count(*) > 1""",
    "p5_runs": f"""{_RUNS}
SELECT device_key, arg_min(id, (date_taken, id)) AS first_photo_id, arg_max(id, (date_taken, id)) AS last_photo_id, count(*) AS photos,
  min(date_taken) AS run_start, (epoch_us(max(date_taken)) - epoch_us(min(date_taken))) / 1000000.0 AS seconds
FROM numbered GROUP BY device_key, run HAVING count(*) > 1""",
}
