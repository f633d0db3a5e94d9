"""Queries on the photos' timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotoloom.operators.canonical import canonical_photos, device_key, valid_date
from fotoloom.operators.sessions import sessions
from fotoloom.sources.tables import table

SESSION_GAP_HOURS = 6


def timeline(spark: SparkSession, folder: str) -> DataFrame:
    """`device_key`, `date_taken`, `id` of every photo with a device and a valid date."""
    return (
        canonical_photos(table(spark, folder, "photos"), "device_id", "date_taken", "imported_at")
        .select(device_key().alias("device_key"), "date_taken", "imported_at", "id")
        .where(valid_date() & F.col("device_key").isNotNull())
        .drop("imported_at")
    )


def p1_sessions(spark: SparkSession, folder: str) -> DataFrame:
    found = sessions(timeline(spark, folder), "device_key", "date_taken", "id", SESSION_GAP_HOURS * 3600)
    return found.select(
        F.col("entity").alias("device_key"), F.col("first_id").alias("first_photo_id"), F.col("last_id").alias("last_photo_id"),
        F.col("start").alias("session_start"), F.col("end").alias("session_end"), "seconds", F.col("events").alias("photos"),
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_sessions(spark, folder).select("device_key", "first_photo_id", "last_photo_id")


TIMELINE_SQL = """
  timeline AS (
    SELECT id, date_taken, lower(trim(device_id)) AS device_key FROM (
      SELECT *, row_number() OVER (PARTITION BY lower(file_path) ORDER BY id) AS nth FROM photos)
    WHERE nth = 1 AND date_taken >= TIMESTAMP '1990-01-01' AND date_taken <= imported_at AND trim(device_id) <> '')
"""

_SESSIONS_SQL = f"""
WITH {TIMELINE_SQL},
  marked AS (
    SELECT *, CASE WHEN date_taken - lag(date_taken) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
    FROM timeline WINDOW w AS (PARTITION BY device_key ORDER BY date_taken, id)),
  numbered AS (
    SELECT *, sum(fresh) OVER (PARTITION BY device_key ORDER BY date_taken, id ROWS UNBOUNDED PRECEDING) AS session
    FROM marked)
"""

P1_SESSIONS_SQL = f"""{_SESSIONS_SQL}
SELECT device_key, arg_min(id, (date_taken, id)) AS first_photo_id, arg_max(id, (date_taken, id)) AS last_photo_id,
  min(date_taken) AS session_start, max(date_taken) AS session_end,
  (epoch_us(max(date_taken)) - epoch_us(min(date_taken))) / 1000000.0 AS seconds, count(*) AS photos
FROM numbered GROUP BY device_key, session
"""

P1_FOUND_SQL = f"""{_SESSIONS_SQL}
SELECT device_key, arg_min(id, (date_taken, id)) AS first_photo_id, arg_max(id, (date_taken, id)) AS last_photo_id
FROM numbered GROUP BY device_key, session
"""

QUERIES = {"p1_found": p1_found, "p1_sessions": p1_sessions}
SQL = {"p1_found": P1_FOUND_SQL, "p1_sessions": P1_SESSIONS_SQL}
