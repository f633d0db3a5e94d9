"""Photos that keep arriving: a file stream whose micro-batches are committed as catalog versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fotoloom.config import DEFAULTS
from fotoloom.operators.catalog import Catalog
from fotoloom.schema import PHOTOS


def photo_stream(spark: SparkSession, folder: str, files_per_batch: int = DEFAULTS.commit_batch) -> DataFrame:
    return spark.readStream.schema(PHOTOS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(stream: DataFrame, catalog: Catalog, checkpoint: str) -> StreamingQuery:
    """Upserts every micro-batch, each as one version; ends when all files present at the start are in."""

    def save(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            catalog.save(batch)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def session_stream(events: DataFrame, entity: str, time: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of a stream: `entity`, `start`, `end` (of the last event plus the gap), `events`. A session is final when the
    watermark passes its end; later events are too late. A gap of exactly the given length splits here, as windows are
    half-open; `operators.sessions` has the exact rule for stored tables."""
    return (
        events.where(F.col(entity).isNotNull())
        .withColumn("_time", F.col(time).cast("timestamp"))
        .withWatermark("_time", late)
        .groupBy(F.col(entity).alias("entity"), F.session_window("_time", gap).alias("_w"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select("entity", F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "events")
    )
