"""One row per photo: re-imports of a file, under any letter case of its path, are represented by the smallest id.

Defined results: rows without an id stand for nothing and are left out; a null path is no file, so each such row is a
photo of its own. Extra columns of the input are ignored unless asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotoloom.scratch import materialize

#: Ids that are broadcast at most (8 bytes each); more are joined through a shuffle.
BROADCAST_IDS = 2_000_000

VALID_FROM = "1990-01-01 00:00:00"


def path_key(path: str | Column = "file_path", row_id: str | Column = "id") -> Column:
    """The key under which rows are one photo."""
    return F.coalesce(F.concat(F.lit("p"), F.lower(path)), F.concat(F.lit("i"), F.col(row_id).cast("string") if isinstance(row_id, str) else row_id.cast("string")))


def device_key(device: str | Column = "device_id") -> Column:
    """Trimmed and in lower case; blank is null."""
    return F.nullif(F.lower(F.btrim(device)), F.lit(""))


def valid_date(taken: str = "date_taken", imported: str = "imported_at", since: str = VALID_FROM) -> Column:
    return (F.col(taken) >= F.lit(since).cast("timestamp_ntz")) & (F.col(taken) <= F.col(imported))


def canonical_photos(photos: DataFrame, *columns: str, path: str = "file_path", row_id: str = "id") -> DataFrame:
    """`row_id` and the named (narrow) columns of one row per photo, by one aggregation that combines before its shuffle."""
    kept = [c for c in dict.fromkeys(columns) if c != row_id]
    row = F.struct(F.col(row_id).alias("_0"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(kept, 1)))
    return (
        photos.where(F.col(row_id).isNotNull())
        .groupBy(path_key(path, row_id).alias("_key"))
        .agg(F.min(row).alias("_row"))
        .select(F.col("_row._0").alias(row_id), *(F.col(f"_row._{i}").alias(c) for i, c in enumerate(kept, 1)))
    )


def reimport_ids(photos: DataFrame, path: str = "file_path", row_id: str = "id") -> DataFrame:
    """The ids (`_dup`) that `canonical_photos` drops: only ids and paths are read, and only 128-bit keys shuffled."""
    slim = photos.where(F.col(row_id).isNotNull() & F.col(path).isNotNull()).select(
        F.xxhash64(F.lower(path)).alias("_h1"), F.xxhash64(F.lit("again"), F.lower(path)).alias("_h2"), F.col(row_id).cast("long").alias("_dup")
    )
    kept = slim.groupBy("_h1", "_h2").agg(F.min("_dup").alias("_keep"), F.max("_dup").alias("_last"))
    return slim.join(kept.where("_keep < _last").select("_h1", "_h2", "_keep"), ["_h1", "_h2"]).where("_dup > _keep").select("_dup")


def drop_reimports(photos: DataFrame, path: str = "file_path", row_id: str = "id") -> DataFrame:
    """`photos` without re-imports, for wide rows (vectors): these are not shuffled while the dropped ids are few.

    The ids are broadcast only when counted to be at most `BROADCAST_IDS`; else the rows are joined through a shuffle.
    """
    dropped = materialize(reimport_ids(photos, path, row_id), "reimports")
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return photos.where(F.col(row_id).isNotNull()).join(dropped, F.col(row_id).cast("long") == F.col("_dup"), "left_anti")
