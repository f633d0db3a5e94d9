"""The gallery: filters and order of the photos shown, new files, and flat export of favorites.

Defined results: null flags count as false and null face counts as 0; a null path is in no folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotoloom.config import IMAGE_SUFFIXES
from fotoloom.functions.naming import base_name
from fotoloom.functions.tags import catalog_tags


def in_folder(photos: DataFrame, folder: str | None, strict: bool = False) -> DataFrame:
    """Paths that start with the folder, letter case ignored; strict: followed by a separator. No folder, no photos."""
    if folder is None:
        return photos.where(F.lit(False))
    low = folder.lower()
    path = F.lower("file_path")
    if not strict:
        return photos.where(path.startswith(low))
    low = low.rstrip("/\\")
    return photos.where(path.startswith(low + "/") | path.startswith(low + "\\"))


def favorites(photos: DataFrame) -> DataFrame:
    return photos.where("is_favorite")


def people(photos: DataFrame) -> DataFrame:
    return photos.where("face_count > 0")


def gallery(photos: DataFrame, folder: str | None, only_favorites: bool = False, only_people: bool = False, strict: bool = False) -> DataFrame:
    """The photos shown, by date, then id; those without an id yet (0) come after the others of their time, by path."""
    shown = in_folder(photos, folder, strict)
    shown = favorites(shown) if only_favorites else shown
    shown = people(shown) if only_people else shown
    return shown.orderBy("date_taken", F.col("id") == 0, "id", "file_path")


def needs_analysis(photos: DataFrame) -> DataFrame:
    """Not analyzed, or without tags."""
    return photos.where(~F.coalesce("is_analyzed", F.lit(False)) | (F.size(catalog_tags("tags")) == 0))


def is_image(path: str = "file_path"):
    return F.col(path).rlike(rf"(?i)\.({'|'.join(IMAGE_SUFFIXES)})$")


def new_files(files: DataFrame, catalog: DataFrame, path: str = "file_path") -> DataFrame:
    """Scanned image files that the catalog lacks, letter case ignored; of paths that differ only in case, the least."""
    key = F.lower(path)
    scanned = files.where(is_image(path)).groupBy(key.alias("_key")).agg(F.min(path).alias(path))
    known = catalog.select(key.alias("_key")).where("_key is not null")
    return scanned.join(known, "_key", "left_anti").select(path, base_name(path).alias("file_name"))


def favorites_manifest(photos: DataFrame, target: str) -> DataFrame:
    """`source`, `target`, `copied` of every favorite: of equal file names only the first (by id) is copied, all count."""
    chosen = favorites(photos).select("id", "file_path", "file_name")
    # Combined before the shuffle, so that a name which many cameras give fills no single task.
    first = chosen.groupBy(F.col("file_name").alias("_name")).agg(F.min("id").alias("_first"))
    return chosen.join(first, F.col("file_name").eqNullSafe(F.col("_name"))).select(
        "id", F.col("file_path").alias("source"), F.concat_ws("/", F.lit(target), "file_name").alias("target"), (F.col("id") == F.col("_first")).alias("copied")
    )
