"""Whole workflows: opening a folder, analyzing what is shown, generating an album, exporting favorites."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotoloom.config import DEFAULTS, CurationConfig
from fotoloom.operators import album, gallery, tagging
from fotoloom.operators.catalog import Catalog
from fotoloom.operators.export import album_manifest, copy_files, write_previews
from fotoloom.schema import PHOTOS
from fotoloom.scratch import materialize
from fotoloom.sources.files import scan_images


def with_new_files(stored: DataFrame, files: DataFrame) -> DataFrame:
    """The catalog's rows and those of scanned files that it lacks (letter case ignored), which have id 0 until saved."""
    new = files.join(gallery.new_files(files, stored).select("file_path"), "file_path", "left_semi").dropDuplicates(["file_path"])
    given = {"id": F.lit(0), "is_analyzed": F.lit(False), "sharpness_score": F.lit(0.0), "face_count": F.lit(0), "is_favorite": F.lit(False),
             "tags": F.array(), "keywords": F.lit(""), "primary_kind": F.lit("")}
    columns = [(F.col(f.name) if f.name in new.columns else given.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in PHOTOS]
    return stored.select([f.name for f in PHOTOS]).unionByName(new.select(columns))


def open_folder(spark: SparkSession, catalog: Catalog, root: str, folder: str | None = None, **filters) -> DataFrame:
    """The gallery of a folder: stored photos and new files, filtered and in order."""
    return gallery.gallery(with_new_files(catalog.read(), scan_images(spark, root)), root if folder is None else folder, **filters)


def analyze_shown(
    catalog: Catalog,
    shown: DataFrame,
    categories: DataFrame,
    images: DataFrame | None = None,
    cfg: CurationConfig = DEFAULTS,
    progress: Callable[[int, int], None] = lambda done, of: None,
    commit: int | None = None,
) -> int:
    """Analyzes the photos shown that need it and saves them; how many there were.

    images: what `sources.images.photo_results` gives. commit: about how many photos one version saves at most (None: all in
    one); every version is on its own, so what is saved stays if a later one fails. progress hears after each commit how
    many of them all are done. New photos get their ids when they are saved."""
    work = materialize(tagging.analyze(gallery.needs_analysis(shown), categories, images, cfg), "analyzed")
    n = work.count()
    parts = max(1, -(-n // commit)) if commit else 1
    done = 0
    for k in range(parts) if n else ():
        some = work if parts == 1 else work.where(F.pmod(F.xxhash64("file_path"), F.lit(parts)) == k)
        catalog.save(some)
        done += some.count() if parts > 1 else n
        progress(done, n)
    return n


def generate_album(photos: DataFrame, target: str, progress: Callable[[str], None] = lambda _: None, cfg: CurationConfig = DEFAULTS) -> int:
    """Copies an album of the whole catalog to a folder with preview pages; how many album pages. Without candidates nothing is
    written. The folder must be mounted by driver and executors alike."""
    progress("selecting photos")
    rows = materialize(album.album(photos, cfg), "album")
    themes = album.page_summary(rows).select("page_number", "theme")
    pages = themes.count()
    if not pages:
        return 0
    progress(f"copying the photos of {pages} pages")
    paged = rows.join(themes, "page_number").withColumnRenamed("taken_date", "date_taken")
    copy_files(album_manifest(paged, photos, target))
    progress("writing the preview")
    os.makedirs(target, exist_ok=True)
    write_previews(paged, photos, target)
    return pages


def export_favorites(photos: DataFrame, target: str) -> int:
    """Copies every favorite of the catalog, whatever is shown; how many there are (equal names are copied once)."""
    manifest = materialize(gallery.favorites_manifest(photos, target), "favorites")
    copy_files(manifest.where("copied"))
    return manifest.count()
