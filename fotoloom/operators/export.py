"""Album export: the manifest of copies, the copying itself, and a preview page."""

from __future__ import annotations

import html
import os
import shutil
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotoloom.functions.naming import page_file, page_folder

#: Photos on one preview page at most; a larger album needs several.
PREVIEW_PHOTOS = 20_000


def album_manifest(album_rows: DataFrame, photos: DataFrame, target: str) -> DataFrame:
    """`source`, `target` of every photo of the album. album_rows: `page_number`, `photo_index`, `theme`, `photo_id`; a null
    theme is "Collection". Rows whose photo is unknown have nothing to copy and are left out; repeated rows count once."""
    rows = album_rows.select("page_number", "photo_index", F.coalesce("theme", F.lit("Collection")).alias("theme"), F.col("photo_id").alias("id")).distinct()
    known = photos.where("id is not null").select("id", "file_path", "file_name")
    return rows.join(known, "id").select(
        F.col("file_path").alias("source"),
        F.concat_ws("/", F.lit(target), page_folder("page_number", "theme"), page_file("page_number", "photo_index", "file_name")).alias("target"),
    )


def copy_files(manifest: DataFrame) -> None:
    """Copies on the executors, for storage that all of them mount; existing targets and missing sources are passed over."""

    def copy(rows: Iterator) -> None:
        for r in rows:
            if os.path.exists(r.source) and not os.path.exists(r.target):
                try:
                    os.makedirs(os.path.dirname(r.target), exist_ok=True)
                    shutil.copyfile(r.source, r.target)
                except OSError:
                    continue

    manifest.select("source", "target").foreachPartition(copy)


def _preview_rows(album_rows: DataFrame, photos: DataFrame) -> DataFrame:
    known = photos.select(F.col("id").alias("photo_id"), "file_path", "file_name")
    rows = album_rows.join(known, "photo_id").select("page_number", "photo_index", "theme", "date_taken", "file_path", "file_name")
    return rows.orderBy("page_number", "photo_index")


def _preview(found: list, title: str, links: str = "") -> str:
    pages: dict[int, list] = {}
    for r in found:
        pages.setdefault(r.page_number, []).append(r)
    cards = []
    for n, page in pages.items():
        days = sorted({f"{r.date_taken:%b %d, %Y}" for r in page if r.date_taken}, key=lambda d: d)
        head = html.escape(f"Page {n}: {(page[0].theme or 'Collection').replace('_', ' ')}")
        images = "".join(f'<img src="file://{html.escape(r.file_path or "", quote=True)}" alt="{html.escape(r.file_name or "", quote=True)}">' for r in page)
        cards.append(f"<section><h2>{head}</h2><p>{html.escape(' - '.join(days))}, {len(page)} photos</p>{images}</section>")
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{links}{"".join(cards)}</body></html>'


def preview_html(album_rows: DataFrame, photos: DataFrame, title: str = "Album") -> str:
    """One page of HTML; text is escaped. Refuses an album too large for one page rather than leaving photos out;
    `write_previews` divides it."""
    found = _preview_rows(album_rows, photos).limit(PREVIEW_PHOTOS + 1).collect()
    if len(found) > PREVIEW_PHOTOS:
        raise ValueError(f"more than {PREVIEW_PHOTOS} photos; write_previews writes several pages")
    return _preview(found, title)


def write_previews(album_rows: DataFrame, photos: DataFrame, folder: str, title: str = "Album", most: int = PREVIEW_PHOTOS) -> int:
    """Writes preview.html and, for an album of more than `most` photos, preview_002.html and so on, each with a range of
    album pages and links to its neighbours; how many. An album page is divided only if it alone has more photos. The driver
    holds the photos of one file and one partition."""

    def name(n: int) -> str:
        return "preview.html" if n == 1 else f"preview_{n:03d}.html"

    def write(n: int, found: list, more: bool) -> None:
        links = (f'<a href="{name(n - 1)}">Previous</a> ' if n > 1 else "") + (f'<a href="{name(n + 1)}">Next</a>' if more else "")
        with open(os.path.join(folder, name(n)), "w", encoding="utf-8") as f:
            f.write(_preview(found, title, f"<p>{links}</p>" if links else ""))

    n, found = 1, []
    for r in _preview_rows(album_rows, photos).toLocalIterator():
        if len(found) == most:
            # The album page that r goes on with moves to the next file, unless it fills this one.
            cut = next((k for k in range(most, 0, -1) if found[k - 1].page_number != r.page_number), 0) or most
            write(n, found[:cut], True)
            n, found = n + 1, found[cut:]
        found.append(r)
    write(n, found, False)
    return n
