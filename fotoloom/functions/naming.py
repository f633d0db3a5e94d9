"""Names of pages, folders and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def theme(kinds: str | Column) -> Column:
    """Distinct kinds in dictionary order, blanks as underscores, joined; "Collection" for none."""
    kinds = F.col(kinds) if isinstance(kinds, str) else kinds
    order = F.array_sort(F.transform(F.array_distinct(kinds), lambda k: F.collate(k, "UNICODE")))
    words = F.filter(F.transform(order, lambda k: F.replace(k.cast("string"), F.lit(" "), F.lit("_"))), lambda k: k != "")
    return F.when(F.size(words) > 0, F.array_join(words, "_and_")).otherwise("Collection")


def safe_name(name: str | Column) -> Column:
    """Characters that file systems refuse become underscores, which are then trimmed at both ends."""
    name = F.col(name) if isinstance(name, str) else name
    return F.btrim(F.regexp_replace(name, r'[\x00-\x1f<>:"/\\|?*]', "_"), F.lit("_"))


def page_folder(page: str | Column, page_theme: str | Column) -> Column:
    return F.format_string("Page_%03d_%s", page, safe_name(page_theme))


def page_file(page: str | Column, index: str | Column, file_name: str | Column) -> Column:
    return F.format_string("%03d_%02d_%s", page, index, file_name)


def base_name(path: str | Column) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.element_at(F.split(path, r"[/\\]"), -1)
