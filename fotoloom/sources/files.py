"""Files and folders as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotoloom.config import IMAGE_SUFFIXES
from fotoloom.functions.naming import base_name


def _any_case(suffix: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """Image files below a folder: `file_path`, `file_name`, `date_taken`, `file_size_bytes`. Contents are not read. Spark
    tells when a file was last modified, not when it was created; that time stands for the date until a header is read."""
    pattern = "*.{" + ",".join(_any_case(s) for s in IMAGE_SUFFIXES) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = F.regexp_replace("path", "^file:(//)?", "")
    return files.select(
        path.alias("file_path"), base_name(path).alias("file_name"), F.col("modificationTime").cast("timestamp_ntz").alias("date_taken"), F.col("length").alias("file_size_bytes")
    )


def folder_tree(files: DataFrame, path: str = "file_path") -> DataFrame:
    """Every folder that holds a file, directly or below: `folder_path`, `folder_name`, `parent_path` (null at the top),
    `depth` (from 1), `files` (below it). Folders without files cannot be seen from a listing of files; null paths are none."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    # One row per (file, ancestor) would be paths times depth; folders are counted first, which combines before the shuffle.
    direct = files.where(F.col(path).isNotNull()).select(parts.alias("_p")).select(F.slice("_p", 1, F.greatest(F.size("_p") - 1, F.lit(0))).alias("_f"))
    direct = direct.where(F.size("_f") > 0).groupBy("_f").agg(F.count(F.lit(1)).alias("_n"))
    above = direct.select("_n", F.explode(F.transform(F.sequence(F.lit(1), F.size("_f")), lambda k: F.slice("_f", 1, k))).alias("_a"))
    join = lambda c: F.concat(F.lit("/"), F.array_join(c, "/"))
    return (
        above.groupBy("_a")
        .agg(F.sum("_n").alias("files"))
        .select(
            join("_a").alias("folder_path"), F.element_at("_a", -1).alias("folder_name"),
            F.when(F.size("_a") > 1, join(F.slice("_a", 1, F.size("_a") - 1))).alias("parent_path"), F.size("_a").alias("depth"), "files",
        )
    )


def walk(folders: DataFrame, root: str) -> DataFrame:
    """The folders at and below `root`, depth first, as a sorted table (a folder's path orders it before its children)."""
    root = root.rstrip("/")
    below = folders.where((F.col("folder_path") == root) | F.col("folder_path").startswith(root + "/"))
    return below.orderBy(F.split("folder_path", "/"))
