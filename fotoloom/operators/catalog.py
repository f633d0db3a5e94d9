"""The catalog as versioned snapshots: upsert, point update and clearing, each a new version beside the old one."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotoloom.schema import PHOTOS
from fotoloom.scratch import materialize

#: How often a writer starts again after another one has committed the version it was working on.
RETRIES = 20

#: An upsert changes these where the path is stored; all other columns keep what was first inserted.
UPDATED = ("is_analyzed", "sharpness_score", "face_count", "is_favorite", "tags", "feature_vector")


def upsert(stored: DataFrame, batch: DataFrame, order: str = "id", columns: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of `stored` and `batch` as one per `file_path` (case-sensitive).

    Within the batch the first row by `order` gives a new path's insert-only columns and the last one the updated columns.
    Defined results: rows with a null path are left out; an empty batch changes nothing; of rows with equal `order` the
    one whose values (of the columns concerned, one after the other) are least is first, and the one whose values are greatest last.
    Both sides are pre-aggregated by path, so one path may fill the whole batch.
    """
    columns = columns or tuple(c for c in stored.columns if c != "file_path")
    fixed, changing = [c for c in columns if c not in UPDATED], [c for c in columns if c in UPDATED]
    first = F.min_by(F.struct(*fixed), F.struct(F.col(order).alias("_o"), *fixed)).alias("_f")
    last = F.max_by(F.struct(*changing), F.struct(F.col(order).alias("_o"), *changing)).alias("_c")
    both = batch.where("file_path is not null").groupBy("file_path").agg(first, last)
    old = stored.where("file_path is not null").select("file_path", *(F.col(c).alias(f"_old_{c}") for c in columns), F.lit(True).alias("_stored"))
    joined = old.join(both, "file_path", "full_outer")
    kept = F.coalesce("_stored", F.lit(False))
    out = []
    for c in columns:
        if c in changing:
            out.append(F.when(F.col("_c").isNotNull(), F.col(f"_c.{c}")).otherwise(F.col(f"_old_{c}")).alias(c))
        else:
            out.append(F.when(kept, F.col(f"_old_{c}")).otherwise(F.col(f"_f.{c}")).alias(c))
    return joined.select("file_path", *out)


def set_favorites(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """`is_favorite` by `file_path` from `updates`; unknown paths change nothing; of several updates true wins."""
    wanted = updates.where("file_path is not null").groupBy("file_path").agg(F.max("is_favorite").alias("_f"))
    return stored.join(wanted, "file_path", "left").withColumn("is_favorite", F.coalesce("_f", "is_favorite")).drop("_f")


def affected_rows(stored: DataFrame, updates: DataFrame) -> int:
    return stored.join(updates.select("file_path"), "file_path", "left_semi").count()


def clear_tags(stored: DataFrame, shown) -> DataFrame:
    """Photos for which `shown` (a condition) holds lose their tags and count as not analyzed; vectors stay."""
    hit = F.coalesce(F.expr(shown) if isinstance(shown, str) else shown, F.lit(False))
    return stored.withColumn("tags", F.when(hit, F.array().cast("array<string>")).otherwise(F.col("tags"))).withColumn(
        "is_analyzed", F.when(hit, F.lit(False)).otherwise(F.col("is_analyzed"))
    )


def with_ids(rows: DataFrame, above: int, row_id: str = "id", key: str = "file_path") -> DataFrame:
    """Rows without an id (null or 0) numbered by `key` from `above` + 1 on, without a window over all of them: each range of
    keys is numbered in itself and starts after those before it."""
    new = rows.where(F.coalesce(F.col(row_id), F.lit(0)) == 0)
    ranged = materialize(new.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "new")
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row per range
    kind = rows.schema[row_id].dataType
    numbered = ranged.join(F.broadcast(starts), "_range").withColumn(row_id, (F.lit(above) + F.col("_before") + nth).cast(kind)).select(rows.columns)
    return rows.where(F.coalesce(F.col(row_id), F.lit(0)) != 0).unionByName(numbered)


class Catalog:
    """A folder of Parquet snapshots. A version exists once its commit file does, which names the snapshot's folder and is
    created exclusively: of two writers of a version one succeeds, and the other starts again from what that one wrote. A
    reader never sees a half-written version. (Exclusive creation is atomic on HDFS, local disks and the object stores
    whose file systems for Hadoop support it.)"""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("_commit="))

    def create(self) -> None:
        """Nothing happens if the catalog exists."""
        if not self.versions():
            self._commit(self.spark.createDataFrame([], PHOTOS), 0)

    def _commit(self, rows: DataFrame, version: int) -> bool:
        """Whether the version is now this one; else someone else has written it and nothing has changed."""
        data = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{data}")
        try:
            out = self._fs.create(self._path(f"_commit={version:020d}"), False)
        except Exception as e:
            self._fs.delete(self._path(data), True)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(data.encode()))
        out.close()
        return True

    def _data(self, version: int) -> str:
        """The folder of a version's snapshot; waits for a writer that has created the commit file and not filled it yet."""
        for _ in range(200):
            name = self._first_line(version)
            if name:
                return name
            time.sleep(0.05)
        raise RuntimeError(f"the commit file of version {version} is empty")

    def _first_line(self, version: int) -> str:
        opened = self._fs.open(self._path(f"_commit={version:020d}"))
        try:
            raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
        finally:
            opened.close()
        return raw.strip()

    def read(self, version: int | None = None) -> DataFrame:
        if version is None:
            have = self.versions()
            if not have:
                raise FileNotFoundError(self.folder)
            version = have[-1]
        return self.spark.read.parquet(f"{self.folder}/{self._data(version)}")

    def _change(self, change: Callable[[DataFrame], DataFrame | None]) -> None:
        """Commits what `change` makes of the current version, as the next one; on a conflict, of the version then current."""
        for _ in range(RETRIES):
            have = self.versions()
            if not have:
                raise FileNotFoundError(self.folder)
            rows = change(self.read(have[-1]))
            if rows is None or self._commit(rows, have[-1] + 1):
                return
        raise RuntimeError(f"{RETRIES} writers were faster")

    def save(self, batch: DataFrame, order: str = "id") -> None:
        """Upserts a batch. New paths without an id (null or 0) are numbered after the greatest stored id, by path."""

        def saved(stored: DataFrame) -> DataFrame:
            columns = tuple(c for c in stored.columns if c != "file_path")
            rows = materialize(upsert(stored, batch, order, columns).select(stored.columns), "upserted")
            greatest = rows.agg(F.max("id")).first()[0] or 0
            return with_ids(rows, greatest)

        self._change(saved)

    def set_favorites(self, updates: DataFrame) -> int:
        n = 0

        def changed(stored: DataFrame) -> DataFrame | None:
            nonlocal n
            n = affected_rows(stored, updates)
            return set_favorites(stored, updates).select(stored.columns) if n else None

        self._change(changed)
        return n

    def clear_tags(self, shown) -> None:
        self._change(lambda stored: clear_tags(stored, shown))
