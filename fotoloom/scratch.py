"""Cutting lineage: intermediate results as tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; only where it is unset (tests, local mode) a temporary folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fotoloom-"))
        folder = sc.getCheckpointDir()
    return folder


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` once as Parquet into the shared folder and read it from there.

    The files outlive any executor, so a lost one costs at most the tasks that it was running. They stay until
    `release` or the end of the driver's process, for lazily evaluated results may still refer to them. options: of the writer.
    """
    path = f"{shared_folder(df.sparkSession)}/fotoloom-{name}-{uuid.uuid4().hex}"
    # The shuffles behind earlier tables are of no more use; their files go once the driver notices that nothing refers to them.
    df.sparkSession.sparkContext._jvm.System.gc()
    df.write.options(**options).parquet(path)
    if not _written:
        atexit.register(release)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete every table that `materialize` has written in this process."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while _written:
            path = jvm.org.apache.hadoop.fs.Path(_written.pop())
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # the gateway may be gone already at exit
        pass
