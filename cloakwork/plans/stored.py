"""Written intermediate tables in a folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, SparkSession] = {}


def work_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Where that is unset, below the warehouse if the master is local;
    on a cluster the warehouse may lie on the driver's own disk, so the setting is then asked for.

    It is deleted when the program ends, or earlier by ``release``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        set_by_caller = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = set_by_caller.get() if set_by_caller.isDefined() else None
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/cloakwork-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_release_all)
    _made[folder] = spark
    return folder


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` and read it back: later steps read files instead of computing it again, and all of
    them see the same rows, also after an executor is lost. The shuffle files behind it are given up."""
    spark = df.sparkSession
    folder = work_folder(spark)
    path = f"{folder}/table"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_folder = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` gave, once nothing will read them any more."""
    for df in tables:
        release(df.sparkSession, df._work_folder)


def release(spark: SparkSession, folder: str) -> None:
    """Delete a work folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made.pop(folder, None)


def _release_all() -> None:
    for folder, spark in list(_made.items()):
        try:
            release(spark, folder)
        except Exception:  # the JVM is already gone; nothing can be deleted through it
            return
