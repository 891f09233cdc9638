"""Cutting lineage through the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where the session names none and runs in one
    process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = _folder(spark, path)
    fs.deleteOnExit(where)
    return path


def file_versions(spark: SparkSession, paths: list[str]) -> tuple:
    """(name, bytes, time of change) of every file at or directly below ``paths``: equal as long as no file changes."""
    out = []
    for path in paths:
        fs, where = _folder(spark, path)
        if fs.exists(where):
            out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(where)]
    return tuple(sorted(out))


def stage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts its lineage, survives lost executors, has true sizes.

    The files go with ``drop_stage``, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = temporary_folder(spark, "stage")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_stage(*staged: DataFrame) -> None:
    """Deletes the files of tables from ``stage``, once nothing is read from them any more."""
    for df in staged:
        fs, where = _folder(df.sparkSession, df._staged_at)
        fs.delete(where, True)
