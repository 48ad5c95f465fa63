"""Parquet results and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_result(df: DataFrame, path: str) -> DataFrame:
    """Overwrite ``path`` with ``df`` as Parquet and return the stored rows.

    The plan runs once: whatever the caller derives from the returned frame reads the files, so the written
    rows and the answer can never differ.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_FOLDERS: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The session's folder for intermediate tables, below the one that ``spark.checkpoint.dir`` names.

    That folder has to be one every executor sees. Only a local-mode session without the setting uses a temporary folder of this
    machine; it is one for the whole session and goes when Python ends.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return f"{folder.rstrip('/')}/crashlens-{context.applicationId}"
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _FOLDERS:
        own = tempfile.TemporaryDirectory(prefix="crashlens-", ignore_cleanup_errors=True)
        atexit.register(own.cleanup)
        _FOLDERS[context.applicationId] = own.name
    return _FOLDERS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the session's folder."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
