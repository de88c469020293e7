"""Folders through Hadoop's file system, whatever their scheme."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def renamed(spark: SparkSession, draft: str, path: str) -> bool:
    """Moves a folder to a path that must not exist yet; otherwise removes it. Whether it was moved."""
    files, old = _at(spark, draft)
    _, new = _at(spark, path)
    files.mkdirs(new.getParent())
    if not files.exists(new) and files.rename(old, new):
        return True
    files.delete(old, True)
    return False


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; it goes when the application ends. Only a
    local session may lack that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.gettempdir()
    files, at = _at(spark, f"{root.rstrip('/')}/tallyforge-{name}-{uuid.uuid4().hex[:12]}")
    at = files.makeQualified(at)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return at.toString()
