"""Folders on any file system that Spark writes to: scratch space, and outputs that appear whole or not at all."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where
    that is unset and driver and tasks are one process. Deleted when the process ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="ledgerlight_"))
        shared = _own[0]
    path = f"{shared}/{name}-{uuid.uuid4().hex}"
    atexit.register(_quietly_deleted, spark, path)
    return path


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)


def _quietly_deleted(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session has ended; the folder is the cluster's to clean
        pass


def staging(path: str) -> str:
    """Beside ``path``, so that publishing is a rename."""
    return f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Put a finished folder in the place of ``path``; what was there goes only once the new one is in place."""
    system, new = _at(spark, staged)
    place, old = _at(spark, path)[1], _at(spark, f"{staged}.old")[1]
    replaced = system.exists(place)
    if replaced and not system.rename(place, old):
        raise OSError(f"{path} can't be moved away")
    if not system.rename(new, place):
        if replaced:
            system.rename(old, place)
        raise OSError(f"{staged} can't be moved to {path}")
    if replaced:
        system.delete(old, True)
