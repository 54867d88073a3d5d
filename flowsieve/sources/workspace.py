"""Shared scratch space for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(maxsize=1)
def own_folder() -> tempfile.TemporaryDirectory:
    """A folder of this process, removed when it ends."""
    return tempfile.TemporaryDirectory(prefix="flowsieve-")


def shared_folder(spark: SparkSession, shared: str) -> str:
    """This application's part of the shared folder."""
    return f"{shared.rstrip('/')}/flowsieve/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete all intermediate tables of this application, when the results made from them are written; whether there were any.

    Results that are still lazy read them: write those first.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        there = own_folder.cache_info().currsize > 0
        if there:
            own_folder().cleanup()
            own_folder.cache_clear()
        return there
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark, shared))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of `spark.checkpoint.dir`.

    Only a local session, whose tasks run in this process's machine, may do without that setting.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared_folder(spark, shared)}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{own_folder().name}/{name}-{uuid.uuid4().hex}"


@contextmanager
def dropped(spark: SparkSession, path: str) -> Iterator[str]:
    """A scratch path that is deleted afterwards, also after an error."""
    try:
        yield path
    finally:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
