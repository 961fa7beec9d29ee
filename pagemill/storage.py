"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Rows and bytes of text given to a Python worker at once.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20


def filesystem(spark: SparkSession, path: str):
    """(file system of a path, constructor of its paths)."""
    sc = spark.sparkContext
    maker = sc._jvm.org.apache.hadoop.fs.Path
    return maker(path).getFileSystem(sc._jsc.hadoopConfiguration()), maker


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir, removed when the driver's process ends.

    Where that is unset, and the session is one process, a temporary folder takes its place.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/pagemill-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def small_batches(spark: SparkSession) -> None:
    """Small Arrow batches in rows and bytes from now on, because one row can hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written in it leaves no shuffle files behind; else they stay until the driver's garbage is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        fs, maker = filesystem(spark, path)
        fs.delete(maker(path), True)
