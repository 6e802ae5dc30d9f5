"""Paths in the folder that driver and executors share, and what is read of files on the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from tidemark.operators.ordering import ensure_checkpoint_dir


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else the context's checkpoint folder, which only a local session makes up."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A folder in the shared folder that nothing else uses; it goes with the session."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where, store = file_system(spark, path)
    store.mkdirs(where)
    store.deleteOnExit(where)
    return f"{path}/table"


def file_system(spark: SparkSession, path: str):
    """A path and the store that it is in, as Spark reaches them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark's file systems reach."""
    where, store = file_system(spark, path)
    return bool(store.exists(where))


def head(spark: SparkSession, path: str, size: int = 4096) -> str:
    """The first bytes of a file, or of the first file of a folder, as text."""
    where, store = file_system(spark, path)
    if store.getFileStatus(where).isDirectory():
        files = [s.getPath() for s in store.listStatus(where) if s.getLen() and not s.getPath().getName().startswith(("_", "."))]
        if not files:
            return ""
        where = min(files, key=lambda f: f.getName())
    stream = store.open(where)
    try:
        some = spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(some)).decode("utf-8", "replace")
    finally:
        stream.close()
