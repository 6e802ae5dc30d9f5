"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or one of our own.

    The cluster names the folder in the session's settings.  Only where that is
    unset, as in tests on one machine, a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class _Open(threading.local):
    """Paths made in each open ``scratch`` of this thread."""

    def __init__(self):
        self.paths: list[list[str]] = []


_OPEN = _Open()


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path in the shared folder that nothing else uses; it goes with the innermost ``scratch``, with ``keep`` with the one around that, if any."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_OPEN.paths) > keep:
        _OPEN.paths[-1 - keep].append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def ends_with_session(spark: SparkSession, path: str) -> None:
    """Has what is at ``path`` deleted when the session's process ends, if it is still there."""
    where, store = _file_system(spark, path)
    store.deleteOnExit(where)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables written within that were not to be kept.

    What is used after it must be written with ``keep`` or not depend on them.
    """
    _OPEN.paths.append([])
    try:
        yield
    finally:
        for path in _OPEN.paths.pop():
            where, store = _file_system(spark, path)
            store.delete(where, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: later stages reread the files when an executor is lost.  Outside a
    ``scratch`` the table goes with the session.
    """
    path = new_path(df.sparkSession, name, keep)
    df.write.parquet(path)
    ends_with_session(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front where ``columns`` has them already (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Keys up to which a set of them is broadcast: some 20 MB on each executor.
BROADCAST_KEYS = 1_000_000


def by_keys(rows: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` join of wide rows with distinct, written keys.

    The keys are counted: while they are few they are broadcast and the rows stay where
    they are; beyond that both sides are shuffled.  The result is the same.
    """
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, how)
