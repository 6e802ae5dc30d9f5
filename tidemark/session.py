"""Session settings shared by the tests, the benchmark and library users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[*]", app: str = "tidemark", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine is written for.

    Time zone UTC (dates are formatted in UTC), adaptive execution on (shuffle
    partitions coalesce, skewed joins split).  On a cluster pass the master and
    a shuffle partition count that suits the input; nothing else is needed.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
