"""Places and running sums in a global order, without a task that sorts everything.

Rows are range-partitioned by the whole order and written once, so that the parts are
fixed; sums of parts meet in one place (a row a part), and rows are put in order within
their part only.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Sets a checkpoint folder where neither the session nor the context has one, which only one machine may do."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))


def _full_order(rows: DataFrame, order: list[Column | str]) -> list[Column]:
    """The order, with a digest of the row's other columns behind it, so that equal keys don't have to share a part and reruns agree."""
    named = {c for c in order if isinstance(c, str)}
    rest = [c for c, t in rows.dtypes if c not in named and "map<" not in t and t != "variant"]
    return [F.col(c) if isinstance(c, str) else c for c in order] + ([F.xxhash64(*rest)] if rest else [])


def placed(rows: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """``rows`` with their place in ``order``, from 1.  Nulls come where the order puts them; ties are in the order of a digest of the other columns."""
    return running(rows.withColumn("__one", F.lit(1)), order, "__one", name).withColumn(name, F.col(name) + 1).drop("__one")


def running(rows: DataFrame, order: list[Column | str], value: str, name: str = "before", by: list[str] | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before them in ``order``, within equal ``by`` if it is given (null is a value)."""
    ensure_checkpoint_dir(rows.sparkSession)
    by = by or []
    full = _full_order(rows, [*by, *order])
    parts = rows.repartitionByRange(*full).withColumn("__part", F.spark_partition_id()).checkpoint()
    sums = parts.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    # a row a part, or a part and group
    over = Window.partitionBy(*by).orderBy("__part") if by else Window.orderBy("__part")
    sums = sums.withColumn("__offset", F.coalesce(F.sum("__sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    sums = sums.select("__offset", F.col("__part").alias("__p"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)])
    on = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    within = Window.partitionBy("__part", *by).orderBy(*full).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, on)
    return out.withColumn(name, F.col("__within") + F.col("__offset")).select(*rows.columns, name)


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None, buckets: int = 4096) -> DataFrame:
    """A row for each ``by``: linearly interpolated exact percentiles of ``value``, a column for each of ``shares``.

    Equal values are counted first, map-side; counts are summed over ``buckets`` of the
    range of values and then within, so that no buffer holds the values of a group.
    Nulls are ignored.
    """
    by = by or []
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    counts = known.groupBy(*by, "__v").agg(F.count("*").alias("__n"))
    span = counts.groupBy(*by).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__n").alias("__total"))
    span = span.select("__lo", "__hi", "__total", *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)])
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    wide = counts.join(F.broadcast(span) if not by else span, on)
    wide = wide.withColumn("__b", F.coalesce(F.floor(F.try_divide((F.col("__v") - F.col("__lo")) * buckets, F.col("__hi") - F.col("__lo"))), F.lit(0)).cast("int"))
    keys = [f"__by{i}" for i in range(len(by))]
    of_bucket = wide.groupBy(*keys, "__b").agg(F.sum("__n").alias("__in"))
    over = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    of_bucket = of_bucket.withColumn("__offset", F.coalesce(F.sum("__in").over(over), F.lit(0)))  # a row a bucket
    # only buckets that hold a wanted place go on
    wanted = F.array(*[F.lit(float(s)) for s in shares.values()])
    there = of_bucket.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("__b").alias("__b_"), "__offset", "__in")
    on = F.col("__b") == F.col("__b_")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_"))
    near = wide.join(there, on).where(F.exists(wanted, lambda s: (F.floor(s * (F.col("__total") - 1)) < F.col("__offset") + F.col("__in")) & (F.ceil(s * (F.col("__total") - 1)) >= F.col("__offset"))))
    within = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("__from", F.col("__offset") + F.coalesce(F.sum("__n").over(within), F.lit(0))).withColumn("__to", F.col("__from") + F.col("__n"))

    def at(share: float) -> Column:
        pos = F.lit(float(share)) * (F.col("__total") - 1)
        low = F.max(F.when((F.floor(pos) >= F.col("__from")) & (F.floor(pos) < F.col("__to")), F.col("__v")))
        high = F.max(F.when((F.ceil(pos) >= F.col("__from")) & (F.ceil(pos) < F.col("__to")), F.col("__v")))
        part = F.max(pos - F.floor(pos))
        return low + (high - low) * part

    out = near.groupBy(*keys).agg(*[at(s).alias(n) for n, s in shares.items()])
    return out.select(*[F.col(f"__by{i}").alias(c) for i, c in enumerate(by)], *shares)
