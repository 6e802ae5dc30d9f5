"""Folds by document id, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves no remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def learnable(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True for rows that may be learned from: those with an id that are not held out."""
    return F.col(id_col).isNotNull() & ~held_out(id_col, folds)


def bounded_sample(rows: DataFrame, label: str, key: str, per_label: int, max_labels: int = 100) -> DataFrame:
    """``per_label`` rows of each value of ``label``, or all where there are no more.

    Rows come in the order of a hash of ``key``; of rows with equal key and label one
    counts, with the least other columns, so that reruns agree.  Only the counts a label
    (one row each) go to the driver; ``rows`` itself is thinned by the hash where it is, to
    half as many again as are wanted and some, and those are put in order.  More labels
    than ``max_labels`` are a ``ValueError``: none is left out.
    """
    rows = rows.where(F.col(label).isNotNull())
    counts = rows.groupBy(label).agg(F.count_distinct(F.xxhash64(key)).alias("n")).orderBy(F.desc("n"), label).limit(max_labels + 1).collect()
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} values of {label}")
    if not counts:
        return rows.limit(0)
    rate = F.lit(0.0)
    for value, n in counts:
        rate = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, (1.5 * per_label + 50) / n))).otherwise(rate)
    lot = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1_000_003))
    others = [c for c in rows.columns if c not in (key, label)]
    thin = rows.where(lot / F.lit(1_000_003.0) < rate).groupBy(key, label).agg(F.min(F.struct(*others) if others else F.lit(0)).alias("__rest"))
    # one window a label, of some rows more than are wanted
    placed = thin.withColumn("__place", F.row_number().over(Window.partitionBy(label).orderBy(lot, key))).where(F.col("__place") <= per_label)
    return placed.select(*[F.col(f"__rest.{c}").alias(c) if c in others else F.col(c) for c in rows.columns])
