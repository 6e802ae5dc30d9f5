"""Merkle trees over sets of ids: fingerprints that also tell which ids differ.

An id's place in the tree is the first hexadecimal digits of its digest; a leaf holds the
digests with one prefix, in order, and a node its sixteen children at most.  No task sees
more than a leaf; two sets are compared from the root down, and only leaves that differ are
read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import ensure_checkpoint_dir

#: Levels below the root: 65,536 leaves.
DEPTH = 4


def digests(rows: DataFrame, value: str) -> DataFrame:
    """``id, h``: the trimmed, distinct ids that are not empty, and their digests."""
    return rows.select(F.trim(F.col(value).cast("string")).alias("id")).where("id <> ''").distinct().select("id", F.md5(F.col("id").cast("binary")).alias("h"))


def _in_order(parts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), ""), 256)


def merkle_tree(rows: DataFrame, value: str, depth: int = DEPTH) -> DataFrame:
    """``level, prefix, n, digest`` of every node; the root has level 0 and an empty prefix.  Without ids there is no node."""
    ensure_checkpoint_dir(rows.sparkSession)
    level = digests(rows, value).groupBy(F.substring("h", 1, depth).alias("prefix")).agg(F.count("*").alias("n"), _in_order(F.col("h")).alias("digest")).checkpoint()
    tree = level.select(F.lit(depth).alias("level"), "prefix", "n", "digest")
    for k in range(depth - 1, -1, -1):
        # a prefix is as long as any other of its level, so that pairs sort as prefixes do
        level = level.groupBy(F.substring("prefix", 1, k).alias("prefix")).agg(F.sum("n").alias("n"), _in_order(F.concat("prefix", "digest")).alias("digest"))
        tree = tree.unionByName(level.select(F.lit(k).alias("level"), "prefix", "n", "digest"))
    return tree


def root(tree: DataFrame) -> DataFrame:
    """One row: the number of ids and the fingerprint, 0 and the digest of nothing for none."""
    top = tree.where("level = 0")
    return top.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("digest"), F.sha2(F.lit("").cast("binary"), 256)).alias("fingerprint"))


def differing_leaves(left: DataFrame, right: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``prefix`` of the leaves that differ or are on one side only; below nodes that agree nothing is compared."""
    open_ = None
    for k in range(depth + 1):
        sides = [t.where(F.col("level") == k).select("prefix", F.col("digest").alias(n)) for t, n in ((left, "l"), (right, "r"))]
        if open_ is not None:
            up = open_.withColumnRenamed("prefix", "above")
            sides = [s.join(F.broadcast(up), F.substring("prefix", 1, k - 1) == F.col("above"), "left_semi") for s in sides]  # a level's nodes: 4,096 at most
        open_ = sides[0].join(sides[1], "prefix", "full").where(~F.col("l").eqNullSafe(F.col("r"))).select("prefix").checkpoint()
    return open_


def differing_ids(left: DataFrame, right: DataFrame, value: str, trees: tuple[DataFrame, DataFrame] | None = None, depth: int = DEPTH) -> DataFrame:
    """``id, side`` (``local_only`` or ``remote_only``) of ids that only one set holds; ``trees`` if they are known already."""
    a, b = trees or (merkle_tree(left, value, depth), merkle_tree(right, value, depth))
    leaves = differing_leaves(a, b, depth)
    some = [digests(x, value).join(F.broadcast(leaves), F.substring("h", 1, depth) == F.col("prefix"), "left_semi").select("id", F.lit(1).alias(n)) for x, n in ((left, "l"), (right, "r"))]
    both = some[0].join(some[1], "id", "full").where("l is null or r is null")
    return both.select("id", F.when(F.col("r").isNull(), "local_only").otherwise("remote_only").alias("side"))
