"""Connected components of an edge table, without collecting edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 50) -> DataFrame:
    """``id, component_id`` for every node of ``edges``; the component's smallest id.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each
    is one grouped minimum (combined map-side, so that a node with very many
    neighbours is no hot spot) and one join, and the number of rounds grows with
    the logarithm of the longest path.  Each round is written to the shared folder.
    Self-links, repeated links and nulls are ignored.  Empty in, empty out.
    """
    pairs = (
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"), F.isnull(left).alias("x"), F.isnull(right).alias("y"))
        .where("not x and not y and u <> v")
        .select("u", "v")
        .distinct()
    )
    now = materialize(pairs, "components")
    state = None
    for _ in range(max_rounds):
        fingerprint = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if fingerprint == state:
            break
        state = fingerprint
        # large star: every neighbour above u is linked with the least of u's neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its neighbours below are linked with the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = materialize(small.where("u <> v").distinct(), "components")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
