"""Exact vector search, product scores, re-ranking and recommendation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors and of their best points that a task holds; more queries take further scans of the corpus.
SCAN_BYTES = 64 << 20
#: Points that are scored at a time, and groups that they are parted into.
CORPUS_BATCH, GROUPS = 4096, 16


class Best:
    """The best ``limit`` points of each query so far, by falling score and rising id; one for all that a task reads."""

    def __init__(self, n: int, limit: int):
        self.limit = limit
        self.scores: list[np.ndarray] = [np.empty(0)] * n
        self.ids: list[np.ndarray | None] = [None] * n
        self.least = np.full(n, -np.inf)  # what a point must reach to be among them

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if self.ids[query] is not None:
            ids, scores = np.concatenate([self.ids[query], ids]), np.concatenate([self.scores[query], scores])
        keep = np.lexsort((ids, -scores))[: self.limit]
        self.ids[query], self.scores[query] = ids[keep], scores[keep]
        if len(keep) == self.limit:
            self.least[query] = scores[keep[-1]]

    def frame(self, names: list) -> pd.DataFrame:
        found = [i for i, ids in enumerate(self.ids) if ids is not None]
        if not found:
            return pd.DataFrame({"q": [], "p": [], "score": []})
        times = [len(self.ids[i]) for i in found]
        return pd.DataFrame({"q": np.repeat(np.array([names[i] for i in found]), times), "p": np.concatenate([self.ids[i] for i in found]), "score": np.concatenate([self.scores[i] for i in found])})


def meet(best: Best, block: np.ndarray, lengths: np.ndarray, ids: np.ndarray, points: np.ndarray) -> int:
    """Points of a batch met by the queries of ``block``; the number of scores that were worked out.

    The batch is parted about some of its points.  With c such a point and r the largest
    distance from it in its part, no point of the part scores over q c + |q| r, so that
    the part is met only by queries whose least best is not above that.
    """
    pivots = points[np.linspace(0, len(points) - 1, min(GROUPS, len(points))).astype(int)]
    own = (points @ pivots.T - (pivots * pivots).sum(1) / 2).argmax(1)  # the nearest
    done = 0
    for g in np.unique(own):
        part = np.flatnonzero(own == g)
        away = points[part] - pivots[g]
        radius = float(np.sqrt((away * away).sum(1).max()))
        asks = np.flatnonzero(block @ pivots[g] + lengths * radius + 1e-6 >= best.least)
        if not len(asks):
            continue
        scores = np.round(block[asks] @ points[part].T, 6)
        done += scores.size
        passing = scores >= best.least[asks, None]
        for i in np.flatnonzero(passing.any(1)):
            k = passing[i]
            best.add(asks[i], ids[part[k]], scores[i, k])
    return done


def query_scans(queries: DataFrame, limit: int, query_id: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and vectors of the queries, as many at a time as fit into ``SCAN_BYTES`` with their best points: what goes to the driver is of a checked size."""
    q = queries.select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    size = q.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("cells")).first()
    scans = -(-(8 * size["cells"] + 16 * limit * size["n"]) // SCAN_BYTES)
    for scan in range(scans):
        some = q.where(F.pmod(F.xxhash64("q"), F.lit(scans)) == scan).toPandas()
        if len(some):
            yield some["q"].tolist(), np.stack(some["v"].to_numpy()).astype(float)


def vector_search(queries: DataFrame, corpus: DataFrame, limit: int = 100, query_id: str = "query_id", point_id: str = "point_id", vector: str = "vector", exclude_self: bool = False) -> DataFrame:
    """``query_id, point_id, score, rank``: the ``limit`` nearest points of each query by dot product.

    Exact.  Queries are broadcast, as many as ``SCAN_BYTES`` hold for each scan of the corpus.
    A task keeps the best points of every query over all that it reads (``Best``) and hands
    on only those, so that tasks times queries times ``limit`` rows are shuffled, however
    large the corpus; parts of it that a bound rules out are not scored (``meet``).  Scores
    are rounded to six digits, ties go to the smaller id.  Null vectors are not met.
    Filters on the corpus belong before this call, where they reach the scan (F4).
    """
    id_type, q_type = dict(corpus.dtypes)[point_id], dict(queries.dtypes)[query_id]
    points = corpus.select(F.col(point_id).alias("p"), F.col(vector).cast("array<double>").alias("pv")).where(F.col("pv").isNotNull())
    spark, schema = corpus.sparkSession, f"q {q_type}, p {id_type}, score double"
    near = spark.createDataFrame([], schema)
    for names, block in query_scans(queries, limit, query_id, vector):
        sent = spark.sparkContext.broadcast((names, block))

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, block = sent.value
            best, lengths = Best(len(names), limit + exclude_self), np.sqrt((block * block).sum(1))
            for batch in batches:
                for at in range(0, len(batch), CORPUS_BATCH):
                    part = batch.iloc[at : at + CORPUS_BATCH]
                    meet(best, block, lengths, part["p"].to_numpy(), np.stack(part["pv"].to_numpy()))
            yield best.frame(names)

        near = near.unionByName(points.mapInPandas(search, schema))
    if exclude_self:
        near = near.where("q <> p")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "p"))
    return near.withColumn("rank", rank).where(F.col("rank") <= limit).select(F.col("q").alias(query_id), F.col("p").alias(point_id), F.col("score") + 0.0, "rank").toDF(query_id, point_id, "score", "rank")


def product_scores(chunks: DataFrame, method: str = "max") -> DataFrame:
    """A1: ``query_id, product_id, score, chunk_count, avg_rating`` from chunks with ``score`` and ``rating``.

    ``weighted_mean`` weighs by rating, and is the mean if ratings sum to nothing.
    """
    weighted = F.coalesce(F.when(F.sum("rating") > 0, F.sum(F.col("score") * F.col("rating")) / F.sum("rating")), F.avg("score"))
    score = {"max": F.max("score"), "mean": F.avg("score"), "weighted_mean": weighted}[method]
    return chunks.groupBy("query_id", "product_id").agg(F.round(score, 6).alias("score"), F.count("*").alias("chunk_count"), F.avg("rating").alias("avg_rating"))


def with_evidence(chunks: DataFrame, products: DataFrame, limit: int = 5) -> DataFrame:
    """Products with their ``limit`` best chunks as ``evidence``, best first."""
    best = F.row_number().over(Window.partitionBy("query_id", "product_id").orderBy(F.desc("score"), "chunk_id"))
    top = chunks.withColumn("__r", best).where(F.col("__r") <= limit)
    evidence = top.groupBy("query_id", "product_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "chunk_id", "score", "rating"))).alias("evidence"))
    return products.join(evidence, ["query_id", "product_id"], "left")


def weighted_ranking(products: DataFrame, similarity_weight: float = 0.8, rating_weight: float = 0.2) -> DataFrame:
    """Scores blended with ratings, similarity min-max scaled over each query's candidates; (1, 0) changes nothing."""
    if similarity_weight == 1.0 and rating_weight == 0.0:
        return products
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high - low > 1e-8, (F.col("score") - low) / (high - low)).otherwise(1.0)
    return products.withColumn("score", F.round(F.lit(similarity_weight) * scaled + F.lit(rating_weight) * (F.col("avg_rating") / 5.0), 6))


def weight_rankings(products: DataFrame, pairs: tuple[tuple[float, float], ...], k: int) -> DataFrame:
    """The first k of each query under each pair of weights, with ``config`` as ``similarity/rating``; products are read once."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high - low > 1e-8, (F.col("score") - low) / (high - low)).otherwise(1.0)
    blended = lambda a, b: F.col("score") if (a, b) == (1.0, 0.0) else F.round(F.lit(a) * F.col("__scaled") + F.lit(b) * (F.col("avg_rating") / 5.0), 6)
    configs = F.array(*[F.struct(F.lit(f"{a}/{b}").alias("config"), blended(a, b).alias("score")) for a, b in pairs])
    rows = products.withColumn("__scaled", scaled).withColumn("__c", F.explode(configs)).withColumns({"config": F.col("__c.config"), "score": F.col("__c.score")}).drop("__c", "__scaled")
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "config").orderBy(F.desc("score"), "product_id")))
    return out.where(F.col("rank") <= k)


def ranked(products: DataFrame, k: int | None = None) -> DataFrame:
    """``rank`` 1..k by score, ties by product id."""
    out = products.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "product_id")))
    return out if k is None else out.where(F.col("rank") <= k)


def recommend(chunks: DataFrame, k: int = 10, method: str = "max", similarity_weight: float = 0.8, rating_weight: float = 0.2) -> DataFrame:
    """K6: products of the retrieved chunks, scored, re-ranked and cut at k."""
    return ranked(weighted_ranking(product_scores(chunks, method), similarity_weight, rating_weight), k)


def candidate_limit(k: int) -> int:
    """K5: chunks to fetch for k products."""
    return max(3 * k, 100)


def exclude_products(ranking: DataFrame, excluded: DataFrame) -> DataFrame:
    """drop (query_id, product_id) pairs after the limit was applied; may leave fewer than k."""
    return ranking.join(excluded, ["query_id", "product_id"], "left_anti")


def evidence_gate(products: DataFrame, min_chunks: int = 1, min_tokens: int = 20, min_score: float = 0.7) -> DataFrame:
    """``is_sufficient`` and the first reason against it; needs ``chunk_count, total_tokens, top_score``."""
    reason = (
        F.when(F.col("chunk_count") < min_chunks, "insufficient_chunks")
        .when(F.col("total_tokens") < min_tokens, "insufficient_tokens")
        .when(F.col("top_score") < min_score, "low_relevance")
    )
    return products.withColumn("refusal_type", reason).withColumn("is_sufficient", F.col("refusal_type").isNull())


def warmup_level(interactions: Column) -> Column:
    """cold without history, warming under five, else warm."""
    return F.when(F.coalesce(interactions, F.lit(0)) == 0, "cold").when(interactions < 5, "warming").otherwise("warm")


def user_history(interactions: DataFrame, order: list[str], user: str = "user_id", rating: str = "rating", keep: int = 5) -> DataFrame:
    """each user's level and the first ``keep`` of their positive rows, or of all if none is positive."""
    w = Window.partitionBy(user)
    rows = interactions.withColumns({"__any": F.max((F.col(rating) >= 4).cast("int")).over(w), "__n": F.count("*").over(w)})
    rows = rows.where((F.col(rating) >= 4) | (F.col("__any") == 0))
    rows = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= keep)
    return rows.withColumn("level", warmup_level(F.col("__n"))).drop("__any", "__n")


def pooled_vectors(points: DataFrame, group: str = "product_id", vector: str = "vector", how: str = "mean") -> DataFrame:
    """Mean or maximum of a group's vectors, to length 1; one row a group."""
    from tidemark.functions.vectors import l2_normalize

    cells = points.select(group, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    pooled = cells.groupBy(group, "pos").agg((F.avg("x") if how == "mean" else F.max("x")).alias("x"))
    rows = pooled.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))
    return rows.withColumn("vector", l2_normalize(F.col("vector")))
