"""Approximate vector search by a stored index: inverted lists of product-quantised codes (K1).

Points are dealt to the nearest of some centroids, whose number grows with the corpus; what
is left of a vector after its centroid is cut into pieces, and each piece stands as one
byte, the nearest of up to 256 pieces learned for its place.  The index is a folder:
``points``, by list, and ``model``.  A search reads the codes of the lists that its queries
look into, a sixteenth or less of what their vectors take, and then the vectors of the best
by codes, which it scores exactly.  Every point is in the index; only the model is
fitted on a sample.  ``retrieval.vector_search`` is the exact search, by which recall is
measured.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.retrieval import Best, query_scans

#: Points that the model is fitted on at most, chosen by a hash of their ids.
SAMPLE = 20_000
#: Numbers of a vector that one byte stands for, and lists at most.
PIECE, MOST_LISTS = 4, 65_536


def _sample(corpus: DataFrame, point_id: str, vector: str, sample: int) -> tuple[np.ndarray, int]:
    known = corpus.select(F.col(point_id).alias("p"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    total = known.count()
    lot = F.pmod(F.xxhash64("p", F.lit("lists")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    some = known.where(lot < min(1.0, 1.2 * sample / max(total, 1))).orderBy(F.xxhash64("p"), "p").limit(sample).toPandas()
    return (np.stack(some["v"].to_numpy()).astype(float) if len(some) else np.zeros((0, 0))), total


def _means(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of k-means; as many as there are points if fewer."""
    centres = points[np.random.default_rng(seed).permutation(len(points))[: min(k, len(points))]].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points @ centres.T - (centres * centres).sum(1) / 2).argmax(1)


@dataclass
class Model:
    """Centroids of the lists, and for each piece of a vector the values that its byte stands for."""

    centroids: np.ndarray
    books: list[np.ndarray]

    def pieces(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [vectors[:, at : at + PIECE] for at in range(0, vectors.shape[1], PIECE)]

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and its bytes."""
        own = nearest(vectors, self.centroids)
        left = self.pieces(vectors - self.centroids[own])
        return own, np.column_stack([nearest(x, book) for x, book in zip(left, self.books, strict=True)]).astype(np.uint8)


def fit_model(corpus: DataFrame, point_id: str = "point_id", vector: str = "vector", lists: int | None = None, rounds: int = 10, sample: int = SAMPLE) -> Model:
    """Learned from ``sample`` points at most; ``lists`` is the square root of the corpus' size unless given."""
    points, total = _sample(corpus, point_id, vector, sample)
    if not len(points):
        return Model(np.zeros((0, 0)), [])
    centroids = _means(points, lists or max(4, min(MOST_LISTS, math.isqrt(total))), rounds, 7)
    left = points - centroids[nearest(points, centroids)]
    return Model(centroids, [_means(left[:, at : at + PIECE], 256, rounds, at) for at in range(0, points.shape[1], PIECE)])


def write_index(corpus: DataFrame, path: str, model: Model, point_id: str = "point_id", vector: str = "vector") -> None:
    """The index of every point with a vector; one shuffle by list, in which large lists take several files."""
    id_type = dict(corpus.dtypes)[point_id]
    points = corpus.select(F.col(point_id).alias("point_id"), F.col(vector).cast("array<double>").alias("vector")).where("vector is not null")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                own, codes = model.encode(np.stack(batch["vector"].to_numpy()).astype(float))
                yield pd.DataFrame({"point_id": batch["point_id"], "vector": batch["vector"], "code": [c.tobytes() for c in codes], "list": own.astype(np.int32)})

    rows = points.mapInPandas(encode, f"point_id {id_type}, vector array<double>, code binary, list int")
    rows.hint("rebalance", "list").sortWithinPartitions("list", "point_id").write.partitionBy("list").parquet(f"{path}/points")
    shapes = [("centroids", 0, model.centroids), *[("book", i, b) for i, b in enumerate(model.books)]]
    corpus.sparkSession.createDataFrame([(k, i, bytearray(x.tobytes()), x.shape[1] if x.ndim == 2 else 0) for k, i, x in shapes], "kind string, nth int, data binary, width int").coalesce(1).write.parquet(f"{path}/model")


def read_model(spark: SparkSession, path: str) -> Model:
    parts = {(r["kind"], r["nth"]): np.frombuffer(bytes(r["data"])).reshape(-1, max(r["width"], 1)) for r in spark.read.parquet(f"{path}/model").collect()}
    return Model(parts["centroids", 0], [parts["book", i] for i in range(len(parts) - 1)])


def search_index(queries: DataFrame, path: str, limit: int = 100, probes: int = 8, refine: int = 10, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
    """K1: ``query_id, point_id, score, rank``: the ``limit`` best of each query among the points of its ``probes`` nearest lists.

    Codes are scored first, by a table of the query's products with each place's values;
    the best ``limit * refine`` of each query are then scored by their vectors.  Lists
    that no query looks into are not read.  Scores are rounded to six digits, ties go to the smaller id.
    """
    spark = queries.sparkSession
    model, q_type = read_model(spark, path), dict(queries.dtypes)[query_id]
    if not len(model.centroids):
        return spark.createDataFrame([], f"{query_id} {q_type}, point_id long, score double, rank int")
    points = spark.read.parquet(f"{path}/points")
    id_type = dict(points.dtypes)["point_id"]
    out = spark.createDataFrame([], f"q {q_type}, point_id {id_type}, score double")
    for names, block in query_scans(queries, limit * refine, query_id, vector):
        # the nearest lists by product, as the search is by product
        near = np.argsort(-(block @ model.centroids.T), axis=1, kind="stable")[:, :probes]
        sent = spark.sparkContext.broadcast((names, block, near, model))

        def guess(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, block, near, model = sent.value
            tables = [x @ book.T for x, book in zip(model.pieces(block), model.books, strict=True)]
            best = Best(len(names), limit * refine)
            for batch in batches:
                ids, lists = batch["point_id"].to_numpy(), batch["list"].to_numpy()
                code = np.frombuffer(b"".join(batch["code"]), np.uint8).reshape(len(ids), -1)
                for k in np.unique(lists):
                    own, asks = np.flatnonzero(lists == k), np.flatnonzero((near == k).any(axis=1))
                    base = block[asks] @ model.centroids[k]
                    for i, b in zip(asks, base, strict=True):
                        scores = b + sum(t[i][code[own, j]] for j, t in enumerate(tables))
                        passing = scores >= best.least[i]
                        if passing.any():
                            best.add(i, ids[own[passing]], scores[passing])
            yield best.frame(names)

        some = [int(k) for k in np.unique(near)]
        found = points.where(F.col("list").isin(some)).select("point_id", "list", "code").mapInPandas(guess, f"q {q_type}, p {id_type}, score double")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "p"))
        chosen = found.withColumn("r", place).where(F.col("r") <= limit * refine).select("q", "p")
        asked = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in zip(names, block, strict=True)], f"q {q_type}, v array<double>")
        # both are of the scan's checked size
        whole = points.where(F.col("list").isin(some)).select("point_id", "vector").join(F.broadcast(chosen), F.col("point_id") == F.col("p")).join(F.broadcast(asked), "q")
        score = F.round(F.aggregate(F.zip_with("vector", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 6)
        out = out.unionByName(whole.select("q", "point_id", score.alias("score")))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "point_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= limit).select(F.col("q").alias(query_id), "point_id", (F.col("score") + 0.0).alias("score"), "rank")


def files_read(queries: DataFrame, path: str, probes: int, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
    """K1: a row a query: lists and rows that a search by it alone reads, and all there are."""
    spark = queries.sparkSession
    centroids = read_model(spark, path).centroids
    sizes = spark.read.parquet(f"{path}/points").groupBy("list").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("rows"), F.count("*").alias("lists"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                block = np.stack(batch["v"].to_numpy()).astype(float)
                yield pd.DataFrame({"q": batch["q"], "lists": np.argsort(-(block @ centroids.T), axis=1, kind="stable")[:, :probes].tolist()})

    q = queries.select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    asked = q.mapInPandas(near, f"q {dict(queries.dtypes)[query_id]}, lists array<int>").select("q", F.explode("lists").alias("list"))
    sums = asked.join(sizes, "list").groupBy("q").agg(F.count("*").alias("lists_read"), F.sum("n").alias("rows_read"))
    return sums.join(F.broadcast(total)).select(F.col("q").alias(query_id), "lists_read", F.col("lists").alias("lists_total"), "rows_read", F.col("rows").alias("rows_total"))


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", point_id: str = "point_id") -> DataFrame:
    """One row: the share of exact results that were found, over all queries."""
    hits = exact.select(query_id, point_id).join(found.select(query_id, point_id, F.lit(1).alias("hit")), [query_id, point_id], "left")
    return hits.agg(F.count("*").alias("wanted"), F.count("hit").alias("found"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))
