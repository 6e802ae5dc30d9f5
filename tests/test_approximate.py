"""Approximate search against the exact one, and the exact one against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import approximate, retrieval


def vectors(n, dims=32, groups=20):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(groups, dims))
    v = centres[rng.integers(0, groups, n)] + 0.6 * rng.normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_index_finds_most_in_a_fifth_of_the_points(spark, tmp_path):
    v = vectors(3000)
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "point_id long, vector array<double>")
    queries = corpus.where("point_id % 50 = 0").select(F.col("point_id").alias("query_id"), "vector")
    path = str(tmp_path / "index")
    approximate.write_index(corpus, path, approximate.fit_model(corpus, lists=40))
    assert spark.read.parquet(f"{path}/points").count() == 3000
    exact = retrieval.vector_search(queries, corpus, 10)
    found = approximate.search_index(queries, path, 10, probes=6)
    got = approximate.recall(found, exact).first()
    assert got["wanted"] == 600 and got["recall"] >= 0.9
    reads = approximate.files_read(queries, path, 6).collect()
    assert len(reads) == 60 and sum(r["rows_read"] for r in reads) <= 0.2 * sum(r["rows_total"] for r in reads)
    # a search by one query opens the files of its lists only
    one = queries.limit(1)
    plan = approximate.search_index(one, path, 10, probes=6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [list") >= 1
    every = approximate.search_index(queries, path, 10, probes=40, refine=300)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))


def test_registered_recall(spark):
    from tidemark.plans import registry

    got = registry.queries()["approximate_recall"](spark, "/root/testdata/sf0.01").first()
    assert got["recall"] >= 0.9 and got["share_read"] < 1


@pytest.mark.parametrize("groups", [3, 400])
def test_exact_search_against_all_products(spark, monkeypatch, groups):
    v = vectors(700, 16, groups)
    v[5] = v[9]  # a tie
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(-1, None)], "point_id long, vector array<double>").repartition(3)
    queries = corpus.where("point_id % 7 = 0").withColumnRenamed("point_id", "query_id")
    scores = np.round(v @ v.T, 6)
    want = sorted((q, int(p), float(scores[q, p] + 0.0), r + 1) for q in range(0, 700, 7) for r, p in enumerate(np.lexsort((np.arange(700), -scores[q]))[:5]))
    assert sorted(map(tuple, retrieval.vector_search(queries, corpus, 5).collect())) == want
    monkeypatch.setattr(retrieval, "SCAN_BYTES", 4_000)  # several scans
    monkeypatch.setattr(retrieval, "CORPUS_BATCH", 64)
    assert sorted(map(tuple, retrieval.vector_search(queries, corpus, 5).collect())) == want
    apart = sorted(map(tuple, retrieval.vector_search(queries, corpus, 5, exclude_self=True).select("query_id", "point_id").collect()))
    assert apart == sorted((q, int(p)) for q in range(0, 700, 7) for p in [x for x in np.lexsort((np.arange(700), -scores[q])) if x != q][:5])


def test_bounds_rule_parts_out():
    """Of points that lie close together few are scored, and none that counts is left out."""
    v = vectors(4096, 32, 16)
    v = v[np.argsort(approximate.nearest(v, approximate._means(v, 16, 8, 1)))]
    near = 0.02 * np.random.default_rng(1).normal(size=v.shape) + v[np.arange(len(v)) // 256 * 256]
    block = near[::512]
    best, done = retrieval.Best(len(block), 10), 0
    for at in range(0, len(near), 256):
        done += retrieval.meet(best, block, np.sqrt((block * block).sum(1)), np.arange(at, at + 256), near[at : at + 256])
    assert done < 0.7 * block.shape[0] * near.shape[0]
    scores = np.round(block @ near.T, 6)
    for i in range(len(block)):
        assert best.ids[i].tolist() == np.lexsort((np.arange(len(near)), -scores[i]))[:10].tolist()


def test_nothing_to_search(spark, tmp_path):
    empty = spark.createDataFrame([], "point_id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    model = approximate.fit_model(empty)
    assert len(model.centroids) == 0
    approximate.write_index(empty, str(tmp_path / "index"), model)
    assert approximate.search_index(queries, str(tmp_path / "index"), 3).count() == 0
    assert retrieval.vector_search(queries, empty, 3).count() == 0
