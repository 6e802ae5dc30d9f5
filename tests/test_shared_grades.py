"""Grades that queries share, against a row for each query and product."""

import random

from tidemark.operators import calibration, evaluation
from tidemark.plans import fixtures


def test_shared_grades(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [0.0], None if i % 17 == 0 else rng.randrange(3)) for i in range(600)]
    # a query that is there twice under one label, one under two, and points without an id
    rows += [(50, [0.0], rows[50][2]), (100, [0.0], 2), (100, [0.0], 1), (None, [0.0], 1), (None, [0.0], 2)]
    rows += [(300, [0.0], 9)]  # its label has no other point
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    sf = str(tmp_path)
    long, shared = fixtures.judgments(spark, sf).cache(), fixtures.shared_grades(spark, sf)
    plain = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect())
    assert plain(shared.rows()) == plain(long.select("query_id", "product_id", "grade")) and long.count() > 800
    queries = fixtures.queries(spark, sf)
    assert plain(evaluation.dataset_statistics(shared, queries)) == plain(evaluation.dataset_statistics(long, queries))
    ranking = spark.createDataFrame([(q, p, r + 1) for q in (*range(0, 600, 50), 7) for r, p in enumerate([q // 4, *rng.sample(range(160), 12)])], "query_id long, product_id long, rank int")
    ranking = ranking.dropDuplicates(["query_id", "product_id"])
    for k in (3, 10):
        assert plain(evaluation.ranking_metrics(ranking, shared, k)) == plain(evaluation.ranking_metrics(ranking, long, k))
    assert plain(calibration.missed_items(shared, ranking)) == plain(calibration.missed_items(long, ranking))
    assert [r[:2] for r in plain(evaluation.hit_list(ranking.where("query_id <> 7"), shared).select("query_id", "first_rank").na.fill(0))] == [r[:2] for r in plain(evaluation.hit_list(ranking.where("query_id <> 7"), long).select("query_id", "first_rank").na.fill(0))]


def test_dataset_of_shared_grades(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [0.0], None if i % 17 == 0 else rng.randrange(4)) for i in range(600)]
    rows += [(50, [0.0], rows[50][2]), (100, [0.0], 2), (100, [0.0], 1), (None, [0.0], 1)]
    rows += [(200, [0.0], 9), (204, [0.0], 9)]  # one relevant product under that label
    rows += [(650, [0.0], 8)]  # a query that nothing is relevant to
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    sf = str(tmp_path)
    retrieved = spark.createDataFrame([(q, p, r + 1) for q in range(0, 700, 50) for r, p in enumerate(rng.sample(range(160), 12))], "query_id long, product_id long, rank int")
    attempted = spark.createDataFrame([(q, "timeout" if q == 400 else None) for q in range(0, 700, 50)], "query_id long, error string")
    short = calibration.dataset_rows(fixtures.shared_grades(spark, sf), retrieved, attempted)
    long = calibration.dataset_rows(fixtures.judgments(spark, sf), retrieved, attempted)
    for a, b in zip(short, long, strict=True):
        assert a.columns == b.columns and sorted(a.collect()) == sorted(b.collect())
    found = {r["query_id"]: (r["relevant_count"], r["relevant_grade_mass"]) for r in short[0].collect()}
    assert 400 not in found and found[650] == (0, 0.0) and found[200][0] > 1
