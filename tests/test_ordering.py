"""Global places, running sums and percentiles against plain sorting."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import faithfulness, interactions, ordering, querybank, serving


def test_numbers_with_nulls_integers_and_descending_order(spark):
    rows = spark.createDataFrame([(10,), (2,), (100,), (9,), (None,), (2,)], "k int")
    up = {(r["k"], r["query_id"]) for r in querybank.numbered(rows, "q", [F.col("k").asc_nulls_last()]).collect()}
    assert up == {(2, "q_00001"), (2, "q_00002"), (9, "q_00003"), (10, "q_00004"), (100, "q_00005"), (None, "q_00006")}
    down = {r["k"]: r["query_id"] for r in querybank.numbered(rows.where("k <> 2"), "q", [F.col("k").desc()], digits=3).collect()}
    assert down == {100: "q_001", 10: "q_002", 9: "q_003"}


def test_places_like_sorting(spark):
    rng = np.random.default_rng(0)
    values = [(int(i), None if rng.random() < 0.1 else int(rng.integers(0, 30))) for i in range(500)]
    got = {r["i"]: r["place"] for r in ordering.placed(spark.createDataFrame(values, "i int, v int"), [F.col("v").asc_nulls_last(), "i"]).collect()}
    want = sorted(values, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert got == {i: k + 1 for k, (i, _) in enumerate(want)}


def test_running_sums_by_group(spark):
    rows = [("a" if i % 3 else None, i, i % 5) for i in range(200)]
    got = {r["i"]: r["before"] for r in ordering.running(spark.createDataFrame(rows, "g string, i int, v int"), ["i"], "v", by=["g"]).collect()}
    assert got == {i: sum(x[2] for x in rows if x[0] == g and x[1] < i) for g, i, _ in rows}


def test_percentiles_like_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in rng.choice(rng.normal(size=50), 333)] + [("one", 4.0), ("none", None), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r["g"]: r for r in ordering.percentiles(df, "v", shares, ["g"], buckets=16).collect()}
    for g in {"a", "b", None, "one", "same"}:
        own = [v for h, v in rows if h == g]
        assert all(abs(got[g][n] - np.percentile(own, 100 * s)) < 1e-9 for n, s in shares.items())
    every = ordering.percentiles(df, "v", shares).first()
    assert all(abs(every[n] - np.percentile([v for _, v in rows if v is not None], 100 * s)) < 1e-9 for n, s in shares.items())
    assert serving.latency_summary(df, ("g",), "v").where("g = 'none'").first()["p50"] is None


def test_splits_keep_rows_without_a_time(spark):
    rows = spark.createDataFrame([(i, None if i in (3, 7) else 1000 - i) for i in range(10)] + [(99, 10**12)], "i int, t long").select("i", F.timestamp_millis("t").alias("timestamp"))
    got = {r["i"]: r["split"] for r in interactions.temporal_split(rows).collect()}
    assert len(got) == 11 and got[3] == got[7] == "test" and got[9] == "train"
    assert sorted(got.values()).count("train") == 8 and sorted(got.values()).count("val") == 1


def test_terciles_and_correlations_with_nulls(spark):
    rows = spark.createDataFrame([(i, None if i < 2 else float(i), float(i % 4)) for i in range(9)], "i int, c double, s double")
    got = {r["tercile"]: (r["rows"], r["mean_score"]) for r in faithfulness.tercile_means(rows, "c", "s", "i").collect()}
    assert got == {"low": (3, 1.0), "mid": (3, 1.333333), "high": (3, 1.666667)}
    flat = {r["signal"]: r["correlation"] for r in faithfulness.confidence_correlations(rows.withColumn("k", F.lit(1)), "s", ("i", "k")).collect()}
    assert flat["k"] == 0.0 and abs(flat["i"]) <= 1


def test_cache_with_many_parts_and_nulls(spark):
    rng = np.random.default_rng(8)
    rows = [(i, None if i == 5 else f"k{rng.integers(20)}", int(rng.integers(0, 50000))) for i in range(600)]
    df = spark.createDataFrame(rows, "request_id long, key string, s long").select("request_id", "key", F.timestamp_seconds("s").alias("ts")).repartition(5)
    put, want = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = k is not None and k in put and t - put[k] <= 3600
        if not want[i]:
            put[k] = t
    assert {r["request_id"]: r["hit"] for r in serving.exact_cache(df).collect()} == want
