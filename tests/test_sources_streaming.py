"""Sources, sinks and streams."""

import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import readers
from tidemark.streaming import serving


def test_json_lines(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"text": "a", "rating": 4.0}\nnot json\n{"text": "b", "rating": 5}\n')
    assert readers.read_reviews(spark, str(p)).count() == 2
    good, bad = readers.read_json_rows(spark, str(p), T.StructType([T.StructField("text", T.StringType())]))
    assert good.count() == 2 and [r["value"] for r in bad.collect()] == ["not json"]


def test_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("Query\tLabel\nq1\tE\n")
    got = readers.read_table(spark, str(tmp_path / "t.tsv"), {"query": ["query_text", "query"], "locale": ["locale"]}).collect()
    assert [tuple(r) for r in got] == [("q1", None)]
    assert readers.delimiter("x.txt", "a,b,c") == "," and readers.delimiter("x.txt", "a") == "\t"
    df = spark.createDataFrame([(2, None), (1, "x")], "b int, a string")
    readers.write_json_lines(df, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":"x","b":1}', '{"a":null,"b":2}']
    readers.write_versioned(df, str(tmp_path), "v")
    readers.write_versioned(df.limit(1), str(tmp_path), "v")
    assert readers.read_latest(spark, str(tmp_path), "v").count() == 1


def test_upsert_and_unique(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, readers.upsert_points(a, b).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert readers.assert_unique(a, "id").count() == 2
    try:
        readers.assert_unique(b, "id").collect()
        raise AssertionError("repeated ids passed")
    except Exception as e:
        assert "duplicate id" in str(e)


def test_counters_of_a_stream(spark, tmp_path):
    spark.range(50).select(F.timestamp_seconds(F.col("id") * 300).alias("ts"), F.lit("get").alias("event_type"), (F.col("id") * 20.0).alias("value")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = serving.stream_counters(stream).writeStream.format("memory").queryName("counters").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("counters")
    assert got.agg(F.sum("requests")).first()[0] == 50


def cached(spark, path, batches, **kw):
    """The cache's answers to requests that come in these batches, and the state's rows left at the end."""
    for rows in batches:
        spark.createDataFrame(rows, "shard string, request_id long, s double, key string, vector array<double>").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema("shard string, request_id long, key string, vector array<double>, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    with serving.cache_settings(spark):
        got = serving.run_to_table(serving.semantic_cache(stream, **kw), f"{path}/out").collect()
    return sorted((r["request_id"], r["level"], r["matched"], None if r["similarity"] is None else round(r["similarity"], 9), r["evicted"]) for r in got)


def looped(rows, threshold=0.92, ttl_s=3600, capacity=1000):
    """The same by a plain loop over all requests."""
    shards, out = {}, []
    for shard, rid, t, key, vector in sorted(rows, key=lambda r: (r[2], r[1])):
        entries = shards.setdefault(shard, [])
        entries[:] = [e for e in entries if e["put"] >= t - ttl_s]
        hit = next((e for e in entries if e["key"] == key), None)
        level, similarity, evicted = "exact", None, False
        if hit is None:
            level = "miss"
            if vector is not None and any(vector):
                like = [(float(np.dot(e["v"], vector) / np.linalg.norm(e["v"]) / np.linalg.norm(vector)), e) for e in entries if e["v"] is not None and any(e["v"])]
                best = max((s for s, _ in like), default=-2)
                if best >= threshold:
                    level, similarity, hit = "semantic", round(best, 9), next(e for s, e in like if s == best)
        if hit is not None:
            hit["used"], hit["n"] = t, len(out)
        elif key is not None:
            if len(entries) >= capacity:
                entries.remove(min(entries, key=lambda e: (e["used"], e["n"])))
                evicted = True
            entries.append({"key": key, "v": vector, "put": t, "used": t, "n": len(out)})
        out.append((rid, level, hit["key"] if hit else None, similarity, evicted))
    return sorted(out)


def test_semantic_cache(spark, tmp_path):
    rows = [("s", 1, 0.0, "a", [1.0, 0.0]), ("s", 2, 10.0, "a", [1.0, 0.0]), ("s", 3, 20.0, "b", [0.99, 0.14]), ("s", 4, 30.0, "c", [0.0, 1.0]), ("s", 5, 9000.0, "a", [1.0, 0.0])]
    assert [r[:3] for r in cached(spark, str(tmp_path), [rows])] == [(1, "miss", None), (2, "exact", "a"), (3, "semantic", "a"), (4, "miss", None), (5, "miss", None)]


def test_semantic_cache_replays(spark, tmp_path):
    """However requests fall into batches, answers are those of a loop; expiry, capacity, nulls and ties included."""
    r = random.Random(2)
    rows, t = [], 0.0
    for i in range(240):
        t += r.choice([0, 1, 5, 40])
        v = r.choice([None, [0.0, 0.0], *[[round(r.gauss(0, 1), 2), round(r.gauss(0, 1), 2)] for _ in range(8)]])
        rows.append((f"s{r.randrange(2)}", i, t, r.choice([None, *"abcdefghijkl"]), v))
    want = looped(rows, 0.99, 300, 4)
    assert {x[1] for x in want} == {"exact", "semantic", "miss"} and any(x[4] for x in want)
    cuts = sorted({i for i in range(1, 240) if rows[i][2] > rows[i - 1][2]})
    for k, n in enumerate((1, 4)):
        edges = [0, *sorted(r.sample(cuts, n - 1)), 240]
        got = cached(spark, str(tmp_path / str(k)), [rows[a:b] for a, b in zip(edges, edges[1:])], threshold=0.99, ttl_s=300, capacity=4)
        assert got == want
