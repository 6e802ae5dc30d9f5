"""Chunks by topic of texts whose neighbours are all equally alike, against the SQL."""

import math
import random

import duckdb
from pyspark.sql import functions as F

from tidemark.functions.vectors import fused
from tidemark.plans import registry


def test_equal_likeness(spark, tmp_path):
    rng = random.Random(5)
    # one sentence over and over: all likenesses of a text are one number
    texts = [" ".join([f"Ab{rng.randint(0, 10**9)} " + "word " * 80 + "end."] * rng.randint(3, 7)) for _ in range(400)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    got = sorted(map(tuple, registry.queries()["topic_chunks"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert got == sorted(con.execute(registry.oracle_sql()["topic_chunks"]).fetchall())


def test_fused(spark):
    rng = random.Random(6)
    rows = [tuple(rng.uniform(-2, 2) for _ in range(3)) for _ in range(2000)]
    for r in spark.createDataFrame(rows, "a double, b double, c double").withColumn("f", fused(F.col("a"), F.col("b"), F.col("c"))).collect():
        assert r["f"] == math.fma(r["a"], r["b"], r["c"])
