"""Collections: versions, snapshots, writers at a time, records; lines numbered over splits."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import readers
from tidemark.sources.collection import Collection, get_record, put_record


def points(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, label string, vector array<double>")


def held(c, version=None):
    return sorted((r["id"], r["label"]) for r in c.read(version).collect())


def test_versions_and_snapshots(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    assert not c.exists() and c.version() == 0
    with pytest.raises(FileNotFoundError):
        c.upsert(points(spark, (1, "a", [1.0])))
    assert c.create(points(spark, (1, "a", [1.0]), (2, "b", None), (2, "b", None))) == 1
    before = c.read()
    assert c.upsert(points(spark, (2, "c", [2.0]), (3, "d", [3.0]))) == 2
    assert c.delete(spark.createDataFrame([(1,), (9,), (None,)], "id long")) == 3
    assert sorted(r["id"] for r in before.collect()) == [1, 2]  # a reader keeps what it began with
    assert held(c) == [(2, "c"), (3, "d")] and held(c, 1) == [(1, "a"), (2, "b")] and held(c, 2) == [(1, "a"), (2, "c"), (3, "d")]
    assert c.compact() == 4 and len(c.parts()[0]) == 1 and held(c) == [(2, "c"), (3, "d")]
    c.upsert(points(spark, (1, "again", [0.0])))
    assert held(c) == [(1, "again"), (2, "c"), (3, "d")] and held(c, 3) == [(2, "c"), (3, "d")]
    assert c.info().first().asDict() == {"name": "c", "points_count": 3, "version": 5, "folders": 2, "status": "yellow"} and c.exists()
    assert [r["label"] for r in c.read(columns=["label"], where=F.col("id") == 2).collect()] == ["c"]
    c.create(points(spark, (7, "new", None)))
    assert held(c) == [(7, "new")]
    with pytest.raises(Exception, match="without id"):
        c.upsert(points(spark, (None, "x", None)))
    c.delete(spark.createDataFrame([(7,)], "id long"))
    assert held(c) == [] and not c.exists()


def test_two_writers_at_a_time(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    c.create(points(spark, (0, "old", None)))
    made, gate = {}, threading.Barrier(4)

    def write(n):
        gate.wait()
        made[n] = Collection(spark, c.path).upsert(points(spark, (n, f"w{n}", None), (0, f"w{n}", None)))

    threads = [threading.Thread(target=write, args=(n,)) for n in range(1, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(made.values()) == [2, 3, 4, 5]
    last = max(made, key=made.get)
    assert held(c) == [(0, f"w{last}"), *[(n, f"w{n}") for n in range(1, 5)]]


def test_a_compaction_keeps_what_comes_meanwhile(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    c.create(points(spark, (1, "a", None)))
    write = c._write
    c._write = lambda rows: (folder := write(rows), Collection(spark, c.path).upsert(points(spark, (1, "b", None))))[0]
    assert c.compact() == 3
    assert held(c) == [(1, "b")] and len(c.parts()[0]) == 2


def test_records(spark, tmp_path):
    records = Collection(spark, str(tmp_path / "r"), "key")
    assert get_record(records, "a", "n long").count() == 0
    put_record(records, "a", spark.createDataFrame([(1, None)], "n long, note string"), 5)
    put_record(records, "b", spark.createDataFrame([(3,)], "n long"), 6)
    put_record(records, "a", spark.createDataFrame([(2, "x")], "n long, note string"), 7)
    assert [tuple(r) for r in get_record(records, "a", "n long, note string").collect()] == [(2, "x", 7)]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f'{{"n": {i}}}' if i % 7 else ("" if i % 2 else "{broken") for i in range(1, 2001)]
    for name in ("a.jsonl", "b.jsonl"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    schema = T.StructType([T.StructField("n", T.LongType())])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        good, bad = readers.numbered_json_rows(spark, str(tmp_path), schema)
        rows = good.collect()
        assert all(r["line"] == r["n"] for r in rows) and len(rows) == 2 * sum(x.startswith('{"n"') for x in lines)
        assert sorted((r["file"][-7:], r["line"]) for r in bad.collect()) == [(f, i) for f in ("a.jsonl", "b.jsonl") for i in range(1, 2001) if lines[i - 1] == "{broken"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_of_a_stream(spark, tmp_path):
    schema = T.StructType([T.StructField("n", T.LongType())])
    source = tmp_path / "in"
    source.mkdir()
    run = lambda: readers.stream_json_rows(spark, str(source), schema, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "progress"), 1)
    for k in range(2):
        (source / f"{k}.jsonl").write_text(f'{{"n": {k + 1}1}}\n\nno\n{{"n": {k + 1}4}}\n')
        run()
    assert sorted((r["n"], r["line"]) for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [(11, 1), (14, 4), (21, 1), (24, 4)]
    assert sorted((r["file"][-7:], r["line"], r["value"]) for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [("0.jsonl", 3, "no"), ("1.jsonl", 3, "no")]
