"""Letters beyond the first 65,536 codes, long runs, identity of texts, and columns of the caller's that have the operators' names."""

import os

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontam, mixing, storage
from tidemark.llm.storage import by_keys, materialize, spare


def test_letters_of_all_planes(spark):
    words = [chr(0x20000 + i) + chr(0x20100 + i) for i in range(24)]
    maths = ["".join(chr(0x1D41A + (i * 7 + k) % 26) for k in range(5)) for i in range(24)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(maths)), (3, "\U000f0000 " * 20)], "item_id long, text string")
    docs = spark.createDataFrame([(10, "Before. " + " ".join(words) + " after"), (11, " ".join(maths)), (12, " ".join(reversed(words))), (13, "\U000f0000 " * 30)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()) == [(10, 1), (11, 2)]
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(docs, items).collect()) == [12, 13]
    reader = decontam.Canonical()
    assert len(reader.tokens(" ".join(words))[0]) == 24
    assert reader.tokens("\U00010400bc")[0].tolist() == reader.tokens("\U00010428bc")[0].tolist()  # Deseret capital and small


def test_ends_of_long_runs_count():
    reader = decontam.Canonical()
    for n in (10, 4095, 4096, 5000, 70_000):
        assert reader.tokens("a" * n + "bc")[0].tolist() != reader.tokens("a" * n + "cb")[0].tolist()
    once = decontam.Canonical().tokens("xy")[0].tolist()
    reader.tokens("b" * 90_000)
    assert reader.tokens("xy")[0].tolist() == once


def test_filter_in_segments(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(decontam, "SEGMENT_BITS", 1 << 16)
    h = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 3000)
    bits = decontam._filter(spark.createDataFrame([(int(x),) for x in h], "window long"))
    assert decontam._may_hold(bits, h.astype(np.uint64)).all()
    others = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 20_000).astype(np.uint64)
    assert decontam._may_hold(bits, others).mean() < 0.01


def test_keys_few_and_many(spark, monkeypatch):
    rows, keys = spark.range(100).withColumnRenamed("id", "k"), spark.range(0, 100, 3).withColumnRenamed("id", "k")
    want = {how: sorted(r[0] for r in by_keys(rows, keys, "k", how).collect()) for how in ("left_semi", "left_anti")}
    monkeypatch.setattr(storage, "BROADCAST_KEYS", 3)
    assert want == {how: sorted(r[0] for r in by_keys(rows, keys, "k", how).collect()) for how in want}
    assert len(want["left_semi"]) == 34 and len(want["left_anti"]) == 66


def test_columns_of_the_caller_stay(spark, tmp_path):
    rows = [(i, f"The day was fine and the road was long {i} " * 20 if i % 2 else f"Der Tag war gut und die Strasse war lang {i} " * 20, "en" if i % 2 else "de", "s", 7.0, "mine", "a", "b", "c", 5) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, lang_pred string, __lang string, __key string, __source string, __hash int")
    spark.createDataFrame([(i, i % 3 > 0) for i in range(120)], "doc_id long, quality boolean").select("doc_id", F.col("quality").cast("int").alias("quality")).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of the kind stands anywhere in these few documents at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        for r in got.collect():
            assert tuple(r)[4:] == rows[r["doc_id"]][4:], name
    mix = mixing.plan_mix(docs)
    assert mix.columns[: len(docs.columns)] == docs.columns and {(r["__source"], r["__hash"]) for r in mix.collect()} == {("c", 5)}
    assert spare(["Score", "_score"], "score", "x") == ["__score", "x"]


def test_run_leaves_its_result_only(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"The day was fine and the road was long {i % 7} " * 20, "en", "s") for i in range(40)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of the kind stands anywhere in these few documents at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    made, new_path = [], storage.new_path
    monkeypatch.setattr(storage, "new_path", lambda *a, **k: made.append(new_path(*a, **k)) or made[-1])
    result = corpus_pipeline.run(spark, str(tmp_path))
    left = [p for p in made if os.path.exists(p.removeprefix("file:"))]
    assert len(made) > 10 and len(left) == 1 and result.count() > 0
    one = materialize(spark.range(3), "one")
    assert one.count() == 3
