"""Repeated rows, clashing columns, empty tables and media in parts."""

import gzip

from pyspark.sql import functions as F

from tidemark.llm import gif, mixing, quality, sampling, tokens, warc


def test_bounded_sample_agrees_and_dedups(spark):
    rows = spark.createDataFrame([(i % 400, "ab"[i % 3 == 0], f"t{i % 7}") for i in range(4000)], "id long, label string, text string")
    one = sorted(map(tuple, sampling.bounded_sample(rows, "label", "id", 50).collect()))
    two = sorted(map(tuple, sampling.bounded_sample(rows.repartition(7), "label", "id", 50).collect()))
    assert one == two and len(one) == 100 and len({r[:2] for r in one}) == 100
    assert sampling.bounded_sample(rows.limit(0), "label", "id", 50).count() == 0


def test_quality_with_repeated_ids(spark):
    rows = [(i, "good plain words of prose here " * 9 if i % 2 else "zz$$ %% qq## " * 20) for i in range(60)] * 2 + [(1, "another text under one id")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)] * 3, "doc_id long, quality int")
    a, b = (sorted(map(tuple, quality.quality_report(d, labels).collect())) for d in (docs, docs.repartition(5)))
    assert a == b and len(a) == 121


def test_media_in_parts(spark, monkeypatch):
    monkeypatch.setattr(gif, "HELD", 1000)
    docs = spark.createDataFrame([(i, "word " * (i * 40), 1, "x") for i in range(30)], "doc_id long, text string, payload int, error string").coalesce(1)
    got = gif.read_media(gif.store_texts(docs)).collect()
    assert [bytes(r["payload"]).decode().rstrip() for r in sorted(got, key=lambda r: r["doc_id"])] == [("word " * (i * 40)).rstrip() for i in range(30)]
    assert gif.read_media(gif.store_texts(docs.limit(0))).count() == 0
    small = gif.read_media(gif.store_texts(docs), max_pixels=1000).collect()
    assert sum(r["error"] is not None for r in small) > 0 and sum(r["error"] is None for r in small) > 0


def test_tokens_of_null_and_repeated_rows(spark):
    h = tokens.token_histogram(spark.createDataFrame([(None,), ("",), ("a",), ("a",)], "text string")).collect()
    assert sorted((r["n_tokens"], r["docs"]) for r in h) == [(0, 2), (1, 2)]


def test_warc_with_extra_columns_and_damage(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i}.example:8080/a b?c", "z" * 150 if i < 4 else f"p{i}", "clash", 1) for i in range(8)] + [(2, "u", "z" * 150, "c", 2)], "page_id long, url string, html string, digest string, bytes int")
    path = str(tmp_path / "w")
    got = warc.archive_round_trip(pages, path)
    assert sorted((r["page_id"], r["refers_page"] if r["refers_page"] is not None else -1) for r in got.collect()) == [(0, -1), (1, 0), (2, 0), (2, 0), (3, 0), (4, -1), (5, -1), (6, -1), (7, -1)]
    heads = [r["payload"] for r in warc.read_archives(spark, path).where("type = 'request'").select(F.col("http_header").alias("payload")).collect()]
    assert any("Host: h3.example:8080" in h for h in heads)
    assert warc.damaged_archives(spark, path).count() == 0
    with gzip.open(str(tmp_path / "w" / "bad.gz"), "wb") as f:
        f.write(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort")
    assert [(r["records"], r["damage"]) for r in warc.damaged_archives(spark, path).collect()] == [(0, "record cut off")]


def test_mix_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 9, 8, 7.0), (1, "x y z", "s", 9, 8, 7.0), (2, None, None, 1, 1, 1.0)], "doc_id long, text string, source string, size int, taken int, position double")
    a = sorted(map(str, mixing.plan_mix(docs).collect()))
    assert a == sorted(map(str, mixing.plan_mix(docs.repartition(3)).collect())) and len(a) == 3
    assert mixing.plan_mix(docs).columns[:3] == ["doc_id", "text", "source"]


def test_limits_and_shares_named_twice(spark):
    h = spark.createDataFrame([(2, 3, 6, 1, 3), (5, 1, 5, 4, 4)], "n_tokens long, docs long, tokens long, rank_from long, rank_to long")
    assert sorted(map(tuple, tokens.context_limits(h, [2, 2, 1]).collect())) == [(1, 4, 11, 4), (2, 1, 11, 8), (2, 1, 11, 8)]
    assert sorted(map(tuple, tokens.quantile_lengths(h, [0.75, 0.75, 0.76, 1.5]).collect())) == [(0.75, 2), (0.75, 2), (0.76, 5)]
    none = h.limit(0)
    assert sorted(map(tuple, tokens.context_limits(none, [3]).collect())) == [(3, 0, 0, 0)] and tokens.quantile_lengths(none, [0.5]).count() == 0
    assert tokens.context_limits(h, []).count() == 0
