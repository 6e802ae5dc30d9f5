"""The pipeline's stages, one by one, on a corpus where each has something to do."""

import numpy as np

import corpus_pipeline

STEMS = {"en": "the and ing tion wh th er on".split(), "fr": "le que eau ment ou é ai re".split()}


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(0)

    def words(lang, n):
        return ["".join(rng.choice(STEMS[lang], rng.integers(1, 5))) for _ in range(n)]

    item = " ".join(words("en", 30))
    rows = []
    for i in range(200):
        lang = ("en", "fr")[i % 2]
        w = words(lang, 80)
        rows.append((i, " ".join(x + "$%&#"[k % 4] * 3 if i % 5 == 2 else x for k, x in enumerate(w)), lang, f"s{i % 4}", 0))
    rows += [(300, rows[0][1], "en", "s0", 0), (301, rows[1][1] + " fin", "fr", "s1", 0), (302, " ".join(words("en", 40)) + " " + item, "en", "s1", 0), (303, None, "en", None, 0), (304, "12 34", None, "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 != 2), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == 4 or docs.columns == columns
        seen.append({r["doc_id"] for r in docs.collect()})
    everything = {r[0] for r in rows}
    assert everything - seen[0] == {303, 304}
    bad = {i for i in range(200) if i % 5 == 2}
    assert len(seen[0] - seen[1] - bad) <= 3 and len(bad & seen[1]) <= 3
    assert seen[1] - seen[2] == {300, 301} & seen[1] and seen[2] - seen[3] == {302}
    final = {r["doc_id"]: r["taken"] for r in docs.collect()}
    assert set(final) <= seen[3] and all(final.values())
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(final)
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
