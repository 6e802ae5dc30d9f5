"""Language and quality: held-out accuracy, and what is never looked at."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import langid, quality
from tidemark.llm.sampling import held_out

STEMS = {"en": "the and ing tion wh th".split(), "de": "der und ung sch ich zu".split(), "fr": "le que eau ment ou é".split(), "es": "el que ción os ar ñ".split()}


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, " ".join("".join(rng.choice(STEMS[lang], rng.integers(1, 4))) for _ in range(rng.integers(3, 60))), lang, f"s{i % 3}") for i in range(n) for lang in [list(STEMS)[rng.integers(4)]]]


def test_language_held_out(spark, docs):
    rows = docs(texts(400) + [(1000, None, "en", None), (1001, "", None, None), (1002, "12 !?", "en", "s"), (None, "the and thing", None, None), (1003, "der " * 200_000, None, None)])
    got = {r["doc_id"]: r for r in langid.language_report(rows).collect()}
    truth = {r[0]: r[2] for r in texts(400)}
    unseen = [i for i in truth if got[i]["held_out"]]
    assert len(unseen) > 40 and np.mean([got[i]["lang_pred"] == truth[i] for i in unseen]) > 0.95
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["score"] == 0.0
    assert got[1003]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_looks_at_text_only(spark, docs):
    rows = docs(texts(200))
    model = langid.fit_languages(rows)
    a = [tuple(r) for r in langid.identify(rows, model).orderBy("doc_id").select("lang_pred", "score").collect()]
    b = [tuple(r) for r in langid.identify(rows.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), model).orderBy("doc_id").select("lang_pred", "score").collect()]
    assert a == b
    other = rows.withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in sum(langid.fit_languages(other).families.values(), [])


def test_language_without_labels(spark, docs):
    rows = docs([(1, "some text", None, None)])
    assert langid.language_report(rows).first()["lang_pred"] == "und"
    assert langid.language_report(rows.limit(0)).count() == 0
    one = docs([(i, "only this", "en", "s") for i in range(1, 30)])
    assert {r["lang_pred"] for r in langid.language_report(one).collect()} == {"en"}


def test_ngrams_of_pieces():
    whole = "abcé dë ΟΔΟΣ x" * 100 + "\t\n" * 200 + "z" * 300 + " . ; 123 " * 40 + "end"
    keep = langid.CHUNK
    a = langid.ngram_features(whole)
    langid.CHUNK = 64
    b = langid.ngram_features(whole)
    langid.CHUNK = keep
    assert (a == b).all()


def test_quality_held_out(spark, docs):
    rows = texts(600, 1)
    rng = np.random.default_rng(9)
    bad = {i for i, *_ in rows if rng.random() < 0.3}
    marked = [(i, " ".join(w + "$%&#"[k % 4] * 3 for k, w in enumerate(t.split())) if i in bad else t, lang, s) for i, t, lang, s in rows]
    labels = spark.createDataFrame([(i, int(i not in bad)) for i, *_ in rows if i % 7] + [(3, None), (None, 1)], "doc_id long, quality int")
    extra = [(1000, None, None, None), (1001, "", None, None), (1002, "the and " * 100_000, None, None), (None, "x", None, None)]
    got = {r["doc_id"]: r for r in quality.quality_report(docs(marked + extra), labels).collect()}
    unseen = [i for i, *_ in rows if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == int(i not in bad) for i in unseen]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values()) and len(got) == 604
    assert got[1000]["score"] == got[1001]["score"]


def test_quality_without_a_class(spark, docs):
    rows = docs(texts(50))
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    assert {r["predicted"] for r in quality.quality_report(rows, labels).collect()} == {1}
    assert quality.quality_report(rows, labels.limit(0)).first()["score"] == 0.5
    assert quality.quality_report(rows.limit(0), labels).count() == 0
