"""All pairs in tiles, judged where they are compared, against the prefix joins and against SQL; nothing of a pair is shuffled."""

import random

import duckdb
import pytest

from tidemark.operators import leakage
from tidemark.plans import registry


@pytest.fixture
def small(monkeypatch):
    for name, n in (("_GROUP", 16), ("_TILE", 8), ("_COPIES", 3)):
        monkeypatch.setattr(leakage, name, n)


def surfaces(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdef", k=r.randint(2, 6))) for _ in range(60)]
    texts = []
    for i in range(60):
        base = r.choice(texts).split() if i % 2 else []
        texts.append(" ".join((base[: len(base) - r.randint(0, 4)] if base else r.choices(words, k=r.randint(1, 30))) + r.choices(words, k=r.randint(0, 3))))
    left = [(i, t) for i, t in enumerate([*texts[:45], *[texts[0]] * 11, "", " ", None])]
    right = [(100 + i, t) for i, t in enumerate([*texts[20:], *[texts[0].upper()] * 7, *[texts[59]] * 4, "", "!", None])] + [(None, texts[1])]
    return [spark.createDataFrame(x, "id long, text string") for x in (left, right)]


def rows(pairs):
    return sorted(tuple(r) for r in pairs.where("left_id is not null and right_id is not null").collect())


def test_texts_in_tiles(spark, small):
    left, right = surfaces(spark)
    want, found = leakage.flagged_pairs(left, right, "id", "id"), leakage.flagged_pairs(left, right, "id", "id", sketches=True)
    assert len(rows(want)) > 150 and rows(found) == rows(want)
    assert rows(leakage.flagged_pairs(left, left, "id", "id", same=True, sketches=True)) == rows(leakage.flagged_pairs(left, left, "id", "id", same=True))
    # what is flagged leaves the task that compares it, and goes through no shuffle and no join
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Join" not in plan


def test_risk_in_tiles(spark, small):
    left, right = surfaces(spark)
    right = right.where("id is not null")
    assert leakage.text_risk(left, right, "id", "id").first() == leakage.leakage_risk(leakage.flagged_pairs(left, right, "id", "id")).first()


@pytest.mark.parametrize("query", ["leakage_signals", "worst_leaks"])
def test_every_near_vector_counts(spark, tmp_path, monkeypatch, query):
    monkeypatch.setattr(leakage, "_GROUP", 64)
    monkeypatch.setattr(leakage, "_TILE", 32)
    r = random.Random(2)
    near = [[1.0, 0.0, 0.0, r.choice([0.0, 0.1, 0.25])] for _ in range(120)]  # each has 120 points nearby
    far = [[0.0, r.choice([-1.0, 1.0]), r.choice([0.0, 0.125, 0.25, 0.5]), 0.0] for _ in range(30)]
    data = [(i, v, i % 7) for i, v in enumerate([*near, *far, None])]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    cursor = con.execute(registry.oracle_sql()[query])
    names = [d[0] for d in cursor.description]
    want, found = cursor.fetchall(), registry.queries()[query](spark, str(tmp_path))
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(want)
    if query == "leakage_signals":
        assert sum(x[names.index("cosine")] >= 0.93 for x in want) > 14_000
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_strong_links_without_all_pairs(spark, monkeypatch, tmp_path):
    left, _ = surfaces(spark)
    left.selectExpr("id as conv_id", "0 as turn", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    strong = [r for r in leakage.flagged_pairs(left, left, "id", "id", same=True).collect() if r["severity"] != "semantic_watchlist"]
    of = {r["id"]: r["id"] for r in left.collect()}
    for _ in of:
        for x in strong:
            a, b = x["left_id"], x["right_id"]
            of[a] = of[b] = min(of[a], of[b])

    def never(*_, **__):
        raise AssertionError("all pairs are compared")

    monkeypatch.setattr(leakage, "_near", never)
    got = {r["id"] // 100: r["component"] // 100 for r in registry.queries()["conversation_components"](spark, str(tmp_path)).collect()}
    assert got == of and len(set(of.values())) < len(of) - 11
