"""The engine's operators on small inputs: ties, nulls, empty tables, and brute force where SQL has no word for it."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vectors as V
from tidemark.operators import calibration, chunking, evaluation, faithfulness, guardrails, interactions, leakage, querybank, retrieval, serving


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_normalize_and_tokens(spark):
    assert one(spark, "  It's  A-Test!\n", T.normalize_text) == "its atest"
    assert one(spark, "abcdefgh1", T.estimate_tokens) == 2
    assert one(spark, None, T.normalize_text) is None
    assert sorted(one(spark, "ab", T.trigram_set)) == sorted(["  a", " ab", "ab ", "b  "])
    assert one(spark, "", T.trigram_set) == []


@pytest.mark.parametrize(
    "query,action,reason",
    [
        ("comfortable running shoes", "refuse", "out_of_scope_category"),
        ("laptop bag for running shoes", "allow", "in_scope"),
        ("something", "clarify", "ambiguous_query"),
        ("", "clarify", "ambiguous_query"),
        ("phone case made in the USA", "refuse", "unsupported_attribute_claim"),
        ("safest charger", "hedge", "low_evidence_boundary"),
        ("webcam with fewest complaints", "hedge", "negative_problem_seeking"),
    ],
)
def test_policy(spark, query, action, reason):
    got = one(spark, query, T.query_policy)
    assert (got["action"], got["reason"]) == (action, reason)


@pytest.mark.parametrize("query,slices", [("current draw of a hub", []), ("current model", ["recency_sensitive_query"]), ("costs $2024", []), ("in 2024", ["recency_sensitive_query"]), ("issue tracker", []), ("issues with it", ["negative_problem_query"]), ("latest problems", ["recency_sensitive_query", "negative_problem_query"])])
def test_slices(spark, query, slices):
    assert one(spark, query, T.query_slices) == slices


def test_quotes_and_citations(spark):
    x = "Say \"good sound\" [review_1, review_2] and 'long life' per review_9, \"abc\"."
    assert one(spark, x, T.extract_quotes) == ["good sound", "long life"]
    assert [tuple(c) for c in one(spark, x, T.extract_citations)] == [("review_1", "good sound"), ("review_2", "good sound"), ("review_9", None)]
    rows = spark.createDataFrame([('"one two three four five" [review_1]', ["One two, three four!"], ["review_1"])], "explanation string, evidence_texts array<string>, evidence_ids array<string>")
    assert faithfulness.verify_quotes(rows).first()["all_verified"]  # four of five words
    assert faithfulness.verify_citations(rows).first()["all_valid"]


def test_masks_treat_nulls_as_invalid(spark):
    rows = spark.createDataFrame([("good enough text", 5.0, "u", "p"), (None, 3.0, "u", "p"), ("short", float("nan"), "nan", "p"), ("good enough text", None, "u", None)], "text string, rating double, user_id string, parent_asin string")
    assert interactions.clean_reviews(rows).count() == 1
    got = {r["issue"]: r["reviews"] for r in interactions.review_issues(rows).collect()}
    assert got == {"missing_text": 1, "very_short_text": 1, "invalid_rating": 2, "missing_user": 1, "missing_product": 1, "duplicate_text": 1, "clean_rows": 1}
    assert interactions.review_stats(spark.createDataFrame([], "user_id int, item_id int, rating double")).first()["sparsity"] == 1.0


def test_k_core_like_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 12, (60, 2))] + [(99, 99)]
    left = list(rows)
    while True:
        u = {x for x in {a for a, _ in left} if sum(a == x for a, _ in left) >= 5}
        after = [r for r in left if r[0] in u]
        i = {x for x in {b for _, b in after} if sum(b == x for _, b in after) >= 5}
        after = [r for r in after if r[1] in i]
        if len(after) == len(left):
            break
        left = after
    got = interactions.k_core(spark.createDataFrame(rows, "user_id int, item_id int")).collect()
    assert sorted(map(tuple, got)) == sorted(left)


def test_vector_search_like_numpy(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8))
    v[7] = v[3]  # a tie
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "point_id long, vector array<double>")
    queries = points.where("point_id < 5").withColumnRenamed("point_id", "query_id")
    got = retrieval.vector_search(queries, points, 4).collect()
    for q in range(5):
        s = np.round(v @ v[q], 6)
        want = sorted(range(300), key=lambda i: (-s[i], i))[:4]
        assert [r["point_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_scores_and_ranking(spark):
    rows = spark.createDataFrame([(1, 10, 0.5, 0.0), (1, 10, 0.7, 0.0), (1, 11, 0.6, 4.0), (1, 11, 0.2, 1.0)], "query_id int, product_id int, score double, rating double")
    mean = {r["product_id"]: r["score"] for r in retrieval.product_scores(rows, "weighted_mean").collect()}
    assert mean == {10: 0.6, 11: 0.52}
    flat = spark.createDataFrame([(1, 1, 0.5, 5.0), (1, 2, 0.5, 1.0)], "query_id int, product_id int, score double, avg_rating double")
    assert [r["score"] for r in retrieval.weighted_ranking(flat).orderBy("product_id").collect()] == [1.0, 0.84]


def test_metrics_by_hand(spark):
    ranking = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "query_id int, product_id int, rank int")
    judged = spark.createDataFrame([(1, 6, 3.0), (1, 9, 1.0), (2, 9, 1.0)], "query_id int, product_id int, grade double")
    got = {r["query_id"]: r for r in evaluation.ranking_metrics(ranking, judged, 3).collect()}
    assert math.isclose(got[1]["ndcg"], (3 / math.log2(3)) / (3 + 1 / math.log2(3)))
    assert (got[1]["hit"], got[1]["mrr"], got[1]["recall"]) == (1.0, 0.5, 0.5)
    assert (got[2]["ndcg"], got[2]["hit"]) == (0.0, 0.0)


def test_bootstrap_is_seeded(spark):
    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "query_id int, x double")
    a, b = (evaluation.bootstrap_ci(rows, "x").first() for _ in range(2))
    assert a == b and a["lower"] < a["mean"] < a["upper"]


def test_calibration_like_brute_force(spark):
    rng = np.random.default_rng(1)
    obs = [(int(q), int(t), int(c), float(round(s, 3)), float(g)) for q, t, c, s, g in zip(rng.integers(0, 6, 40), rng.integers(0, 220, 40), rng.integers(0, 6, 40), rng.random(40), rng.integers(0, 3, 40))]
    queries = spark.createDataFrame([(q,) for q in range(7)], "query_id int")
    got = calibration.threshold_metrics(queries, spark.createDataFrame(obs, "query_id int, total_tokens int, chunk_count int, top_score double, grade double")).collect()
    assert len(got) == 9 * 5 * 7
    for r in got[::40]:
        ok = [o for o in obs if o[1] >= r["min_tokens"] and o[2] >= r["min_chunks"] and o[3] >= r["min_score"]]
        assert r["accepted_count"] == len(ok) and r["accepted_queries"] == len({o[0] for o in ok if o[4] > 0})
        assert r["total_queries"] == 7 and r["total_observations"] == 40


def test_leakage_like_nested_loop(spark):
    words = "good bad usb hub cable with long short dock fan".split()
    rng = np.random.default_rng(2)
    texts = [(i, " ".join(rng.choice(words, rng.integers(2, 7)))) for i in range(40)] + [(40, ""), (41, "!!"), (42, "usb hub  GOOD"), (43, "usb hub good")]
    rows = spark.createDataFrame(texts, "id int, text string")
    got = {(r["left_id"], r["right_id"]): r["severity"] for r in leakage.flagged_pairs(rows, rows, "id", "id", same=True).collect()}

    def sets(t):
        n = " ".join(t.lower().split())
        p = f"  {n}  "
        return n, set("".join(c if c.isalnum() else " " for c in n).split()), {p[i : i + 3] for i in range(len(p) - 2)} if n else set()

    jac = lambda a, b: round(len(a & b) / len(a | b), 6) if a | b else 0.0
    for (i, s), (j, t) in itertools.combinations(texts, 2):
        (n1, a, x), (n2, b, y) = sets(s), sets(t)
        tok, tri = jac(a, b), jac(x, y)
        want = "exact_duplicate" if n1 == n2 else "high_confidence_near_duplicate" if tok >= 0.75 and tri >= 0.72 else "semantic_watchlist" if tok >= 0.6 or tri >= 0.68 else None
        assert got.get((i, j)) == want, (s, t)


def test_components_of_a_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)], "left_id int, right_id int")
    got = {r["id"]: r["component"] for r in leakage.components(nodes, edges).collect()}
    assert got == {i: 0 if i < 9 else i for i in range(12)}


def plain_windows(text, step=600, keep=120):
    """Windows by the definition, one character at a time."""
    out, at = [], 0
    while at < len(text) and not (out and at >= len(text) - keep):
        end = at + step
        if end < len(text):
            low = end - step // 5
            for mark in (". ", "! ", "? ", "\n"):
                last = max((p for p in range(low, end - len(mark) + 1) if text[p : p + len(mark)] == mark), default=-1)
                if last > low:
                    end = last + 1
                    break
        out.append(text[at:end].strip())
        at = end - keep
    return [o for o in out if o]


def test_chunk_windows(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta.", "gamma!", "delta?", "eps\n", "é", "x" * 40, "  "]
    texts = ["".join(f"Sentence number {i} is here. " for i in range(100)), "short", None, "   ", "y" * 3000] + [" ".join(rng.choice(words, rng.integers(100, 900))) for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "review_id int, text string")
    got = {}
    for r in sorted(chunking.chunk_reviews(rows).collect(), key=lambda r: r["chunk_index"]):
        got.setdefault(r["review_id"], []).append(r["text"])
    for i, t in enumerate(texts):
        t = (t or "").strip()
        assert got.get(i, []) == ([] if not t else [t] if len(t) // 4 <= 200 else plain_windows(t)), i


def test_chunks_by_topic(spark):
    sentences = [f"Part {'one' if i < 12 else 'two' if i < 25 else 'three'} of this text is sentence number {i}." for i in range(40)]
    vector = [[1.0, 0.0] if i < 12 else [0.0, 1.0] if i < 25 else [-1.0, 0.0] for i in range(40)]
    rows = spark.createDataFrame([("a", " ".join(sentences)), ("b", " ".join(sentences)), ("c", "x" * 900)], "review_id string, text string")
    vectors = spark.createDataFrame([("a", i, v) for i, v in enumerate(vector)] + [("b", 0, [1.0, 0.0])], "review_id string, pos int, vector array<double>")
    got = {}
    for r in sorted(chunking.chunk_reviews(rows, vectors=vectors).collect(), key=lambda r: r["chunk_index"]):
        got.setdefault(r["review_id"], []).append(r["text"])
    assert got["a"] == [" ".join(sentences[:12]), " ".join(sentences[12:25]), " ".join(sentences[25:])]
    assert got["b"] == plain_windows(" ".join(sentences))  # a sentence without a vector: windows
    assert got["c"] == ["x" * 900]


def test_ages_and_freshness(spark):
    ref = 1_700_000_000_000
    day = 86_400_000
    rows = spark.createDataFrame([(1, ref - 400 * day, 1.0, True), (1, None, 5.0, None), (2, ref + day, None, False), (3, None, None, None)], "case_id int, timestamp_ms long, rating double, verified_purchase boolean")
    got = {r["case_id"]: r for r in guardrails.evidence_report(rows, ref).collect()}
    assert got[1]["all_timestamped_evidence_old"] and got[1]["median_evidence_age_days"] == 400.0 and got[1]["negative_review_rate"] == 0.5
    assert got[2]["max_evidence_age_days"] == 0.0 and got[3]["timestamp_available_count"] == 0 and got[3]["old_review_share"] is None
    risk = guardrails.freshness_risk(guardrails.evidence_report(rows, ref), F.lit(True), F.lit("answer"))
    assert {r["case_id"]: r["risk_level"] for r in risk.collect()} == {1: "stale", 2: "fresh_enough", 3: "missing_timestamps"}


def test_exact_cache_like_a_dictionary(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"k{rng.integers(3)}", int(t)) for i, t in enumerate(sorted(rng.integers(0, 20000, 80)))]
    df = spark.createDataFrame(rows, "request_id long, key string, s long").select("request_id", "key", F.timestamp_seconds("s").alias("ts"))
    put, want = {}, {}
    for i, k, t in rows:
        hit = k in put and t - put[k] <= 3600
        want[i] = hit
        if not hit:
            put[k] = t
    assert {r["request_id"]: r["hit"] for r in serving.exact_cache(df).collect()} == want


def test_stratified_sample_and_packing(spark):
    rows = spark.createDataFrame([(i, "a" if i < 90 else "b" if i < 99 else "c") for i in range(100)], "id int, g string")
    got = [r["g"] for r in faithfulness.stratified_sample(rows, "g", 10, "id").collect()]
    assert sorted(got) == ["a"] * 7 + ["b"] * 2 + ["c"]  # one each, then in proportion, the rest by the largest fraction
    few = faithfulness.stratified_sample(rows, "g", 2, "id").collect()
    assert len(few) == 2
    null = rows.withColumn("g", F.when(F.col("g") != "b", F.col("g")))
    assert sorted(str(r["g"]) for r in faithfulness.stratified_sample(null, "g", 10, "id").collect()) == ["None"] * 2 + ["a"] * 7 + ["c"]
    assert faithfulness.stratified_sample(rows, "g", 500, "id").count() == 100
    chunks = spark.createDataFrame([(1, 1, "x" * 2000), (1, 2, "y" * 400)], "g int, o int, text string")
    packed = {r["o"]: len(r["text"]) for r in faithfulness.pack_budget(chunks, "g", ["o"]).collect()}
    assert packed == {1: 2000, 2: 32}


def test_bank(spark):
    rows = spark.createDataFrame([("train", "q", 1, "E"), ("train", "q", 1, "S"), ("train", "q", 2, "C"), ("train", "q", 3, "S"), ("train", "r", 9, "E")], "split string, query string, product_id int, label string")
    got = querybank.judged_queries(rows, spark.createDataFrame([(1,), (2,), (3,)], "product_id int")).collect()
    assert len(got) == 1 and got[0]["relevant_items"] == {1: 3.0, 3: 2.0}
    empty = querybank.corpus_anchor(spark.createDataFrame([], "product_id string")).first()
    assert empty["products"] is None


def test_hash_fraction(spark):
    import hashlib

    want = int(hashlib.sha256(b"abc").hexdigest()[:16], 16) / 0xFFFFFFFFFFFFFFFF
    assert one(spark, "abc", V.hash_fraction) == want
