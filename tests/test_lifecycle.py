"""Cases, boundary behaviour, checks and requests, with what their queries' fixtures don't hold."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import validation as V
from tidemark.operators import boundary, cases, checks, guardrails, interactions, leakage, querybank, recommend
from tidemark.sources import readers


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


def test_answerabilities_and_words_for_flags(spark):
    for value, want in (("refusal", "refuse"), ("unanswerable", "refuse"), ("out_of_scope", "refuse"), ("ambiguous", "clarify"), ("boundary", "hedge_or_refuse"), ("answerable", "answer"), ("?", "answer"), (None, "answer")):
        assert one(spark, value, T.expected_behavior) == want
    for value, want in (("T", True), ("1.00", True), (" no", False), ("0", False), ("2", None), ("maybe", None), (None, None)):
        assert one(spark, value, T.boolish) is want


def test_cleaned_explanations(spark):
    for value, want in (
        ('Reviewers say "great sound" [review_1] and "long battery" [review_22].', '"great sound". The product is "long battery".'),
        ("One reviewer confirms it  works ,  mostly.", "works, mostly."), ("According to reviews, fine .", "fine."), (None, None), ("", ""),
    ):
        assert one(spark, value, T.clean_explanation) == want


def test_empty_inventories_and_summaries(spark):
    out = spark.createDataFrame([], "query_id long, outcome_status string, source_subset string, bundle_id string, product string")
    assert cases.inventory_problems(out.drop("outcome_status"), out, "s", ("product",)).count() == 0
    row = cases.case_summary(out).first()
    assert row["total_queries"] == 0 and row["gate_pass_rate"] == 0.0


def test_lone_scores_are_an_error(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "k int, i int, e string")
    b = spark.createDataFrame([(1, 0, 0.5)], "k int, i int, s double")
    assert cases.zip_scores(a.where("i = 0"), b, "k", "i").count() == 1
    with pytest.raises(Exception, match="no counterpart"):
        cases.zip_scores(a, b, "k", "i").collect()


def test_guardrail_without_freshness(spark):
    rows = spark.createDataFrame([(1, "refuse", "answer", "runtime_e2e", False, False, False, [], True)], "query_id int, expected string, observed string, evaluation_surface string, strict_match boolean, acceptable_match boolean, surface_contract_satisfied boolean, query_slice_tags array<string>, x boolean")
    none = spark.createDataFrame([], "recency_sensitive long, applicable_cases long, violation_rate double, promotion_status string")
    found = {r["metric"]: r["violated"] for r in boundary.guardrail_checks(boundary.summary(rows), none).collect()}
    assert found["freshness_guardrail_present"] and found["total_queries"] and found["refusal_required_false_accept_rate"]
    assert boundary.guardrail_status(boundary.guardrail_checks(boundary.summary(rows), none)).first()["status"] == "insufficient_coverage"
    odd = spark.createDataFrame([(9, 9, 0.0, "perhaps")], none.schema)
    assert "freshness_guardrail_status_known" in {r["metric"] for r in boundary.guardrail_checks(boundary.summary(rows), odd).collect()}


def test_alignment_reasons(spark):
    local = spark.createDataFrame([("f", 5)], "fingerprint string, chunk_count long")
    none = spark.createDataFrame([], "fingerprint string, stamped_at long")
    same = spark.createDataFrame([("f", 1)], none.schema)
    n = lambda k: spark.createDataFrame([(k,)], "points_count long")
    status = lambda *a, **k: checks.anchor_alignment(*a, **k).first()["status"]
    assert status(local, same, n(5)) == "aligned" and status(local, same, n(6)) == "count_differs" and status(local, none, n(5)) == "no_remote_anchor"
    assert status(local, none, n(5), require_remote=False) == "aligned" and status(local, same, n(None)) == "count_unknown"
    stamped = checks.stamp(spark.createDataFrame([("c", "old", 1, 0), ("d", "x", 1, 0)], "collection string, fingerprint string, chunk_count long, stamped_at long"), "c", local, F.lit(7).cast("long"))
    assert sorted((r["collection"], r["fingerprint"]) for r in stamped.collect()) == [("c", "f"), ("d", "x")]


def test_reference_of_a_manifest(spark):
    assert checks.frozen_reference(spark.createDataFrame([(5,)], "frozen_at_ms long")) == 5
    with pytest.raises(ValueError):
        checks.frozen_reference(spark.createDataFrame([], "frozen_at_ms long"))


def test_candidates_must_repeat_nothing(spark):
    good, bad = (spark.createDataFrame([(v,)], "v array<string>") for v in (["a", "b"], ["a", "a"]))
    assert good.select(querybank.unique_or_error(F.col("v")).alias("r")).first()["r"] == ["a", "b"]
    with pytest.raises(Exception, match="repeated value"):
        bad.select(querybank.unique_or_error(F.col("v")).alias("r")).collect()


def test_validators_raise_or_set_apart(spark):
    rows = spark.createDataFrame([("a", "1"), (" ", "x")], "name string, n string")
    rules = {"name": V.non_empty(F.col("name")), "n": V.whole_number(F.col("n"))}
    good, bad = V.quarantine(rows, rules)
    assert good.count() == 1 and bad.first()["problems"] == ["name: empty", "n: not an integer"]
    with pytest.raises(Exception, match="name: empty, n: not an integer"):
        V.required(rows, rules).collect()


def test_readers_that_insist(spark, tmp_path):
    from pyspark.sql import types as S

    schema = S.StructType([S.StructField("a", S.IntegerType())])
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{bad\n')
    with pytest.raises(ValueError, match="line 4"):
        readers.require_json_rows(spark, str(tmp_path / "x.jsonl"), schema)
    (tmp_path / "y.jsonl").write_text('{"a": 1}\n')
    assert readers.require_json_rows(spark, str(tmp_path / "y.jsonl"), schema).count() == 1
    assert readers.read_json_array(spark, str(tmp_path / "none.json"), required=False) is None
    with pytest.raises(FileNotFoundError):
        readers.read_json_array(spark, str(tmp_path / "none.json"))
    (tmp_path / "empty.json").write_text("[]")
    with pytest.raises(ValueError):
        readers.read_json_array(spark, str(tmp_path / "empty.json"), non_empty=True, schema=schema)


def test_k_core_of_a_long_chain(spark):
    """A chain that loses one row a round is peeled to its end."""
    rows = [(i, i) for i in range(60)] + [(i, i + 1) for i in range(60)]
    got = interactions.k_core(spark.createDataFrame(rows, "user_id int, item_id int"), 2)
    assert got.count() == 0


def test_surfaces_that_share_a_query(spark):
    rows = [("a", 1, "usb hub with long cable"), ("b", 1, "usb hub with long cable"), ("b", 2, "usb hub with long cable"), ("c", 3, "something else entirely here"), ("a", 4, None), ("b", 5, "")]
    got = {(r["left_surface"], r["right_surface"]): (r["exact"], r["risk_level"]) for r in leakage.surface_matrix(spark.createDataFrame(rows, "surface string, query_id int, text string")).collect()}
    assert got[("a", "b")][0] >= 2 and got[("a", "b")][1] == "high" and got[("a", "c")] == (0, "low")


def test_requests_and_explanations_of_nothing(spark):
    products = spark.createDataFrame([(1, "latest webcam", 7, 4.0, 0, 0, 0.0, [], "draft", None), (2, "lamp", 8, None, 9, 900, 0.9, [("review_1", 5.0, "t", None, None)], "great choice", "plain")], "query_id int, query string, product_id int, avg_rating double, chunk_count long, total_tokens long, top_score double, evidence array<struct<review_id:string,rating:double,text:string,timestamp_ms:long,verified_purchase:boolean>>, draft string, retry string")
    got = {r["query_id"]: r for r in recommend.explain(products, 10**12).collect()}
    assert got[1]["source"] == "quality_gate_refusal" and "Only 0 review excerpt(s)" in got[1]["explanation"]
    assert got[2]["source"] == "retry" and got[2]["explanation"] == "plain" and got[2]["violations"] == []
    requests = spark.createDataFrame([(1, None), (2, "lamp")], "request_id int, query string")
    none = spark.createDataFrame([], "cache_key string")
    paths = {r["request_id"]: r["path"] for r in recommend.handle_requests(requests, none, spark.createDataFrame([], "request_id int, product_id int"), F.lit(3), F.lit(True), F.lit(4.0)).collect()}
    assert paths == {1: "policy", 2: "empty"}


def test_freshness_of_no_case(spark):
    empty = spark.createDataFrame([], "risk_level string, applicable boolean, violation boolean, behavior string")
    row = guardrails.freshness_summary(empty).first()
    assert row["promotion_status"] == "insufficient_coverage" and row["violation_rate"] is None and guardrails.freshness_counters(empty).count() == 0


def test_parts_are_trimmed(spark):
    assert one(spark, "a, b,, a ,", T.csv_list) == ["a", "b"]
    assert one(spark, 'x " 0 spaced out 1 " y "1 2 3 4"', T.extract_quotes) == ["0 spaced out 1", "1 2 3 4"]
    assert one(spark, "0 One.  1 two. Three 2.", T.split_sentences) == ["0 One. 1 two.", "Three 2."]
