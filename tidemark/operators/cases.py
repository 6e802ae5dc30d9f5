"""Explanation cases: freezing seed bundles, gating them into cases, and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import is_non_recommendation, is_refusal, observed_explanation, query_slices
from tidemark.operators.faithfulness import verify_quotes
from tidemark.operators.retrieval import evidence_gate

# What can become of a query when its bundle is frozen, and when the bundle is gated.
BUNDLED, NO_CANDIDATES, FAILED = "bundled", "no_candidates_retrieved", "retrieval_error"
MATERIALIZED, INSUFFICIENT = "materialized", "insufficient_evidence"
DIGITS = 4


def _rate(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), digits)


def freeze_bundles(attempted: DataFrame, products: DataFrame, source_subset: str) -> DataFrame:
    """P10: one row for each query of ``attempted`` (``query_id, query, error``) with what became of it and its best product.

    ``products``: ``query_id, product_id, rank`` and what else is to be frozen with them;
    the product of rank 1 is the bundle.  ``outcome_status`` is ``retrieval_error`` where
    there is an error, ``no_candidates_retrieved`` without a product, else ``bundled``.
    ``bundle_id`` numbers nothing: it is made of subset and query.
    """
    best = products.where("rank = 1").drop("rank")
    rows = attempted.join(best, "query_id", "left")
    status = F.when(F.col("error").isNotNull(), FAILED).when(F.col("product_id").isNull(), NO_CANDIDATES).otherwise(BUNDLED)
    rows = rows.withColumn("outcome_status", status).withColumn("source_subset", F.lit(source_subset))
    own = [c for c in best.columns if c != "query_id"]
    # a product that came with an error is not frozen
    rows = rows.withColumns({c: F.when(F.col("outcome_status") == BUNDLED, F.col(c)) for c in own})
    return rows.withColumn("bundle_id", F.when(F.col("outcome_status") == BUNDLED, F.concat_ws(":", "source_subset", F.col("query_id").cast("string"))))


def bundles_of(outcomes: DataFrame) -> DataFrame:
    """P10: the bundles among the outcomes."""
    return outcomes.where(F.col("outcome_status") == BUNDLED).drop("error", "outcome_status")


def inventory_problems(bundles: DataFrame, outcomes: DataFrame, source_subset: str, fields: tuple[str, ...]) -> DataFrame:
    """``query_id, problem`` of bundles and outcomes that do not fit; empty if all do.

    Compared from both sides: bundled queries without a bundle, bundles of queries that are
    not marked bundled, rows of another subset, and fields that differ (null equals null).
    """
    left = bundles.select("query_id", F.lit(True).alias("here"), F.col("source_subset").alias("b_subset"), F.col("bundle_id").alias("b_id"), *[F.col(f).alias(f"b_{f}") for f in fields])
    right = outcomes.select("query_id", F.col("outcome_status").alias("status"), F.col("source_subset").alias("o_subset"), F.col("bundle_id").alias("o_id"), *[F.col(f).alias(f"o_{f}") for f in fields])
    both = left.join(right, "query_id", "full_outer")
    there, marked = F.col("here").isNotNull(), F.coalesce(F.col("status") == BUNDLED, F.lit(False))
    found = [
        F.when(marked & ~there, "missing_bundle"),
        F.when(there & ~marked, "unexpected_bundle"),
        F.when(there & ~F.col("b_subset").eqNullSafe(F.lit(source_subset)), "bundle_subset"),
        F.when(F.col("status").isNotNull() & ~F.col("o_subset").eqNullSafe(F.lit(source_subset)), "outcome_subset"),
        F.when(there & marked & F.col("o_id").isNotNull() & ~F.col("b_id").eqNullSafe(F.col("o_id")), "bundle_id"),
        *[F.when(there & marked & ~F.col(f"b_{f}").eqNullSafe(F.col(f"o_{f}")), f"field:{f}") for f in fields],
    ]
    return both.select("query_id", F.explode(F.array_compact(F.array(*found))).alias("problem"))


def materialize_cases(outcomes: DataFrame, min_chunks: int = 1, min_tokens: int = 20, min_score: float = 0.7) -> DataFrame:
    """Frozen outcomes after the evidence gate: bundles pass it or not, other outcomes stay what they are.

    Needs ``chunk_count, total_tokens, top_score`` of bundles.  ``case_id`` is given to those
    that pass, ``gate_refusal_type`` says why others don't, and the gate is written beside.
    """
    gated = evidence_gate(outcomes, min_chunks, min_tokens, min_score)
    bundled = F.col("outcome_status") == BUNDLED
    passed = bundled & F.col("is_sufficient")
    status = F.when(passed, MATERIALIZED).when(bundled, INSUFFICIENT).otherwise(F.col("outcome_status"))
    rows = gated.withColumns({"case_status": status, "case_id": F.when(passed, F.concat_ws(":", F.lit("case"), "bundle_id")), "gate_refusal_type": F.when(bundled, F.col("refusal_type"))})
    rows = rows.withColumns({"gate_min_chunks": F.lit(min_chunks), "gate_min_tokens": F.lit(min_tokens), "gate_min_score": F.lit(float(min_score))})
    return rows.drop("refusal_type", "is_sufficient", "outcome_status").withColumnRenamed("case_status", "outcome_status")


def bundle_summary(outcomes: DataFrame) -> DataFrame:
    """One row: queries, bundles, the rest, and the share that was bundled."""
    of = lambda s: F.count_if(F.col("outcome_status") == s)
    sums = outcomes.agg(F.count("*").alias("total_queries"), of(BUNDLED).alias("bundled"), of(NO_CANDIDATES).alias("no_candidates"), of(FAILED).alias("errors"))
    return sums.withColumns({"not_bundled": F.col("total_queries") - F.col("bundled"), "bundle_rate": _rate(F.col("bundled"), F.col("total_queries"))})


def case_summary(outcomes: DataFrame) -> DataFrame:
    """One row: cases, what else became of queries, and the rates of materialising, of finding candidates and of passing the gate."""
    of = lambda s: F.count_if(F.col("outcome_status") == s)
    sums = outcomes.agg(F.count("*").alias("total_queries"), of(MATERIALIZED).alias("materialized"), of(INSUFFICIENT).alias("insufficient"), of(NO_CANDIDATES).alias("no_candidates"), of(FAILED).alias("errors"))
    sums = sums.withColumns({"not_materialized": F.col("total_queries") - F.col("materialized"), "with_candidates": F.col("materialized") + F.col("insufficient")})
    return sums.withColumns(
        {
            "materialization_rate": _rate(F.col("materialized"), F.col("total_queries")),
            "candidate_rate": _rate(F.col("with_candidates"), F.col("total_queries")),
            "gate_pass_rate": _rate(F.col("materialized"), F.col("with_candidates")),
        }
    )


def field_counts(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``field, value, n``: rows by each field; nulls are not counted."""
    pairs = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))) for f in fields]))
    return rows.select(F.explode(pairs).alias("p")).groupBy(F.col("p.field").alias("field"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"))


def zip_scores(explanations: DataFrame, scores: DataFrame, key: str, place: str) -> DataFrame:
    """Explanations with their scores, by key and place; one without its counterpart is an error when it is read."""
    a, b = explanations.withColumn("__a", F.lit(True)), scores.withColumn("__b", F.lit(True))
    both = a.join(b, [key, place], "full_outer")
    whole = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    lone = F.raise_error(F.concat(F.lit("no counterpart: "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit("/"), F.coalesce(F.col(place).cast("string"), F.lit("null"))))
    return both.withColumn("__ok", F.when(whole, F.lit(True)).otherwise(lone.cast("boolean"))).where("__ok").drop("__a", "__b", "__ok")


def quote_report(rows: DataFrame) -> DataFrame:
    """Quotes found over quotes there are, over all explanations; 0 without any."""
    found = verify_quotes(rows)
    sums = found.agg(F.count("*").alias("samples"), F.coalesce(F.sum("quotes_found"), F.lit(0)).alias("quotes_found"), F.coalesce(F.sum(F.col("quotes_found") + F.col("quotes_missing")), F.lit(0)).alias("quotes_total"))
    return sums.withColumn("quote_rate", _rate(F.col("quotes_found"), F.col("quotes_total"), DIGITS))


def multi_metric_report(explanations: DataFrame, claims: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one for each ``by``): quotes found, claims that pass, whole explanations that pass.

    ``explanations``: ``explanation_id, explanation, evidence_texts, score``; ``claims``:
    ``explanation_id, score``.  An explanation without claims counts with its own score.
    """
    keys = ["explanation_id", *by]
    quotes = verify_quotes(explanations).select(*keys, "score", "quotes_found", (F.col("quotes_found") + F.col("quotes_missing")).alias("quotes"))
    ok = F.col("score") >= threshold
    per = claims.groupBy("explanation_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("p"), F.sum("score").alias("s"), F.min("score").alias("lo"))
    rows = quotes.join(per, "explanation_id", "left")
    rows = rows.withColumns({"n": F.coalesce("n", F.lit(1)), "p": F.coalesce("p", ok.cast("long")), "s": F.coalesce("s", "score"), "lo": F.coalesce("lo", "score")})
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("samples"), F.sum("quotes_found").alias("quotes_found"), F.sum("quotes").alias("quotes_total"), F.sum("n").alias("claims"), F.sum("p").alias("__p"), F.sum("s").alias("__s"),
        F.min("lo").alias("claim_min_score"), F.round(F.avg(ok.cast("double")), DIGITS).alias("full_pass_rate"), F.round(F.avg("score"), DIGITS).alias("full_avg_score"),
    )
    rates = {"quote_rate": _rate(F.col("quotes_found"), F.col("quotes_total"), DIGITS), "claim_pass_rate": _rate(F.col("__p"), F.col("claims"), DIGITS), "claim_avg_score": _rate(F.col("__s"), F.col("claims"), DIGITS)}
    return sums.withColumns(rates).drop("__p", "__s")


def slice_report(explanations: DataFrame, claims: DataFrame, slices: Column, threshold: float = 0.5) -> DataFrame:
    """``multi_metric_report`` for each slice of an array column, with refusals, failed ones and the share of all; a row in several slices counts in each."""
    total = explanations.agg(F.count("*").alias("__all"))  # one row
    rows = explanations.withColumn("slice", F.explode(F.array_distinct(slices)))
    report = multi_metric_report(rows, claims, threshold, ("slice",))
    own = rows.groupBy("slice").agg(F.count_if(is_refusal(F.col("explanation"))).alias("refusals"), F.count_if(F.col("score") < threshold).alias("failed"))
    out = report.join(own, "slice").join(F.broadcast(total))
    return out.withColumns({"refusal_rate": _rate(F.col("refusals"), F.col("samples"), DIGITS), "failure_rate": _rate(F.col("failed"), F.col("samples"), DIGITS), "share": _rate(F.col("samples"), F.col("__all"), DIGITS)}).drop("__all")


def case_diagnostics(cases: DataFrame, explanations: DataFrame, evidence_reports: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row a case: its slices, what its explanation does, whether it refuses or fails, its evidence report and its freshness guardrail.

    ``cases``: ``case_id, query``; ``explanations``: ``case_id, explanation, score``;
    ``evidence_reports``: those of ``guardrails.evidence_report``.  Cases without evidence
    have a null report, and ``missing_timestamps`` where the query asks for what is recent.
    """
    from tidemark.functions.text import RECENCY_SLICE
    from tidemark.operators.guardrails import freshness_risk

    rows = cases.join(explanations.select("case_id", "explanation", "score"), "case_id").join(evidence_reports, "case_id", "left").na.fill({"timestamp_available_count": 0})
    rows = rows.withColumns({"query_slice_tags": query_slices(F.col("query")), "refused": is_refusal(F.col("explanation")), "hallucinated": F.col("score") < threshold})
    return freshness_risk(rows, F.array_contains("query_slice_tags", RECENCY_SLICE), observed_explanation(F.col("explanation")))


def non_recommendations(explanations: DataFrame) -> DataFrame:
    """T16 over a table: explanations that refuse or warn."""
    return explanations.where(is_non_recommendation(F.col("explanation")))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
