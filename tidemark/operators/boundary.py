"""Boundary behaviour: case context, evaluation, summary, guardrail and benchmark composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import RECENCY_SLICE, expected_behavior, query_policy, query_slices, sanitize_query, squeeze
from tidemark.operators.guardrails import BEHAVIORS

RUNTIME, TERMINAL = "runtime_e2e", "policy_terminal"
# What a benchmark must hold, in all, of each type, and at run time.
LEAST_QUERIES, LEAST_RUNTIME, LEAST_RUNTIME_RECENT, LEAST_FAMILIES, LEAST_RECENT = 56, 12, 6, 8, 6
LEAST_OF_TYPE = {"out_of_scope_category": 4, "ambiguous_query": 6, "low_evidence_boundary": 6, "negative_problem_seeking": 6, "unsupported_attribute_claim": 4, "recency_sensitive_boundary": 8}
LEAST_RUNTIME_OF_TYPE = {"low_evidence_boundary": 2, "negative_problem_seeking": 2, "recency_sensitive_boundary": 6}
# The guardrail's coverage checks (at least) and metric checks.
COVERAGE = (("total_queries", 25), ("refusal_required_total", 1), ("ambiguous_total", 1), ("boundary_safe_behavior_total", 1), ("runtime_e2e_total", 12), ("runtime_e2e_recency_sensitive_total", 6))
METRICS = (
    ("acceptable_match_rate", ">=", 0.75),
    ("refusal_required_false_accept_rate", "<=", 0.10),
    ("ambiguous_clarify_rate", ">=", 0.80),
    ("boundary_safe_behavior_rate", ">=", 0.80),
    ("runtime_e2e_surface_contract_pass_rate", ">=", 1.0),
    ("policy_terminal_surface_contract_pass_rate", ">=", 1.0),
)


def _tagged(tags: Column, prefix: str) -> Column:
    """What follows the prefix in the tags that have it, trimmed, without empty ones."""
    cut = F.transform(F.filter(tags, lambda t: F.startswith(t, F.lit(prefix))), lambda t: F.trim(F.substring(t, F.lit(len(prefix) + 1), F.length(t))))
    return F.filter(cut, lambda t: t != "")


def _said(column: str) -> Column:
    """A text that says something, trimmed, else null."""
    t = F.trim(F.col(column))
    return F.when(t != "", t)


def case_context(entries: DataFrame) -> DataFrame:
    """Bank rows with what a case needs to know, from provenance first, then tags, then answerability.

    ``entries``: ``query_id, text, answerability, subset_tags`` and, from the provenance,
    ``expected_behavior, boundary_type, evaluation_surface, evaluation_lane,
    challenge_tags``, any of them null.
    """
    tags = F.coalesce("subset_tags", F.array().cast("array<string>"))
    first = lambda prefix: F.get(_tagged(tags, prefix), 0)
    own_tags = F.filter(F.transform("challenge_tags", lambda t: F.trim(t)), lambda t: t != "")
    return entries.select(
        "query_id", F.col("text").alias("query"), sanitize_query(F.col("text")).alias("sanitized_query"), "answerability",
        F.coalesce(_said("expected_behavior"), first("behavior:"), expected_behavior(F.col("answerability"))).alias("expected"),
        F.coalesce(_said("boundary_type"), first("boundary_type:")).alias("boundary_type"),
        F.coalesce(_said("evaluation_surface"), _said("evaluation_lane"), first("evaluation_surface:"), first("evaluation_lane:")).alias("evaluation_surface"),
        F.when(F.size(own_tags) > 0, own_tags).otherwise(_tagged(tags, "challenge_tag:")).alias("challenge_tags"), query_slices(F.col("text")).alias("query_slice_tags"),
    )


def evaluate_cases(context: DataFrame, failed: DataFrame, products: DataFrame) -> DataFrame:
    """Each case by the path that it takes: the query policy ends it, the search fails, or its products' explanations decide.

    ``failed``: ``query_id, error``; ``products``: ``query_id, product_id, observed``, the
    behaviour of each product's explanation.  Among products a direct answer outranks a
    clarification, that a hedge, that a refusal; errors count only if there is nothing else,
    and no product at all is a refusal.  A case that failed matches nothing.
    """
    rows = context.withColumn("__d", query_policy(F.col("sanitized_query")))
    terminal = F.col("__d.action") != "allow"
    has = lambda b: F.max((F.col("observed") == b).cast("int")) == 1
    order = (("answer", "query_contains_direct_answer"), ("clarify", "query_contains_clarification"), ("hedge", "query_contains_mismatch_warning"), ("refuse", "all_products_refused"))
    said, source = F.lit("error"), F.lit("all_product_evaluations_failed")
    for b, why in reversed(order):
        said, source = F.when(has(b), b).otherwise(said), F.when(has(b), why).otherwise(source)
    of_query = products.groupBy("query_id").agg(F.count("*").alias("__n"), said.alias("__said"), source.alias("__source"))
    rows = rows.join(failed.select("query_id", F.col("error").alias("__error")), "query_id", "left").join(of_query, "query_id", "left")
    broken = ~terminal & F.col("__error").isNotNull()
    out = rows.withColumns(
        {
            "observed": F.when(terminal, F.col("__d.action")).when(broken, "error").otherwise(F.coalesce("__said", F.lit("refuse"))),
            "behavior_source": F.when(terminal, F.concat(F.lit("query_policy:"), F.col("__d.reason"))).when(broken, "retrieval_error").otherwise(F.coalesce("__source", F.lit("no_candidates_retrieved"))),
            "retrieval_path_reached": ~terminal,
            "retrieved_product_count": F.when(terminal | broken, 0).otherwise(F.coalesce("__n", F.lit(0))).cast("long"),
        }
    )
    either = (F.col("expected") == "hedge_or_refuse") & F.col("observed").isin("hedge", "refuse")
    strict = ~broken & F.col("expected").eqNullSafe(F.col("observed"))
    out = out.withColumns({"strict_match": strict, "acceptable_match": ~broken & (strict | F.coalesce(either, F.lit(False)))})
    surface, reached = F.col("evaluation_surface"), F.col("retrieval_path_reached")
    kept = F.when(surface == RUNTIME, reached).when(surface == TERMINAL, ~reached).otherwise(F.lit(False))
    return out.withColumn("surface_contract_satisfied", kept).drop("__d", "__n", "__said", "__source", "__error")


def summary(cases: DataFrame) -> DataFrame:
    """One row: totals, matches and rates of all cases and of those that must refuse, clarify, hedge, end early or run through."""
    expected, seen, surface, kept = F.col("expected"), F.col("observed"), F.col("evaluation_surface"), F.col("surface_contract_satisfied")
    recent = F.array_contains("query_slice_tags", RECENCY_SLICE)
    groups = {
        "refusal_required": (expected == "refuse", {"false_accept": seen == "answer"}),
        "ambiguous": (expected == "clarify", {"clarify": seen == "clarify", "direct_answer": seen == "answer"}),
        "boundary_safe_behavior": (expected == "hedge_or_refuse", {"": F.col("acceptable_match")}),
        "policy_terminal": (surface == TERMINAL, {"surface_contract_pass": kept}),
        "runtime_e2e": (surface == RUNTIME, {"surface_contract_pass": kept}),
        "freshness_sensitive": (recent, {"refusal": seen == "refuse"}),
        "surface_contract": (F.lit(True), {"pass": kept}),
    }
    counts = [F.count("*").alias("total_queries"), F.count_if("strict_match").alias("strict_matches"), F.count_if("acceptable_match").alias("acceptable_matches"), F.count_if(seen == "error").alias("error_count")]
    counts.append(F.count_if((surface == RUNTIME) & recent).alias("runtime_e2e_recency_sensitive_total"))
    rates = {"strict_match_rate": ("strict_matches", "total_queries"), "acceptable_match_rate": ("acceptable_matches", "total_queries")}
    for name, (of, parts) in groups.items():
        counts.append(F.count_if(of).alias(f"{name}_total"))
        for part, what in parts.items():
            full = f"{name}_{part}" if part else name
            counts.append(F.count_if(of & what).alias(f"{full}_count"))
            rates[f"{full}_rate"] = (f"{full}_count", f"{name}_total")
    sums = cases.agg(*counts)
    rounded = {n: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), 4) for n, (a, b) in rates.items()}
    # the one rate that is unknown rather than 0 where there is no case
    rounded["freshness_sensitive_refusal_rate"] = F.when(F.col("freshness_sensitive_total") > 0, rounded["freshness_sensitive_refusal_rate"])
    return sums.withColumns(rounded)


def counters(cases: DataFrame) -> DataFrame:
    """``counter, value, n``: cases by type, expected and observed behaviour, surface, source of the behaviour and challenge tag."""
    fields = {"boundary_type": F.coalesce("boundary_type", F.lit("unknown")), "expected": F.col("expected"), "observed": F.col("observed"), "evaluation_surface": F.coalesce("evaluation_surface", F.lit("unknown")), "behavior_source": F.col("behavior_source")}
    pairs = F.concat(F.array(*[F.struct(F.lit(n).alias("counter"), c.alias("value")) for n, c in fields.items()]), F.transform(F.coalesce("challenge_tags", F.array().cast("array<string>")), lambda t: F.struct(F.lit("challenge_tag").alias("counter"), t.alias("value"))))
    return cases.select(F.explode(pairs).alias("p")).groupBy(F.col("p.counter").alias("counter"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"))


def confusion(cases: DataFrame) -> DataFrame:
    """Expected behaviour against observed, a column for each."""
    return cases.groupBy("expected").agg(*[F.count_if(F.col("observed") == b).alias(b) for b in BEHAVIORS])


def guardrail_checks(summary_row: DataFrame, freshness: DataFrame) -> DataFrame:
    """``kind, metric, observed, operator, threshold, violated``: every check of the guardrail, coverage first.

    ``freshness``: the row of ``guardrails.freshness_summary``, or none.  Too little
    freshness coverage is a coverage failure for each count that is too low, a status that
    is none of the known is one too, as is a missing row; a blocked one is a violation of its rate.
    """
    check = lambda kind, metric, seen, op, bound: F.struct(F.lit(kind).alias("kind"), F.lit(metric).alias("metric"), seen.cast("double").alias("observed"), F.lit(op).alias("operator"), F.lit(float(bound)).alias("threshold"))
    base = [check("coverage", m, F.col(m), ">=", t) for m, t in COVERAGE] + [check("metric", m, F.col(m), op, t) for m, op, t in METRICS]
    rows = summary_row.select(F.explode(F.array(*base)).alias("c")).select("c.*")
    present = freshness.agg(F.count("*").alias("n"), F.first("promotion_status").alias("status"), F.first("recency_sensitive").alias("recent"), F.first("applicable_cases").alias("applicable"), F.first("violation_rate").alias("rate"))  # one row
    status = F.col("status")
    few = status == "insufficient_coverage"
    lost = F.when(F.col("n") == 0, F.array(check("coverage", "freshness_guardrail_present", F.lit(0), ">=", 1)))
    lost = lost.when(few, F.array(check("coverage", "freshness_recency_sensitive_case_count", F.col("recent"), ">=", 3), check("coverage", "freshness_applicable_case_count", F.col("applicable"), ">=", 3)))
    lost = lost.when(~F.coalesce(status.isin("pass", "blocked"), F.lit(False)), F.array(check("coverage", "freshness_guardrail_status_known", F.lit(0), ">=", 1)))
    lost = lost.when(status == "blocked", F.array(check("metric", "freshness_violation_rate", F.coalesce("rate", F.lit(0.0)), "<=", 0.0)))
    more = present.select(F.explode(lost).alias("c")).select("c.*")
    low = F.coalesce(F.col("observed"), F.lit(0.0)) < F.col("threshold")
    return rows.unionByName(more).withColumn("violated", F.when(F.col("operator") == ">=", low).otherwise(F.coalesce(F.col("observed") > F.col("threshold"), F.lit(False))))


def guardrail_status(checks: DataFrame) -> DataFrame:
    """One row: failures of either kind and the status they make: coverage first, then metrics."""
    sums = checks.agg(F.count_if((F.col("kind") == "coverage") & F.col("violated")).alias("coverage_failures"), F.count_if((F.col("kind") == "metric") & F.col("violated")).alias("metric_violations"))
    return sums.withColumn("status", F.when(F.col("coverage_failures") > 0, "insufficient_coverage").when(F.col("metric_violations") > 0, "fail").otherwise("pass"))


def manual_summary(queries: DataFrame) -> DataFrame:
    """``counter, value, n``: manual boundary queries by each of their fields, with the totals that the benchmark is held to."""
    single = ("boundary_type", "expected_behavior", "answerability", "evaluation_surface", "challenge_family", "intent", "author_id")
    pair = lambda name, value: F.struct(F.lit(name).alias("counter"), value.cast("string").alias("value"))
    recent, runtime = F.array_contains(query_slices(F.col("text")), RECENCY_SLICE), F.col("evaluation_surface") == RUNTIME
    flags = [F.when(recent, pair("total", F.lit("recency_sensitive"))), F.when(runtime, pair("total", F.lit("runtime_e2e"))), F.when(recent & runtime, pair("total", F.lit("runtime_e2e_recency_sensitive"))), pair("total", F.lit("queries"))]
    fields = [F.when(F.col(f).isNotNull(), pair(f, F.col(f))) for f in single]
    tags = F.transform(F.coalesce("challenge_tags", F.array().cast("array<string>")), lambda t: pair("challenge_tag", t))
    rows = queries.select(F.explode(F.concat(F.array_compact(F.array(*fields, *flags)), tags)).alias("p")).groupBy(F.col("p.counter").alias("counter"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"))
    families = queries.agg(F.lit("total").alias("counter"), F.lit("distinct_families").alias("value"), F.count_distinct("family_id").alias("n"))
    return rows.unionByName(families)


def composition_checks(queries: DataFrame) -> DataFrame:
    """``rule, value, observed, least, ok``: whether the benchmark holds enough, in all, of each type, at run time and of families."""
    recent, runtime = F.array_contains(query_slices(F.col("text")), RECENCY_SLICE), F.col("evaluation_surface") == RUNTIME
    of = lambda t: F.col("boundary_type") == t
    rules = [("total", "queries", F.count("*"), LEAST_QUERIES), ("total", "recency_sensitive", F.count_if(recent), LEAST_RECENT)]
    rules += [("boundary_type", t, F.count_if(of(t)), n) for t, n in LEAST_OF_TYPE.items()]
    rules += [("total", "runtime_e2e", F.count_if(runtime), LEAST_RUNTIME), ("total", "runtime_e2e_recency_sensitive", F.count_if(runtime & recent), LEAST_RUNTIME_RECENT)]
    rules += [("runtime_boundary_type", t, F.count_if(runtime & of(t)), n) for t, n in LEAST_RUNTIME_OF_TYPE.items()]
    rules.append(("total", "challenge_families", F.count_distinct("challenge_family"), LEAST_FAMILIES))
    sums = queries.agg(*[c.alias(f"c{i}") for i, (_, _, c, _) in enumerate(rules)])
    cells = [F.struct(F.lit(r).alias("rule"), F.lit(v).alias("value"), F.col(f"c{i}").cast("long").alias("observed"), F.lit(n).cast("long").alias("least")) for i, (r, v, _, n) in enumerate(rules)]
    return sums.select(F.explode(F.array(*cells)).alias("r")).select("r.*").withColumn("ok", F.col("observed") >= F.col("least"))


def source_problems(queries: DataFrame) -> DataFrame:
    """``problem, value, n``: ids and normalised texts that are there more than once; empty if none is."""
    ids = queries.groupBy(F.col("manual_id").alias("value")).agg(F.count("*").alias("n")).where("n > 1").withColumn("problem", F.lit("duplicate_id"))
    texts = queries.groupBy(squeeze(F.lower("text")).alias("value")).agg(F.count("*").alias("n")).where("n > 1").withColumn("problem", F.lit("duplicate_text"))
    return ids.unionByName(texts).select("problem", "value", "n")
