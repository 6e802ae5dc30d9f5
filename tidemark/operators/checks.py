"""Promotion, consistency and alignment as check tables: one row a rule, a status over them.

Artifacts are one-row tables of the fields that rules look at; a field that an artifact
lacks is null.  Rules are made of expressions over them, so that every check is one
projection, and what fails can be counted, listed or joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import is_non_recommendation

# Decisions, the retrieval profile's fields, and the floors of a reportable run.
DECISIONS = ("baseline-retained", "candidate-promoted")
HOLDOUT, FIT = "retrieval_dev_holdout", "gate_calibration"
MIN_NDCG, MIN_FAITHFULNESS, TOLERANCE_S = 0.10, 0.85, 1.0


def rules(row: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``rule, ok`` of each named check over a one-row table; a check that is null has failed."""
    cells = [F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in checks.items()]
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def verdict(checked: DataFrame) -> DataFrame:
    """One row: the number of failed rules, their names in order, and whether none failed."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("rule"))))
    return checked.agg(F.count_if(~F.col("ok")).alias("failed"), F.array_join(failed, ",").alias("failed_rules")).withColumn("ready", F.col("failed") == 0)


def same_threshold(a: Column, b: Column) -> Column:
    """Whether two thresholds (structs ``min_tokens, min_chunks, min_score``) are there and equal."""
    return a.isNotNull() & b.isNotNull() & (a["min_tokens"] == b["min_tokens"]) & (a["min_chunks"] == b["min_chunks"]) & (F.abs(a["min_score"] - b["min_score"]) < 1e-9)


def expected_of(decision: Column, baseline: Column, candidate: Column) -> Column:
    """What a decision says is in use; null without a valid decision."""
    return F.when(decision == DECISIONS[0], baseline).when(decision == DECISIONS[1], candidate)


def gate_decision(row: DataFrame) -> DataFrame:
    """P25: whether calibration and hold-out support a gate decision.

    ``row``: ``query_bank_sha, calibration_sha, holdout_sha, calibration_limited,
    recommended, baseline, candidate, current`` (thresholds), ``evaluated_subsets,
    eligible_subsets, limited_subsets`` (arrays), ``decision`` (null before there is one).
    """
    c = F.col
    expected = expected_of(c("decision"), c("baseline"), c("candidate"))
    return rules(
        row,
        {
            "calibration_present": c("calibration_sha").isNotNull(),
            "calibration_of_this_bank": c("calibration_sha") == c("query_bank_sha"),
            "calibration_unlimited": ~F.coalesce("calibration_limited", F.lit(False)),
            "recommended_present": c("recommended").isNotNull(),
            "holdout_present": c("holdout_sha").isNotNull(),
            "holdout_of_this_bank": c("holdout_sha") == c("query_bank_sha"),
            "baseline_present": c("baseline").isNotNull(),
            "candidate_present": c("candidate").isNotNull(),
            "holdout_evaluated": F.array_contains("evaluated_subsets", HOLDOUT),
            "holdout_eligible": F.array_contains("eligible_subsets", HOLDOUT),
            "holdout_unlimited": ~F.coalesce(F.array_contains("limited_subsets", HOLDOUT), F.lit(False)),
            "recommended_is_candidate": c("recommended").isNull() | c("candidate").isNull() | same_threshold(c("recommended"), c("candidate")),
            "decision_known": c("decision").isNull() | c("decision").isin(*DECISIONS),
            "current_as_decided": c("decision").isNull() | same_threshold(c("current"), expected),
        },
    )


def retrieval_decision_checks(row: DataFrame) -> DataFrame:
    """Whether fit and hold-out comparisons support a retrieval decision.

    ``row``: ``query_bank_sha, fit_sha, holdout_sha, corpus_aligned, fit_role,
    holdout_role, fit_subsets, holdout_subsets, fit_limited, holdout_limited`` (arrays),
    ``fit_baseline, fit_candidate, holdout_baseline, holdout_candidate, current``
    (configurations as structs), ``decision``.
    """
    c = F.col
    expected = expected_of(c("decision"), c("holdout_baseline"), c("holdout_candidate"))
    agree = lambda a, b: c(a).isNull() | c(b).isNull() | (c(a) == c(b))
    return rules(
        row,
        {
            "fit_of_this_bank": c("fit_sha") == c("query_bank_sha"),
            "holdout_of_this_bank": c("holdout_sha") == c("query_bank_sha"),
            "corpus_aligned": c("corpus_aligned"),
            "fit_role": c("fit_role") == "fit",
            "holdout_role": c("holdout_role") == "holdout",
            "fit_baseline_present": c("fit_baseline").isNotNull(),
            "fit_candidate_present": c("fit_candidate").isNotNull(),
            "holdout_baseline_present": c("holdout_baseline").isNotNull(),
            "holdout_candidate_present": c("holdout_candidate").isNotNull(),
            "fit_evaluated": F.array_contains("fit_subsets", FIT),
            "holdout_evaluated": F.array_contains("holdout_subsets", HOLDOUT),
            "fit_unlimited": F.coalesce(F.size("fit_limited"), F.lit(0)) <= 0,
            "holdout_unlimited": ~F.coalesce(F.array_contains("holdout_limited", HOLDOUT), F.lit(False)),
            "same_baseline": agree("fit_baseline", "holdout_baseline"),
            "same_candidate": agree("fit_candidate", "holdout_candidate"),
            "decision_known": c("decision").isNull() | c("decision").isin(*DECISIONS),
            "current_as_decided": c("decision").isNull() | (c("current") == expected),
        },
    )


def handoff(row: DataFrame) -> DataFrame:
    """Whether a frozen hand-off manifest still holds.

    ``row``: ``decision, retrieval_decision``, the manifest's ``threshold, retrieval,
    materialized_retrieval, corpus_fingerprint``, the decisions' ``baseline, candidate,
    retrieval_baseline, retrieval_candidate``, what is in use, ``current,
    current_retrieval``, and ``anchor_fingerprint``.
    """
    c = F.col
    gate = expected_of(c("decision"), c("baseline"), c("candidate"))
    retrieval = expected_of(c("retrieval_decision"), c("retrieval_baseline"), c("retrieval_candidate"))
    unknown_or = lambda a, b, same: a.isNull() | b.isNull() | same
    return rules(
        row,
        {
            "decision_valid": c("decision").isin(*DECISIONS),
            "retrieval_decision_valid": c("retrieval_decision").isin(*DECISIONS),
            "threshold_present": c("threshold").isNotNull(),
            "retrieval_present": c("retrieval").isNotNull(),
            "threshold_as_decided": unknown_or(c("threshold"), gate, same_threshold(c("threshold"), gate)),
            "retrieval_as_decided": unknown_or(c("retrieval"), retrieval, c("retrieval") == retrieval),
            "current_threshold": c("threshold").isNull() | same_threshold(c("current"), c("threshold")),
            "current_retrieval": c("retrieval").isNull() | (c("current_retrieval") == c("retrieval")),
            "materialized_retrieval_present": c("materialized_retrieval").isNotNull(),
            "materialized_retrieval_as_decided": unknown_or(c("materialized_retrieval"), c("retrieval"), c("materialized_retrieval") == c("retrieval")),
            "fingerprint_present": F.length("corpus_fingerprint") > 0,
            "fingerprint_of_anchor": c("corpus_fingerprint") == c("anchor_fingerprint"),
        },
    )


def artifact_inventory(expected: DataFrame, found: DataFrame, run_started: Column | None = None, tolerance_s: float = TOLERANCE_S) -> DataFrame:
    """``artifact, present, fresh_for_run, valid, ready`` of each expected artifact.

    ``found``: ``artifact, modified`` (a time) and ``errors``, the number of what its
    validator found.  Fresh is what was written no more than ``tolerance_s`` before the run
    began, null without a run; an artifact is ready if it is there, fresh and without errors.
    """
    rows = expected.select("artifact").distinct().join(found, "artifact", "left")
    present = F.col("modified").isNotNull()
    fresh = F.lit(None).cast("boolean") if run_started is None else present & F.coalesce(F.unix_micros("modified") >= F.unix_micros(run_started) - int(tolerance_s * 1_000_000), F.lit(False))
    rows = rows.withColumns({"present": present, "fresh_for_run": fresh, "valid": present & (F.coalesce("errors", F.lit(0)) == 0)})
    return rows.select("artifact", "present", "fresh_for_run", "valid", (F.col("valid") & F.coalesce("fresh_for_run", F.lit(True))).alias("ready"))


def promotion_gate(inventory: DataFrame, results: DataFrame) -> DataFrame:
    """One row: whether a run is complete, safe and reportable, and why not.

    ``results``: ``boundary_status, ndcg, faithfulness, faithfulness_target, sample_limited,
    generation_limited`` of the run, null where an artifact lacks them.
    """
    sums = inventory.agg(F.count("*").alias("total"), F.count_if("present").alias("present"), F.count_if("ready").alias("ready"))
    row = sums.join(F.broadcast(results))  # one row each
    complete = (F.col("ready") == F.col("total")) & (F.col("total") > 0)
    execution = F.when(F.col("present") == 0, "not_started").when(complete, "complete").otherwise("incomplete")
    safe = F.coalesce(F.col("boundary_status") == "pass", F.lit(False))
    target = F.coalesce("faithfulness_target", F.lit(MIN_FAITHFULNESS))
    reasons = F.array_compact(
        F.array(
            F.when(~complete, "execution"), F.when(~safe, "safety"), F.when(F.col("ndcg").isNull(), "ndcg_missing"), F.when(F.col("ndcg") < MIN_NDCG, "ndcg_low"),
            F.when(F.col("faithfulness").isNull(), "faithfulness_missing"), F.when(F.col("faithfulness") < target, "faithfulness_low"),
            F.when(F.col("sample_limited").isNull(), "scope_missing"), F.when(F.col("sample_limited"), "sampled"), F.when(F.col("generation_limited"), "not_every_case"),
        )
    )
    row = row.withColumns({"execution_status": execution, "safety_status": F.coalesce("boundary_status", F.lit("not_available")), "reasons": F.array_join(reasons, ",")})
    return row.select("execution_status", complete.alias("execution_complete"), "safety_status", safe.alias("safety_green"), "reasons", (F.col("reasons") == "").alias("reportable"))


def anchor_alignment(local: DataFrame, remote: DataFrame, points: DataFrame, require_remote: bool = True) -> DataFrame:
    """One row: whether the corpus at hand, its anchor and the collection are the same.

    ``local``: ``fingerprint, chunk_count``; ``remote``: ``fingerprint, stamped_at``, or no row;
    ``points``: ``points_count`` of the collection.  ``status`` is ``aligned``, or the first
    reason against it: ``count_unknown``, ``count_differs``, ``no_remote_anchor``,
    ``fingerprint_differs``.
    """
    far = remote.agg(F.count("*").alias("n"), F.first("fingerprint").alias("remote_fingerprint"), F.max("stamped_at").alias("stamped_at"))  # one row
    row = local.join(F.broadcast(far)).join(F.broadcast(points))
    status = (
        F.when(F.col("chunk_count").isNull() | F.col("points_count").isNull(), "count_unknown")
        .when(F.col("chunk_count") != F.col("points_count"), "count_differs")
        .when(F.lit(require_remote) & (F.col("n") == 0), "no_remote_anchor")
        .when((F.col("n") > 0) & ~F.col("remote_fingerprint").eqNullSafe(F.col("fingerprint")), "fingerprint_differs")
        .otherwise("aligned")
    )
    return row.select("fingerprint", "chunk_count", "points_count", (F.col("n") > 0).alias("remote_anchor_present"), "remote_fingerprint", "stamped_at", status.alias("status"))


def stamp(anchors: DataFrame, collection: str, local: DataFrame, at: Column) -> DataFrame:
    """The table of anchors (``collection, fingerprint, chunk_count, stamped_at``) with this collection's stamped anew."""
    new = local.select(F.lit(collection).alias("collection"), "fingerprint", "chunk_count", at.alias("stamped_at"))
    return anchors.where(F.col("collection") != collection).unionByName(new)


def run_identity(candidates: DataFrame, default_provider: str) -> DataFrame:
    """One row: the first candidate in order with provider and model; else the first provider there is, and the first model.

    ``candidates``: ``place, provider, model``, blank ones count as none.
    """
    said = lambda c: F.when(F.trim(F.col(c)) != "", F.lower(F.trim(F.col(c))) if c == "provider" else F.trim(F.col(c)))
    rows = candidates.select("place", said("provider").alias("provider"), said("model").alias("model"))
    whole = F.col("provider").isNotNull() & F.col("model").isNotNull()
    first = lambda c, of: F.min_by(c, F.when(of, F.col("place")))
    sums = rows.agg(first("provider", whole).alias("p"), first("model", whole).alias("m"), first("provider", F.col("provider").isNotNull()).alias("p1"), first("model", F.col("model").isNotNull()).alias("m1"), F.count_if(whole).alias("n"))
    return sums.select(F.when(F.col("n") > 0, F.col("p")).otherwise(F.coalesce("p1", F.lit(default_provider))).alias("provider"), F.when(F.col("n") > 0, F.col("m")).otherwise(F.coalesce("m1", F.lit("unknown"))).alias("model"))


def frozen_reference(manifest: DataFrame, column: str = "frozen_at_ms") -> int:
    """The time, in milliseconds, that ages are counted back from: the manifest's, not now."""
    row = manifest.agg(F.max(column)).first()
    if row is None or row[0] is None:
        raise ValueError(f"the manifest has no {column}")
    return int(row[0])


def response_quality(responses: DataFrame, explain: bool = True) -> DataFrame:
    """``responses`` with ``grounded_success`` and ``refusal_aware_success``; both null without explanations.

    ``responses``: ``policy_behavior`` (null where no policy ended the request) and
    ``recommendations``, an array of structs ``explanation, citations_verified, is_grounded``.
    A policy's refusal, question or hedge succeeds as such; no recommendations is no success;
    else all must be grounded, or grounded or valid refusals.
    """
    if not explain:
        return responses.withColumns({"grounded_success": F.lit(None).cast("boolean"), "refusal_aware_success": F.lit(None).cast("boolean")})
    recs = F.col("recommendations")
    some = F.coalesce(F.size(recs), F.lit(0)) > 0
    said = lambda r: F.coalesce(F.trim(r["explanation"]) != "", F.lit(False))
    grounded = lambda r: said(r) & F.coalesce(r["citations_verified"], F.lit(False)) & F.coalesce(r["is_grounded"], F.lit(False))
    valid = lambda r: grounded(r) | (said(r) & is_non_recommendation(F.coalesce(r["explanation"], F.lit(""))))
    policy = F.coalesce(F.col("policy_behavior").isin("refuse", "clarify", "hedge"), F.lit(False))
    return responses.withColumns({"grounded_success": ~policy & some & F.coalesce(F.forall(recs, grounded), F.lit(False)), "refusal_aware_success": policy | (some & F.coalesce(F.forall(recs, valid), F.lit(False)))})
