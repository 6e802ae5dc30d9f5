"""Queries that hold decisions, manifests, settings and values against their rules, over rows of the tables, and the same in SQL.

A row of the events stands for a run: its fields are made of the row's numbers, by
expressions that are written once and read by both sides; what the rules say of them is
worked out by each side for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import validation as V
from tidemark.operators import checks
from tidemark.plans.registry import register
from tidemark.session import table


def _fields(spark, sf: str, fields: dict[str, str]) -> DataFrame:
    return table(spark, sf, "events").selectExpr("event_id", "user_id", *[f"{e} AS {n}" for n, e in fields.items()])


def _sql(fields: dict[str, str], rules: dict[str, str]) -> str:
    """How many rows keep and break each rule; a rule that is unknown is broken."""
    own = ", ".join(f"{e} AS {n}" for n, e in fields.items())
    cells = ", ".join(f"{{'rule': '{n}', 'ok': coalesce({r}, false)}}" for n, r in rules.items())
    return f"WITH r AS (SELECT {own} FROM events), c AS (SELECT unnest([{cells}]) AS c FROM r) SELECT c.rule AS rule, c.ok AS ok, count(*) AS n FROM c GROUP BY ALL"


def _counted(found: DataFrame) -> DataFrame:
    return found.groupBy("rule", "ok").agg(F.count("*").alias("n"))


def _but(expression: str, every: int, of: str = "event_id") -> str:
    """The expression, and null for one row in ``every``."""
    return f"CASE WHEN {of} % {every} <> 0 THEN {expression} END"


def _threshold(name: str, known: str | None = None):
    tokens = F.col(name)
    cell = F.struct(tokens.cast("int").alias("min_tokens"), F.lit(1).alias("min_chunks"), (tokens / 100).alias("min_score"))
    return F.when(tokens.isNotNull(), cell)


def _subsets(name: str, subset: str):
    """An array with the subset, another array, or null, as the flag is true, false or null."""
    return F.when(F.col(name), F.array(F.lit("other"), F.lit(subset))).when(~F.col(name), F.array(F.lit("other")))


_DECISION = "CASE event_id % 5 WHEN 0 THEN 'candidate-promoted' WHEN 1 THEN 'baseline-retained' WHEN 2 THEN 'perhaps' WHEN 3 THEN 'candidate-promoted' END"
_GATE = {
    "bank": "concat('s', CAST(event_id % 2 AS VARCHAR(9)))", "calibration": _but("concat('s', CAST(user_id % 2 AS VARCHAR(9)))", 7), "holdout": _but("concat('s', CAST(event_id % 3 AS VARCHAR(9)))", 11), "limited": _but("user_id % 3 = 0", 4),
    "recommended": _but("20 + 10 * (user_id % 2)", 13), "base": _but("20 + 10 * (event_id % 3)", 17), "candidate": _but("20 + 10 * (event_id % 2)", 19), "used": "20 + 10 * (user_id % 3)",
    "evaluated": _but("event_id % 3 > 0", 8), "eligible": _but("user_id % 5 > 0", 9), "capped": _but("event_id % 6 = 0", 10), "decision": _DECISION,
}
_AS_DECIDED = "CASE decision WHEN 'baseline-retained' THEN base WHEN 'candidate-promoted' THEN candidate END"


@register("gate_decision_checks", _sql(_GATE, {
    "calibration_present": "calibration IS NOT NULL", "calibration_of_this_bank": "calibration = bank", "calibration_unlimited": "limited IS DISTINCT FROM true", "recommended_present": "recommended IS NOT NULL",
    "holdout_present": "holdout IS NOT NULL", "holdout_of_this_bank": "holdout = bank", "baseline_present": "base IS NOT NULL", "candidate_present": "candidate IS NOT NULL", "holdout_evaluated": "evaluated", "holdout_eligible": "eligible",
    "holdout_unlimited": "capped IS DISTINCT FROM true", "recommended_is_candidate": "recommended IS NULL OR candidate IS NULL OR recommended = candidate", "decision_known": "decision IS NULL OR decision <> 'perhaps'",
    "current_as_decided": f"decision IS NULL OR used = {_AS_DECIDED}",
}))
def gate_decision_checks(spark, sf):
    """P25: rules of a gate decision over every run."""
    row = _fields(spark, sf, _GATE).select(
        F.col("bank").alias("query_bank_sha"), F.col("calibration").alias("calibration_sha"), F.col("holdout").alias("holdout_sha"), F.col("limited").alias("calibration_limited"), _threshold("recommended").alias("recommended"),
        _threshold("base").alias("baseline"), _threshold("candidate").alias("candidate"), _threshold("used").alias("current"), _subsets("evaluated", checks.HOLDOUT).alias("evaluated_subsets"), _subsets("eligible", checks.HOLDOUT).alias("eligible_subsets"),
        _subsets("capped", checks.HOLDOUT).alias("limited_subsets"), "decision",
    )
    return _counted(checks.gate_decision(row))


def _setting(name: str):
    """A retrieval setting from its number: an aggregation and a least rating."""
    k = F.col(name)
    return F.when(k.isNotNull(), F.struct(F.element_at(F.array(F.lit("max"), F.lit("mean"), F.lit("weighted_mean")), (k % 3 + 1).cast("int")).alias("aggregation"), F.when(k > 1, k.cast("double")).alias("min_rating")))


_RETRIEVAL = {
    "bank": "concat('s', CAST(event_id % 2 AS VARCHAR(9)))", "fit": _but("concat('s', CAST(user_id % 2 AS VARCHAR(9)))", 7), "hold": _but("concat('s', CAST(event_id % 3 AS VARCHAR(9)))", 11), "aligned": _but("user_id % 4 > 0", 12),
    "fit_role": "CASE user_id % 3 WHEN 0 THEN 'fit' WHEN 1 THEN 'holdout' END", "hold_role": "CASE event_id % 3 WHEN 0 THEN 'fit' WHEN 1 THEN 'holdout' END", "fit_base": _but("user_id % 4", 13), "fit_candidate": _but("event_id % 4", 14),
    "base": _but("user_id % 2", 15), "candidate": _but("event_id % 4", 16), "used": "event_id % 4", "fit_on": _but("event_id % 3 > 0", 8), "hold_on": _but("user_id % 5 > 0", 9), "fit_capped": _but("event_id % 6 = 0", 10),
    "hold_capped": _but("user_id % 6 = 0", 5), "decision": _DECISION,
}


@register("retrieval_decision_checks", _sql(_RETRIEVAL, {
    "fit_of_this_bank": "fit = bank", "holdout_of_this_bank": "hold = bank", "corpus_aligned": "aligned", "fit_role": "fit_role = 'fit'", "holdout_role": "hold_role = 'holdout'", "fit_baseline_present": "fit_base IS NOT NULL",
    "fit_candidate_present": "fit_candidate IS NOT NULL", "holdout_baseline_present": "base IS NOT NULL", "holdout_candidate_present": "candidate IS NOT NULL", "fit_evaluated": "fit_on", "holdout_evaluated": "hold_on",
    "fit_unlimited": "fit_capped IS NULL", "holdout_unlimited": "hold_capped IS DISTINCT FROM true", "same_baseline": "fit_base IS NULL OR base IS NULL OR fit_base = base", "same_candidate": "fit_candidate IS NULL OR candidate IS NULL OR fit_candidate = candidate",
    "decision_known": "decision IS NULL OR decision <> 'perhaps'", "current_as_decided": f"decision IS NULL OR used = {_AS_DECIDED}",
}))
def retrieval_decision_checks(spark, sf):
    """Rules of a retrieval decision over every run."""
    row = _fields(spark, sf, _RETRIEVAL).select(
        F.col("bank").alias("query_bank_sha"), F.col("fit").alias("fit_sha"), F.col("hold").alias("holdout_sha"), F.col("aligned").alias("corpus_aligned"), "fit_role", F.col("hold_role").alias("holdout_role"), _setting("fit_base").alias("fit_baseline"),
        _setting("fit_candidate").alias("fit_candidate"), _setting("base").alias("holdout_baseline"), _setting("candidate").alias("holdout_candidate"), _setting("used").alias("current"), _subsets("fit_on", checks.FIT).alias("fit_subsets"),
        _subsets("hold_on", checks.HOLDOUT).alias("holdout_subsets"), _subsets("fit_capped", checks.FIT).alias("fit_limited"), _subsets("hold_capped", checks.HOLDOUT).alias("holdout_limited"), "decision",
    )
    return _counted(checks.retrieval_decision_checks(row))


_HANDOFF = {
    "decision": _DECISION, "found": "CASE user_id % 4 WHEN 0 THEN 'candidate-promoted' WHEN 1 THEN 'baseline-retained' WHEN 2 THEN 'later' END", "threshold": _but("20 + 10 * (event_id % 2)", 7), "setting": _but("event_id % 4", 8),
    "materialized": _but("user_id % 4", 9), "print": "CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN '' ELSE concat('f', CAST(event_id % 3 AS VARCHAR(9))) END", "base": _but("20 + 10 * (user_id % 2)", 11), "candidate": _but("20 + 10 * (event_id % 2)", 12),
    "setting_base": _but("event_id % 4", 13), "setting_candidate": _but("user_id % 4", 14), "used": "20 + 10 * (event_id % 3)", "setting_used": "event_id % 4", "anchor": _but("concat('f', CAST(user_id % 3 AS VARCHAR(9)))", 15),
}
_SETTLED = "CASE found WHEN 'baseline-retained' THEN setting_base WHEN 'candidate-promoted' THEN setting_candidate END"


@register("handoff_checks", _sql(_HANDOFF, {
    "decision_valid": "decision IN ('baseline-retained', 'candidate-promoted')", "retrieval_decision_valid": "found IN ('baseline-retained', 'candidate-promoted')", "threshold_present": "threshold IS NOT NULL", "retrieval_present": "setting IS NOT NULL",
    "threshold_as_decided": f"threshold IS NULL OR {_AS_DECIDED} IS NULL OR threshold = {_AS_DECIDED}", "retrieval_as_decided": f"setting IS NULL OR {_SETTLED} IS NULL OR setting = {_SETTLED}", "current_threshold": "threshold IS NULL OR used = threshold",
    "current_retrieval": "setting IS NULL OR setting_used = setting", "materialized_retrieval_present": "materialized IS NOT NULL", "materialized_retrieval_as_decided": "materialized IS NULL OR setting IS NULL OR materialized = setting",
    "fingerprint_present": "print <> ''", "fingerprint_of_anchor": "print = anchor",
}))
def handoff_checks(spark, sf):
    """Rules of a hand-off manifest over every run."""
    row = _fields(spark, sf, _HANDOFF).select(
        "decision", F.col("found").alias("retrieval_decision"), _threshold("threshold").alias("threshold"), _setting("setting").alias("retrieval"), _setting("materialized").alias("materialized_retrieval"), F.col("print").alias("corpus_fingerprint"),
        _threshold("base").alias("baseline"), _threshold("candidate").alias("candidate"), _setting("setting_base").alias("retrieval_baseline"), _setting("setting_candidate").alias("retrieval_candidate"), _threshold("used").alias("current"),
        _setting("setting_used").alias("current_retrieval"), F.col("anchor").alias("anchor_fingerprint"),
    )
    return _counted(checks.handoff(row))


_RUN = {"place": "event_id", "provider": "CASE event_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN concat(' ', upper(event_type)) WHEN 2 THEN NULL ELSE event_type END", "model": "CASE WHEN event_id % 4 < 2 THEN '' ELSE concat('m', CAST(user_id AS VARCHAR(20)), ' ') END"}


@register("run_identity", f"WITH r AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _RUN.items())} FROM events), s AS (SELECT place, nullif(lower(trim(provider)), '') AS provider, nullif(trim(model), '') AS model FROM r) SELECT coalesce((SELECT arg_min(provider, place) FROM s WHERE provider IS NOT NULL AND model IS NOT NULL), (SELECT arg_min(provider, place) FROM s WHERE provider IS NOT NULL), 'none') AS provider, coalesce((SELECT arg_min(model, place) FROM s WHERE provider IS NOT NULL AND model IS NOT NULL), (SELECT arg_min(model, place) FROM s WHERE model IS NOT NULL), 'unknown') AS model")
def run_identity(spark, sf):
    """The first event that names a provider and a model."""
    return checks.run_identity(_fields(spark, sf, _RUN).select("place", "provider", "model"), "none")


_PROFILE = {"min_rating": "CASE WHEN event_id % 3 <> 0 THEN CAST(user_id % 13 AS DOUBLE) / 2 - 2 END", "aggregation": "CASE event_id % 4 WHEN 0 THEN 'max' WHEN 1 THEN 'mean' WHEN 2 THEN 'Weighted Mean' ELSE concat(event_type, '-of ') END"}


@register("profile_labels", f"""WITH r AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _PROFILE.items())} FROM events),
s AS (SELECT *, CASE WHEN min_rating IS NOT NULL THEN 'rating_gte_' || CASE WHEN min_rating < 0 THEN 'neg_' ELSE '' END || CAST(CAST(floor(abs(min_rating)) AS BIGINT) AS VARCHAR) || CASE WHEN abs(min_rating) % 1 > 0 THEN '_5' ELSE '' END END AS a,
CASE WHEN aggregation <> 'max' THEN 'aggregation_' || trim(regexp_replace(lower(aggregation), '[^a-z0-9]+', '_', 'g'), '_') END AS b FROM r) SELECT min_rating, aggregation, coalesce(nullif(concat_ws('_', a, b), ''), 'eval_unfiltered') AS label, count(*) AS n FROM s GROUP BY ALL""")
def profile_labels(spark, sf):
    """The label of each event's settings, and how many have it."""
    rows = _fields(spark, sf, _PROFILE)
    return rows.groupBy("min_rating", "aggregation", T.infer_profile(F.col("min_rating"), F.col("aggregation")).alias("label")).agg(F.count("*").alias("n"))


_MS = {
    "literal": "CASE event_id % 12 WHEN 0 THEN CAST(event_id AS VARCHAR(20)) WHEN 1 THEN concat('-', CAST(event_id AS VARCHAR(20))) WHEN 2 THEN concat('\"', CAST(event_id AS VARCHAR(20)), '\"') WHEN 3 THEN concat('\" ', CAST(user_id AS VARCHAR(20)), ' \"') "
    "WHEN 4 THEN concat('\"', event_type, '\"') WHEN 5 THEN 'true' WHEN 6 THEN NULL WHEN 7 THEN concat(CAST(event_id AS VARCHAR(20)), '.75') WHEN 8 THEN concat(CAST(user_id AS VARCHAR(20)), 'e3') WHEN 9 THEN 'NaN' WHEN 10 THEN '\"\"' ELSE concat('\"-', CAST(user_id AS VARCHAR(20)), '\"') END"
}


@register("coerced_timestamps", f"""WITH r AS (SELECT event_id, {_MS['literal']} AS literal FROM events), s AS (SELECT *, CASE WHEN regexp_full_match(literal, '"\\s*[0-9]+\\s*"') THEN TRY_CAST(trim(trim(literal, '"')) AS DOUBLE) WHEN regexp_full_match(literal, '-?[0-9]+(\\.[0-9]+)?(e[0-9]+)?') THEN TRY_CAST(literal AS DOUBLE) END AS x FROM r)
SELECT event_id, literal, CASE WHEN floor(x) > 0 THEN CAST(floor(x) AS BIGINT) END AS ms FROM s""")
def coerced_timestamps(spark, sf):
    """D3: a value of each event as milliseconds, where it can stand for some."""
    return _fields(spark, sf, _MS).select("event_id", "literal", T.json_timestamp_ms(F.col("literal")).alias("ms"))


_VALUE = {
    "v": "CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN CAST(event_id AS VARCHAR(20)) WHEN 3 THEN concat('-', CAST(user_id AS VARCHAR(20))) WHEN 4 THEN concat(event_type, '_', CAST(user_id AS VARCHAR(20))) WHEN 5 THEN upper(event_type) "
    "WHEN 6 THEN props WHEN 7 THEN concat('[', props, ']') WHEN 8 THEN concat(CAST(user_id AS VARCHAR(20)), '.5') WHEN 9 THEN CASE WHEN user_id % 2 = 0 THEN 'True' ELSE ' false' END ELSE concat(event_type, '__', event_type) END"
}
_INTEGER = "regexp_full_match(trim(v), '[+-]?[0-9]+')"
_WRONG = {
    "non_empty": "WHEN trim(v) = '' THEN 'empty'", "whole_number": f"WHEN NOT {_INTEGER} THEN 'not an integer'", "positive_number": f"WHEN NOT {_INTEGER} THEN 'not an integer' WHEN CAST(trim(v) AS BIGINT) <= 0 THEN 'not positive'",
    "finite_number": "WHEN TRY_CAST(trim(v) AS DOUBLE) IS NULL THEN 'not a number'", "boolean": "WHEN lower(trim(v)) NOT IN ('true', 'false') THEN 'not a boolean'", "json_object": "WHEN NOT (json_valid(v) AND starts_with(trim(v), '{')) THEN 'not an object'",
    "identifier": "WHEN NOT regexp_full_match(v, '[a-z0-9]+(_[a-z0-9]+)*') THEN 'not an identifier'",
}


@register("validated_values", f"WITH r AS (SELECT event_id, {_VALUE['v']} AS v FROM events) SELECT event_id, " + ", ".join(f"CASE WHEN v IS NULL THEN 'missing' {w} END AS {n}" for n, w in _WRONG.items()) + " FROM r")
def validated_values(spark, sf):
    """every validator over a value of each event."""
    return _fields(spark, sf, _VALUE).select("event_id", *[getattr(V, n)(F.col("v")).alias(n) for n in _WRONG])
