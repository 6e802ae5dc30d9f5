"""Evidence age, freshness and behaviour guardrails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import age_days, iso_date

RECENT, OLD, VERY_OLD = 30, 365, 1095


def age_bucket(age: Column, old: int = OLD, very_old: int = VERY_OLD) -> Column:
    """The name of an age's bucket."""
    return (
        F.when(age.isNull(), "missing_timestamp").when(age <= RECENT, f"lte_{RECENT}_days").when(age <= old, f"days_{RECENT + 1}_to_{old}").when(age <= very_old, f"days_{old + 1}_to_{very_old}").otherwise(f"gt_{very_old}_days")
    )


def age_histogram(evidence: DataFrame, reference_ms: int, key: str | None = None) -> DataFrame:
    """Pieces of evidence by age bucket."""
    rows = evidence.withColumn("bucket", age_bucket(age_days(F.col("timestamp_ms"), reference_ms)))
    return rows.groupBy(*([key] if key else []), "bucket").agg(F.count("*").alias("n"))


def evidence_report(evidence: DataFrame, reference_ms: int, key: str = "case_id", old: int = OLD, very_old: int = VERY_OLD) -> DataFrame:
    """For each case, the age, verification and ratings of its evidence, with the number of pieces in each age bucket.

    Needs ``timestamp_ms``, ``rating`` and ``verified_purchase``, any of them null.  Rates
    are rounded to four digits, ages to one.
    """
    age = age_days(F.col("timestamp_ms"), reference_ms)
    timed = F.count("timestamp_ms")
    rate = lambda a, b: F.round(F.try_divide(a.cast("double"), b), 4)
    return evidence.groupBy(key).agg(
        F.count("*").alias("evidence_chunk_count"), timed.alias("timestamp_available_count"), rate(timed, F.count("*")).alias("timestamp_available_rate"),
        iso_date(F.min("timestamp_ms")).alias("evidence_date_min"), iso_date(F.max("timestamp_ms")).alias("evidence_date_max"),
        F.round(F.percentile(age, 0.5), 1).alias("median_evidence_age_days"), F.round(F.max(age), 1).alias("max_evidence_age_days"),
        F.count_if(age > old).alias("old_review_count"), rate(F.count_if(age > old), timed).alias("old_review_share"),
        F.count_if(age > very_old).alias("very_old_review_count"), rate(F.count_if(age > very_old), timed).alias("very_old_review_share"),
        ((timed > 0) & (F.count_if(age > old) == timed)).alias("all_timestamped_evidence_old"),
        F.count("verified_purchase").alias("verified_purchase_available_count"), rate(F.count_if(F.col("verified_purchase")), F.count("verified_purchase")).alias("verified_purchase_true_rate"),
        F.count("rating").alias("rating_available_count"), F.count_if(F.col("rating") <= 2).alias("negative_review_count"), rate(F.count_if(F.col("rating") <= 2), F.count("rating")).alias("negative_review_rate"),
        (F.count_if(F.col("rating") <= 2) > 0).alias("has_negative_review_evidence"),
        F.lit(reference_ms).alias("reference_timestamp_ms"), iso_date(F.lit(reference_ms)).alias("reference_date"), F.min("timestamp_ms").alias("evidence_timestamp_min"), F.max("timestamp_ms").alias("evidence_timestamp_max"),
        F.lit(old).alias("old_review_days_threshold"), F.lit(very_old).alias("very_old_review_days_threshold"), F.count_if("verified_purchase").alias("verified_purchase_true_count"),
        rate(F.count("verified_purchase"), F.count("*")).alias("verified_purchase_available_rate"), F.count_if(F.col("timestamp_ms").isNull()).alias("missing_timestamp_count"), F.count_if(age <= RECENT).alias("recent_count"),
        F.count_if((age > RECENT) & (age <= old)).alias("within_old_count"), F.count_if((age > old) & (age <= very_old)).alias("within_very_old_count"), F.count_if(age > very_old).alias("beyond_very_old_count"),
    )


def report_summary(reports: DataFrame) -> DataFrame:
    """Roll-up of case reports; means over the cases that have a value."""
    mean = lambda c, d: F.round(F.avg(c), d).alias(f"{c}_mean")
    return reports.agg(
        F.count("*").alias("report_count"), F.sum("evidence_chunk_count").alias("total_evidence_chunks"), F.count_if(F.col("timestamp_available_count") > 0).alias("cases_with_any_timestamp_count"),
        F.count_if("all_timestamped_evidence_old").alias("cases_all_timestamped_evidence_old_count"), F.count_if("has_negative_review_evidence").alias("cases_with_negative_review_evidence_count"),
        mean("timestamp_available_rate", 4), mean("median_evidence_age_days", 1), mean("old_review_share", 4), mean("very_old_review_share", 4), mean("verified_purchase_true_rate", 4), mean("negative_review_rate", 4),
    )


def freshness_risk(reports: DataFrame, recency_sensitive: Column, behavior: Column) -> DataFrame:
    """Each case's risk level, whether the guardrail applies, and whether the behaviour is safe (hedges or refuses when stale)."""
    level = F.when(F.col("timestamp_available_count") == 0, "missing_timestamps").when(F.col("very_old_review_share") >= 1.0, "very_stale").when(F.col("all_timestamped_evidence_old"), "stale").otherwise("fresh_enough")
    level = F.when(~recency_sensitive, "not_applicable").otherwise(level)
    rows = reports.withColumns({"risk_level": level, "behavior": behavior})
    applies = F.col("risk_level").isin("missing_timestamps", "very_stale", "stale")
    return rows.withColumn("applicable", applies).withColumn("violation", applies & ~F.col("behavior").isin("hedge", "refuse"))


def freshness_summary(cases: DataFrame, least_cases: int = 3, most_violations: float = 0.0) -> DataFrame:
    """Counts, safe and violation rates, what coverage lacks, and promotion status."""
    sums = cases.agg(F.count("*").alias("cases"), F.count_if(F.col("risk_level") != "not_applicable").alias("recency_sensitive"), F.count_if("applicable").alias("applicable_cases"), F.count_if("violation").alias("violations"))
    rate = lambda a: F.round(F.try_divide(a.cast("double"), F.col("applicable_cases")), 4)
    few, idle = F.col("recency_sensitive") < least_cases, F.col("applicable_cases") < least_cases
    sums = sums.withColumns({"safe_cases": F.col("applicable_cases") - F.col("violations"), "violation_rate": rate(F.col("violations")), "safe_rate": rate(F.col("applicable_cases") - F.col("violations"))})
    lacks = F.concat_ws(",", F.when(few, "too_few_recency_sensitive_cases"), F.when(idle, "too_few_applicable_cases"))
    status = F.when(few | idle, "insufficient_coverage").when(F.col("violation_rate") > most_violations, "blocked").otherwise("pass")
    return sums.withColumns({"coverage_failure_reasons": lacks, "promotion_status": status})


def freshness_counters(cases: DataFrame) -> DataFrame:
    """``counter, value, n``: applicable cases by risk and by behaviour, recency-sensitive ones by risk."""
    applies, recent = F.col("applicable"), F.col("risk_level") != "not_applicable"
    pair = lambda of, name, c: F.when(of, F.struct(F.lit(name).alias("counter"), F.col(c).alias("value")))
    pairs = F.array_compact(F.array(pair(applies, "risk_level", "risk_level"), pair(applies, "behavior", "behavior"), pair(recent, "recency_risk_level", "risk_level")))
    return cases.select(F.explode(pairs).alias("p")).groupBy(F.col("p.counter").alias("counter"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"))


BEHAVIORS = ("answer", "clarify", "hedge", "refuse", "error")


def query_behavior(products: DataFrame) -> DataFrame:
    """A query's behaviour from its products': answer, clarify, hedge, refuse, else error."""
    has = lambda b: F.max((F.col("observed") == b).cast("int")) == 1
    out = F.when(has("answer"), "answer").when(has("clarify"), "clarify").when(has("hedge"), "hedge").when(has("refuse"), "refuse").otherwise("error")
    return products.groupBy("query_id").agg(out.alias("observed"))


def behavior_confusion(cases: DataFrame) -> DataFrame:
    """Expected behaviour against observed, a column for each."""
    return cases.groupBy("expected").agg(*[F.count_if(F.col("observed") == b).alias(b) for b in BEHAVIORS])
