"""Verification of explanations and faithfulness statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import placed, running
from tidemark.functions.text import extract_citations, extract_quotes, is_non_recommendation, quote_in


def verify_quotes(rows: DataFrame) -> DataFrame:
    """``explanation``'s quotes against ``evidence_texts``: counts, the missing ones, and whether all are found."""
    found = F.filter("quotes", lambda q: F.exists("evidence_texts", lambda e: quote_in(q, e)))
    out = rows.withColumn("quotes", extract_quotes(F.col("explanation"))).withColumn("verified", found)
    return out.withColumns({"missing": F.array_except("quotes", "verified"), "quotes_found": F.size("verified").cast("long"), "quotes_missing": (F.size("quotes") - F.size("verified")).cast("long")}).withColumn("all_verified", F.col("quotes_missing") == 0)


def verify_citations(rows: DataFrame) -> DataFrame:
    """Cited ids that are evidence, with their quote in a text of that evidence."""
    pairs = F.arrays_zip("evidence_ids", "evidence_texts")
    valid = F.filter("citations", lambda c: F.exists(pairs, lambda e: (e["evidence_ids"] == c["citation_id"]) & (c["quote"].isNull() | quote_in(c["quote"], e["evidence_texts"]))))
    out = rows.withColumn("citations", extract_citations(F.col("explanation"))).withColumn("n_valid", F.size(valid).cast("long"))
    return out.withColumn("n_invalid", F.size("citations").cast("long") - F.col("n_valid")).withColumn("all_valid", F.col("n_invalid") == 0)


def judged_scores(rows: DataFrame, score: str = "score", degraded: str = "degraded", threshold: float = 0.5) -> DataFrame:
    """``rows`` with ``score`` as it counts, 0 where the scorer was degraded, and ``is_hallucinated``, a score under the threshold."""
    counted = F.when(F.coalesce(F.col(degraded), F.lit(False)), F.lit(0.0)).otherwise(F.col(score))
    return rows.withColumn(score, counted).withColumn("is_hallucinated", F.col(score) < threshold)


def claim_report(claims: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Claim scores over all and by explanation: mean, range, pass rate, explanations that pass whole."""
    ok = F.col("score") >= threshold
    per = claims.groupBy("explanation_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("p"), F.sum("score").alias("s"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    return per.agg(
        F.sum("n").alias("claims"), F.count("*").alias("explanations"), F.round(F.sum("s") / F.sum("n"), 6).alias("avg_score"), F.min("lo").alias("min_score"), F.max("hi").alias("max_score"),
        F.round(F.sum("p") / F.sum("n"), 6).alias("pass_rate"), F.count_if(F.col("n") == F.col("p")).alias("all_pass"), F.count_if(F.col("p") < F.col("n")).alias("any_fail"),
    )


def adjusted_faithfulness(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pass rates, raw and with valid non-recommendations as passes."""
    non = is_non_recommendation(F.coalesce("explanation", F.lit("")))
    ok = F.coalesce(F.col("score") >= threshold, F.lit(False))
    sums = rows.agg(F.count("*").alias("n_total"), F.count_if(non).alias("n_refusals"), F.count_if(ok).alias("raw"), F.count_if(ok | non).alias("n_passed"))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n_total")), F.lit(0.0)), 6)
    return sums.select("n_total", "n_refusals", (F.col("n_total") - F.col("n_refusals")).alias("n_evaluated"), share("raw").alias("raw_pass_rate"), share("n_passed").alias("adjusted_pass_rate"), share("n_refusals").alias("refusal_rate"), "n_passed", (F.col("n_total") - F.col("n_passed")).alias("n_failed"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows that have both; 0 if one of them never varies."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def judge_agreement(rows: DataFrame, first: Column, second: Column) -> DataFrame:
    """The two judges' table, agreement rate and Pearson correlation (0 if one never varies)."""
    r = rows.select(first.cast("boolean").alias("a"), second.cast("boolean").alias("b")).where("a is not null and b is not null")
    x, y = F.col("a").cast("double"), F.col("b").cast("double")
    return r.agg(
        F.count("*").alias("n"), F.count_if(F.col("a") & F.col("b")).alias("both_pass"), F.count_if(~F.col("a") & ~F.col("b")).alias("both_fail"), F.count_if(F.col("a") & ~F.col("b")).alias("first_only"),
        F.count_if(~F.col("a") & F.col("b")).alias("second_only"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("agreement"), F.round(correlation(x, y), 6).alias("correlation"),
    )


def score_report(rows: DataFrame, by: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """Mean, range, sample deviation and pass rate of scores, over all or by columns."""
    return rows.groupBy(*by).agg(
        F.count("score").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"), F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 6).alias("std"),
        F.round(F.avg((F.col("score") >= threshold).cast("double")), 6).alias("pass_rate"),
    )


def allocation(counts: DataFrame, stratum: str, size: int) -> DataFrame:
    """``stratum, n, quota`` from ``stratum, n``: ``size`` rows dealt over strata, one row each, null a stratum too.

    Each stratum gets one if there are enough for all; the rest is dealt in proportion to
    what is left of each, rounded down, and what then remains goes by the largest fractions,
    larger strata first among equal ones, then by name, last first.
    """
    all_ = Window.partitionBy(F.lit(0))
    rows = counts.where("n > 0").withColumn("__first", F.when(F.count("*").over(all_) <= size, 1).otherwise(0))
    rows = rows.withColumn("__left", F.col("n") - F.col("__first"))
    rest = F.lit(size) - F.sum("__first").over(all_)
    rows = rows.withColumn("__ideal", F.coalesce(F.try_divide((rest * F.col("__left")).cast("double"), F.sum("__left").over(all_)), F.lit(0.0)))
    rows = rows.withColumn("__base", F.least(F.col("__left"), F.floor("__ideal"))).withColumn("__part", F.col("__ideal") - F.col("__base"))
    open_ = F.col("__left") > F.col("__base")
    place = F.row_number().over(all_.orderBy(open_.desc(), F.col("__part").desc(), F.col("n").desc(), F.col(stratum).desc_nulls_last()))
    over = F.lit(size) - F.sum(F.col("__first") + F.col("__base")).over(all_)
    quota = F.col("__first") + F.col("__base") + F.when(open_ & (place <= over), 1).otherwise(0)
    return rows.select(stratum, "n", quota.cast("long").alias("quota"))


def stratified_sample(rows: DataFrame, stratum: str, size: int, key: str, seed: str = "42") -> DataFrame:
    """``size`` rows over the strata by ``allocation``; within a stratum, the first in the order of a hash of their key.

    Rows are counted by the first digits of the hash, and only those up to the digits at
    which the quota is reached are put in order, so that no task sorts a stratum.
    """
    lot = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary"))
    keyed = rows.withColumns({"__lot": lot, "__digits": F.substring(lot, 1, 4)})
    counts = keyed.groupBy(stratum, "__digits").agg(F.count("*").alias("__n"))
    quota = allocation(counts.groupBy(stratum).agg(F.sum("__n").alias("n")), stratum, size).select(F.col(stratum).alias("__s"), "quota")
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(stratum).orderBy("__digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = counts.withColumn("__before", before).join(quota, F.col(stratum).eqNullSafe(F.col("__s"))).where(F.col("__before") < F.col("quota"))
    open_ = open_.select("__s", "quota", F.col("__digits").alias("__d"))
    near = keyed.join(open_, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__digits") == F.col("__d")))
    place = F.row_number().over(Window.partitionBy("__s").orderBy("__lot", key))
    return near.withColumn("__r", place).where(F.col("__r") <= F.col("quota")).select(*rows.columns)


def pack_budget(chunks: DataFrame, group: str, order: list[str], budget: int = 508, first: str | None = None) -> DataFrame:
    """Texts of a group, in order, until their tokens reach the budget; the one that crosses it is cut.

    The first text of a group is always kept.  ``first`` names a boolean column; texts where
    it is true come before the others, as those that bear the hypothesis do.  ``budget`` may
    be that of a premise: ``premise_budget``.
    """
    ahead = [F.coalesce(F.col(first), F.lit(False)).desc()] if first else []
    rows = chunks.withColumn("__tokens", F.floor(F.length("text") / 4))
    rows = running(rows, [*ahead, *order], "__tokens", "__before", by=[group])
    kept = rows.where((F.col("__before") < budget) | (F.col("__before") == 0))
    room = (budget - F.col("__before")) * 4
    return kept.withColumn("text", F.when(F.col("__before") + F.col("__tokens") > budget, F.substring(F.col("text"), F.lit(1), room.cast("int"))).otherwise(F.col("text"))).drop("__tokens", "__before")


def premise_budget(hypothesis: Column, window: int = 512, reserve: int = 20) -> Column:
    """The tokens that a window leaves for a premise beside its hypothesis."""
    return F.greatest(F.lit(window - reserve) - F.floor(F.length(hypothesis) / 4), F.lit(0))


def tercile_means(rows: DataFrame, confidence: str, score: str, order: str) -> DataFrame:
    """Mean score in the lower, middle and upper third by confidence (null the lowest); cuts at n // 3 and 2 n // 3."""
    total = rows.agg(F.count("*").alias("__n"))  # one row
    out = placed(rows, [F.col(confidence).asc_nulls_first(), order], "__i").join(F.broadcast(total))
    third = F.when(F.col("__i") <= F.floor(F.col("__n") / 3), "low").when(F.col("__i") <= F.floor(2 * F.col("__n") / 3), "mid").otherwise("high")
    return out.groupBy(third.alias("tercile")).agg(F.count("*").alias("rows"), F.round(F.avg(score), 6).alias("mean_score"))


def confidence_correlations(rows: DataFrame, score: str, signals: tuple[str, ...]) -> DataFrame:
    """``signal, correlation`` of each signal with the score; 0 where one of the two never varies."""
    sums = rows.agg(*[F.round(correlation(F.col(c).cast("double"), F.col(score).cast("double")), 6).alias(c) for c in signals])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("correlation")) for c in signals])).alias("s")).select("s.*")


def grounding_delta(rows: DataFrame, with_evidence: str, without: str) -> DataFrame:
    """Mean score with evidence less mean score without; each over the rows that have it, so that the two may differ in number."""
    return rows.agg(
        F.count(with_evidence).alias("n_with"), F.count(without).alias("n_without"), F.round(F.avg(with_evidence), 6).alias("mean_with"), F.round(F.avg(without), 6).alias("mean_without"),
        F.round(F.avg(with_evidence) - F.avg(without), 6).alias("delta"),
    )
