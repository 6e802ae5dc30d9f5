"""Evidence-gate calibration: threshold sweeps, datasets, hold-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import estimate_tokens
from tidemark.operators.evaluation import SharedGrades, copies_in, graded

# The sweep's grid, the gate in use, and the failures that a dataset may have.
TOKENS = (20, 30, 40, 50, 75, 100, 125, 150, 200)
CHUNKS = (1, 2, 3, 4, 5)
SCORES = (0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9)
CURRENT = (20, 1, 0.7)
MOST_FAILED, MOST_FAILED_SHARE = 25, 0.02
# Rates of a threshold, as counter over counter.
RATES = (
    ("candidate_hit_rate", "candidate_hit_queries", "total_queries"),
    ("query_success_rate", "accepted_queries", "total_queries"),
    ("conditional_query_success_rate", "accepted_queries", "candidate_hit_queries"),
    ("acceptance_rate", "accepted_count", "total_observations"),
    ("precision_at_accept", "accepted_relevant_count", "accepted_count"),
    ("retrieved_relevant_pass_rate", "accepted_relevant_count", "total_retrieved_relevant"),
    ("retrieved_relevant_grade_mass_pass_rate", "accepted_relevant_grade_mass", "total_retrieved_relevant_grade_mass"),
)
# Rates that two thresholds are compared by.
COMPARED = ("precision_at_accept", "query_success_rate", "conditional_query_success_rate", "retrieved_relevant_pass_rate", "retrieved_relevant_grade_mass_pass_rate", "acceptance_rate")
# Roles of subsets.
ROLES = {"retrieval_dev_holdout": "promotion_holdout", "faithfulness_dev_seed": "diagnostic_non_promotion"}
DIGITS = 4


def _ratio(a: Column, b: Column) -> Column:
    """A over b, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def raw_rates() -> dict[str, Column]:
    """Every rate of a threshold from its counters, not rounded; 0 where there is nothing to divide by."""
    out = {name: _ratio(F.col(a), F.col(b)) for name, a, b in RATES}
    out["query_success_retention"] = _ratio(out["query_success_rate"], out["candidate_hit_rate"])
    return out


def _with_rates(counters: DataFrame) -> DataFrame:
    return counters.withColumns({name: F.round(rate, DIGITS) for name, rate in raw_rates().items()})


def threshold_metrics(queries: DataFrame, observations: DataFrame, tokens: tuple[int, ...] = TOKENS, chunks: tuple[int, ...] = CHUNKS, scores: tuple[float, ...] = SCORES) -> DataFrame:
    """Ten counters and eight rates of every threshold combination.

    ``observations``: ``query_id, total_tokens, chunk_count, top_score, grade``.  Each
    observation is paired with the grid's cells that it passes, and no others; sums are
    combined map-side into a row for each query and cell, then for each cell.  Queries
    without observations count in the totals.
    """
    keys = ["min_tokens", "min_chunks", "min_score"]
    passed = _passed(observations, tokens, chunks, scores)
    relevant = F.col("grade") > 0
    per_query = passed.groupBy("query_id", *keys).agg(F.count("*").alias("n"), F.count_if(relevant).alias("r"), F.sum(F.when(relevant, F.col("grade")).otherwise(0.0)).alias("g"))
    sums = per_query.groupBy(*keys).agg(F.count_if(F.col("r") > 0).alias("accepted_queries"), F.sum("n").alias("accepted_count"), F.sum("r").alias("accepted_relevant_count"), F.sum("g").alias("accepted_relevant_grade_mass"))
    totals = query_rows(queries, observations).agg(
        F.count("*").alias("total_queries"), F.coalesce(F.sum("retrieved_count"), F.lit(0)).alias("total_observations"), F.count_if(F.col("retrieved_relevant_count") > 0).alias("candidate_hit_queries"),
        F.coalesce(F.sum("retrieved_relevant_count"), F.lit(0)).alias("total_retrieved_relevant"), F.coalesce(F.sum("retrieved_relevant_grade_mass"), F.lit(0.0)).alias("total_retrieved_relevant_grade_mass"),
    )
    spark = observations.sparkSession
    grid = spark.createDataFrame([(t, c, float(s)) for t in tokens for c in chunks for s in scores], "min_tokens int, min_chunks int, min_score double")
    # the grid is a fixed list, the totals one row
    out = grid.join(F.broadcast(totals)).join(sums, keys, "left").na.fill(0)
    return _with_rates(out.withColumn("accepted_irrelevant_count", F.col("accepted_count") - F.col("accepted_relevant_count")))


def _passed(observations: DataFrame, tokens: tuple[int, ...], chunks: tuple[int, ...], scores: tuple[float, ...]) -> DataFrame:
    """A row for each observation and cell of the grid that it passes."""
    cells = lambda column, values: F.explode(F.array_compact(F.array(*[F.when(F.col(column) >= v, F.lit(v)) for v in values])))
    rows = observations.select("query_id", "grade", cells("total_tokens", tokens).alias("min_tokens"), "chunk_count", "top_score")
    rows = rows.select("query_id", "grade", "min_tokens", cells("chunk_count", chunks).alias("min_chunks"), "top_score")
    return rows.select("query_id", "grade", "min_tokens", "min_chunks", cells("top_score", tuple(map(float, scores))).alias("min_score"))


def query_rows(queries: DataFrame, observations: DataFrame) -> DataFrame:
    """For each query, products retrieved, relevant ones among them, and their grades together."""
    relevant = F.col("grade") > 0
    of_query = observations.groupBy("query_id").agg(F.count("*").alias("retrieved_count"), F.count_if(relevant).alias("retrieved_relevant_count"), F.sum(F.when(relevant, F.col("grade")).otherwise(0.0)).alias("retrieved_relevant_grade_mass"))
    return queries.select("query_id").distinct().join(of_query, "query_id", "left").na.fill(0)


def _best_first() -> list[Column]:
    rates = raw_rates()
    return [rates["precision_at_accept"].desc(), rates["query_success_rate"].desc(), rates["retrieved_relevant_grade_mass_pass_rate"].desc(), F.col("min_tokens"), F.col("min_chunks"), F.col("min_score")]


def recommended_threshold(metrics: DataFrame, retention: float = 0.95) -> DataFrame:
    """The best threshold among those that keep ``retention`` of the highest query success.

    If none of those accepts a relevant product, the best of all that do, else of all.
    Best: precision, query success, grade mass, then the lowest thresholds; by rates as
    they are, not rounded.  ``metrics`` has a row a grid cell.
    """
    success = raw_rates()["query_success_rate"]
    rows = metrics.withColumn("__need", F.max(success).over(Window.partitionBy(F.lit(0))) * retention)
    tier = F.when((success >= F.col("__need")) & (F.col("accepted_relevant_count") > 0), 0).when(F.col("accepted_relevant_count") > 0, 1).otherwise(2)
    return rows.orderBy(tier, *_best_first()).limit(1).drop("__need")


def _at(metrics: DataFrame, threshold: tuple[int, int, float]) -> DataFrame:
    return metrics.where((F.col("min_tokens") == threshold[0]) & (F.col("min_chunks") == threshold[1]) & (F.col("min_score") == float(threshold[2])))


def compare_thresholds(metrics: DataFrame, baseline: tuple[int, int, float], candidate: tuple[int, int, float]) -> DataFrame:
    """``metric, baseline, candidate, delta`` of each rate at two thresholds; the difference is of rates as they are."""
    rates = raw_rates()

    def one(t: tuple[int, int, float], name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(n).alias("metric"), rates[n].alias("value")) for n in rates])
        return _at(metrics, t).select(F.explode(cells).alias("c")).select(F.col("c.metric").alias("metric"), F.col("c.value").alias(name))

    out = one(baseline, "baseline").join(one(candidate, "candidate"), "metric")
    return out.select("metric", F.round("baseline", DIGITS).alias("baseline"), F.round("candidate", DIGITS).alias("candidate"), F.round(F.col("candidate") - F.col("baseline"), DIGITS).alias("delta"))


def sweep_report(metrics: DataFrame, current: tuple[int, int, float] = CURRENT, retention: float = 0.95, top: int = 20) -> DataFrame:
    """The recommended threshold, the current one, and the ``top`` best, a row each, with differences to the current.

    ``role`` is ``recommended``, ``current`` or ``top``; ``place`` counts the best from 1.
    The current threshold must be in the sweep.  ``required_query_success_rate`` is what
    the recommended one had to reach.
    """
    rates = raw_rates()
    ceiling = metrics.agg(F.max(rates["query_success_rate"]).alias("__top"))
    best = metrics.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*_best_first()))).where(F.col("place") <= top)  # a row a grid cell
    rows = recommended_threshold(metrics, retention).withColumn("place", F.lit(0)).withColumn("role", F.lit("recommended"))
    rows = rows.unionByName(_at(metrics, current).withColumn("place", F.lit(0)).withColumn("role", F.lit("current"))).unionByName(best.withColumn("role", F.lit("top")))
    now = _at(metrics, current).select(*[rates[n].alias(f"__{n}") for n in COMPARED])
    out = rows.join(F.broadcast(now)).join(F.broadcast(ceiling))  # one row each
    deltas = {f"{n}_delta": F.round(rates[n] - F.col(f"__{n}"), DIGITS) for n in COMPARED}
    return out.withColumn("place", F.col("place").cast("long")).withColumns(deltas | {"required_query_success_rate": F.round(F.col("__top") * retention, DIGITS)}).drop("__top", *[f"__{n}" for n in COMPARED])


def bootstrap_thresholds(queries: DataFrame, observations: DataFrame, threshold: tuple[int, int, float], samples: int = 200, seed: int = 13) -> DataFrame:
    """``metric, mean, lower, upper`` of four rates at a threshold, over resamples of queries with all their products.

    A query gets a Poisson(1) number of copies in each resample, so that products of one
    query stay together; sums are combined map-side into a row a resample.
    """
    ok = (F.col("total_tokens") >= threshold[0]) & (F.col("chunk_count") >= threshold[1]) & (F.col("top_score") >= float(threshold[2]))
    passed = observations.where(ok).groupBy("query_id").agg(F.count("*").alias("accepted"), F.count_if(F.col("grade") > 0).alias("accepted_relevant"))
    rows = query_rows(queries, observations).join(passed, "query_id", "left").na.fill(0)
    rows = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("c", copies_in(F.col("query_id"), F.col("b"), seed))
    total = lambda x: F.sum(F.col("c") * x)
    flag = lambda x: (x > 0).cast("long")
    sums = rows.groupBy("b").agg(
        _ratio(total(F.col("accepted_relevant")), total(F.col("accepted"))).alias("precision_at_accept"),
        _ratio(total(flag(F.col("accepted_relevant"))), F.sum("c")).alias("query_success_rate"),
        _ratio(total(flag(F.col("accepted_relevant"))), total(flag(F.col("retrieved_relevant_count")))).alias("conditional_query_success_rate"),
        _ratio(total(F.col("accepted_relevant")), total(F.col("retrieved_relevant_count"))).alias("retrieved_relevant_pass_rate"),
    )
    names = [c for c in sums.columns if c != "b"]
    long = sums.select("b", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])).alias("s")).select("s.*")
    # a row a resample
    return long.groupBy("metric").agg(F.round(F.avg("v"), DIGITS).alias("mean"), F.round(F.percentile("v", 0.025), DIGITS).alias("lower"), F.round(F.percentile("v", 0.975), DIGITS).alias("upper"))


def dataset_summary(queries: DataFrame, observations: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row: queries attempted, completed and failed, candidates of a query, relevant items of a query, and the share with a relevant candidate.

    ``queries``: ``query_id``, and ``relevant_count`` if it is known; ``failed``: ``query_id``.
    """
    known = "relevant_count" in queries.columns
    rows = query_rows(queries, observations).withColumnRenamed("retrieved_count", "n")
    relevant = queries.groupBy("query_id").agg(F.max("relevant_count").alias("relevant")) if known else queries.select("query_id", F.lit(None).cast("long").alias("relevant")).distinct()
    rows = rows.join(relevant, "query_id", "left")
    out = rows.agg(
        F.count("*").alias("queries"), F.min("n").alias("min_candidates"), F.percentile("n", 0.5).alias("median_candidates"), F.max("n").alias("max_candidates"), F.round(F.avg("n"), 3).alias("mean_candidates"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("observations"), F.coalesce(F.sum("retrieved_relevant_count"), F.lit(0)).alias("relevant_observations"),
        F.count_if(F.col("retrieved_relevant_count") > 0).alias("candidate_hit_queries"), F.round(F.coalesce(F.avg((F.col("retrieved_relevant_count") > 0).cast("double")), F.lit(0.0)), DIGITS).alias("candidate_hit_rate"),
        F.min("relevant").alias("min_relevant_items"), F.percentile("relevant", 0.5).alias("median_relevant_items"), F.max("relevant").alias("max_relevant_items"),
    )
    lost = failed.agg(F.count_distinct("query_id").alias("failed_queries")) if failed is not None else observations.sparkSession.range(1).select(F.lit(0).cast("long").alias("failed_queries"))
    out = out.join(F.broadcast(lost)).withColumn("attempted_queries", F.col("queries") + F.col("failed_queries"))  # one row
    return out.withColumns({"failed_query_rate": F.round(_ratio(F.col("failed_queries"), F.col("attempted_queries")), DIGITS), "query_coverage_rate": F.round(_ratio(F.col("queries"), F.col("attempted_queries")), DIGITS)})


def group_counts(queries: DataFrame, group: str, failed: DataFrame | None = None) -> DataFrame:
    """``group, completed, failed``: queries by a column, null a value."""
    rows = queries.select(F.col(group), F.lit(1).alias("a"), F.lit(0).alias("b"))
    if failed is not None:
        rows = rows.unionByName(failed.select(F.col(group), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return rows.groupBy(group).agg(F.sum("a").alias("completed"), F.sum("b").alias("failed"))


def evidence_metrics(products: DataFrame, evidence: str = "evidence_texts") -> DataFrame:
    """``products`` with ``chunk_count, total_tokens, min_chunk_tokens, max_chunk_tokens`` of their evidence texts; 0 without any."""
    sizes = F.transform(F.col(evidence), lambda t: estimate_tokens(F.coalesce(t, F.lit(""))))
    zero = F.lit(0).cast("long")
    return products.withColumns(
        {
            "chunk_count": F.greatest(F.size(evidence), F.lit(0)).cast("long"),
            "total_tokens": F.coalesce(F.aggregate(sizes, zero, lambda a, x: a + x), zero),
            "min_chunk_tokens": F.coalesce(F.array_min(sizes), zero),
            "max_chunk_tokens": F.coalesce(F.array_max(sizes), zero),
        }
    )


def restrict(rows: DataFrame, query_ids: DataFrame) -> DataFrame:
    """the rows of some queries."""
    return rows.join(query_ids.select("query_id").distinct(), "query_id", "left_semi")


def limit_queries(queries: DataFrame, limit: int | None, order: list[str]) -> DataFrame:
    """the first queries in order, with ``sample_limited``, which says whether that leaves any out."""
    if limit is None:
        return queries.withColumn("sample_limited", F.lit(False))
    total = queries.agg(F.count("*").alias("__n"))  # one row
    first = queries.orderBy(*order).limit(limit)
    return first.join(F.broadcast(total)).withColumn("sample_limited", F.col("__n") > limit).drop("__n")


def missed_items(judgments: DataFrame | SharedGrades, retrieved: DataFrame) -> DataFrame:
    """``query_id, product_id, grade`` of relevant products that were not retrieved."""
    if isinstance(judgments, SharedGrades):
        return judgments.rows(without=retrieved)
    judged = judgments.where("grade > 0").select("query_id", "product_id", "grade")
    return judged.join(retrieved.select("query_id", "product_id").distinct(), ["query_id", "product_id"], "left_anti")


def dataset_rows(judgments: DataFrame | SharedGrades, retrieved: DataFrame, attempted: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """A row a query, and a row for each of its first k products with the product's grade.

    ``judgments``: ``query_id, product_id, grade``; ``retrieved``: ``query_id, product_id, rank``
    and what the gate looks at; ``attempted``: ``query_id, error`` (null where the search
    worked).  Queries that failed are in neither.
    """
    done = attempted.where("error is null").select("query_id").distinct()
    if isinstance(judgments, SharedGrades):
        of_query = judgments.masses().toDF("query_id", "relevant_count", "relevant_grade_mass")
    else:
        judgments = judgments.where("grade > 0").groupBy("query_id", "product_id").agg(F.max("grade").alias("grade"))
        of_query = judgments.groupBy("query_id").agg(F.count("*").alias("relevant_count"), F.sum("grade").alias("relevant_grade_mass"))
    observations = graded(retrieved.where(F.col("rank") <= k).join(done, "query_id", "left_semi"), judgments).withColumn("grade", F.coalesce("grade", F.lit(0.0)))
    return query_rows(done, observations).join(of_query, "query_id", "left").na.fill(0), observations


def failure_budget(attempted: DataFrame, most: int = MOST_FAILED, share: float = MOST_FAILED_SHARE) -> DataFrame:
    """One row: attempted and failed queries, their rate, and whether the dataset may be trusted: neither bound is passed."""
    sums = attempted.agg(F.count_distinct("query_id").alias("attempted"), F.count_distinct(F.when(F.col("error").isNotNull(), F.col("query_id"))).alias("failed"))
    rate = _ratio(F.col("failed"), F.col("attempted"))
    return sums.select("attempted", "failed", F.round(rate, DIGITS).alias("failure_rate"), ((F.col("failed") <= most) & (rate <= share)).alias("within_budget"))


def subset_role(subset: Column) -> Column:
    """P5: what a subset's results may be used for."""
    out = F.lit("custom_non_promotion")
    for name, role in ROLES.items():
        out = F.when(subset == name, role).otherwise(out)
    return out


def holdout_comparison(queries: DataFrame, observations: DataFrame, baseline: tuple[int, int, float], candidate: tuple[int, int, float], subset: str = "subset") -> DataFrame:
    """Rates at two thresholds and their differences for each subset of queries, with the subset's role.

    All subsets in one pass: counters are summed by subset and threshold.
    """
    role = queries.select("query_id", F.col(subset).alias("subset")).distinct()
    relevant = F.col("grade") > 0
    sides = []
    for name, t in (("baseline", baseline), ("candidate", candidate)):
        ok = (F.col("total_tokens") >= t[0]) & (F.col("chunk_count") >= t[1]) & (F.col("top_score") >= float(t[2]))
        sides.append(F.struct(F.lit(name).alias("side"), ok.alias("ok")))
    rows = observations.select("query_id", "grade", F.explode(F.array(*sides)).alias("s"))
    per_query = rows.groupBy("query_id", F.col("s.side").alias("side")).agg(
        F.count_if("s.ok").alias("n"), F.count_if(F.col("s.ok") & relevant).alias("r"), F.sum(F.when(F.col("s.ok") & relevant, F.col("grade")).otherwise(0.0)).alias("g"),
        F.count("*").alias("all_n"), F.count_if(relevant).alias("all_r"), F.sum(F.when(relevant, F.col("grade")).otherwise(0.0)).alias("all_g"),
    )
    every = role.select("query_id", "subset", F.explode(F.array(F.lit("baseline"), F.lit("candidate"))).alias("side"))
    sums = every.join(per_query, ["query_id", "side"], "left").na.fill(0).groupBy("subset", "side").agg(
        F.count("*").alias("total_queries"), F.sum("all_n").alias("total_observations"), F.count_if(F.col("all_r") > 0).alias("candidate_hit_queries"), F.sum("all_r").alias("total_retrieved_relevant"),
        F.sum("all_g").alias("total_retrieved_relevant_grade_mass"), F.count_if(F.col("r") > 0).alias("accepted_queries"), F.sum("n").alias("accepted_count"), F.sum("r").alias("accepted_relevant_count"),
        F.sum("g").alias("accepted_relevant_grade_mass"),
    )
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), r.alias("v")) for n, r in raw_rates().items()])
    long = sums.select("subset", "side", F.explode(cells).alias("c")).select("subset", F.col("c.metric").alias("metric"), "side", F.col("c.v").alias("v"))
    wide = long.groupBy("subset", "metric").agg(F.max(F.when(F.col("side") == "baseline", F.col("v"))).alias("b"), F.max(F.when(F.col("side") == "candidate", F.col("v"))).alias("c"))
    return wide.select("subset", subset_role(F.col("subset")).alias("role"), "metric", F.round("b", DIGITS).alias("baseline"), F.round("c", DIGITS).alias("candidate"), F.round(F.col("c") - F.col("b"), DIGITS).alias("delta"))
