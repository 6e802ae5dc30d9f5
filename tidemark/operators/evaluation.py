"""Ranking metrics, breakdowns, baselines and comparison policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("ndcg", "hit", "mrr", "precision", "recall")


class SharedGrades:
    """Judgments that queries share: a product's grade for a query is its grade for the query's ``profile``, in the query's own product less ``less``.

    ``queries``: ``query_id, profile, product_id`` (the query's own, or null) and ``less``, a row a query;
    ``grades``: ``profile, product_id, grade``.  Nothing here has a row for each query and
    product but ``rows``, which only a result that lists them should ask for.
    """

    def __init__(self, queries: DataFrame, grades: DataFrame):
        self.queries, self.grades = queries, grades
        own = queries.where("less > 0").join(grades, ["profile", "product_id"])
        self.own = own.select("query_id", "profile", "product_id", "grade", "less")

    def of(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (``query_id, product_id``) with their ``grade``, null where there is none over 0."""
        asked = self.queries.select("query_id", "profile", F.col("product_id").alias("__own"), "less")
        rows = pairs.join(asked, "query_id", "left").join(self.grades.select("profile", "product_id", F.col("grade").alias("__g")), ["profile", "product_id"], "left")
        grade = F.col("__g") - F.when(F.col("product_id") == F.col("__own"), F.col("less")).otherwise(0.0)
        return rows.withColumn("grade", F.when(grade > 0, grade)).select(*pairs.columns, "grade")

    def relevant(self) -> DataFrame:
        """``query_id, relevant``: relevant products of each query that has any."""
        n = self.grades.where("grade > 0").groupBy("profile").agg(F.count("*").alias("n"))
        lost = self.own.where("grade > 0 and grade <= less").select("query_id", F.lit(1).alias("lost"))
        rows = self.queries.select("query_id", "profile").join(n, "profile").join(lost, "query_id", "left")
        return rows.select("query_id", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("relevant")).where("relevant > 0")

    def masses(self) -> DataFrame:
        """``query_id, relevant, mass``: ``relevant`` with the sum of the query's grades over 0."""
        total = self.grades.where("grade > 0").groupBy("profile").agg(F.sum("grade").alias("total"))
        off = self.own.where("grade > 0").select("query_id", F.least("grade", "less").alias("off"))
        rows = self.relevant().join(self.queries.select("query_id", "profile"), "query_id").join(total, "profile").join(off, "query_id", "left")
        return rows.select("query_id", "relevant", (F.col("total") - F.coalesce("off", F.lit(0.0))).alias("mass"))

    def ideal(self, k: int) -> DataFrame:
        """``query_id, idcg, relevant``.  A profile's first k + 1 products are enough, as only one of them is less for a query."""
        # a profile's grades are counted before they are put in order: few differ
        counted = self.grades.where("grade > 0").groupBy("profile", "grade").agg(F.count("*").alias("n"))
        place = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("grade")))
        few = counted.withColumn("r", place).where(F.col("r") <= k + 1)
        best = few.groupBy("profile").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("grade", "n")), asc=False), lambda s: F.array_repeat(s["grade"], F.least(s["n"], F.lit(k + 1)).cast("int")))).alias("l"))
        rows = self.queries.select("query_id", "profile").join(best.withColumn("l", F.slice("l", 1, k + 1)), "profile")
        rows = rows.join(self.own.select("query_id", F.col("grade").alias("g"), "less"), "query_id", "left").join(self.relevant(), "query_id")
        at = F.array_position("l", F.col("g"))
        rest = F.filter("l", lambda x, i: i + 1 != at)
        changed = F.when(at > 0, F.sort_array(F.concat(rest, F.array(F.col("g") - F.col("less"))), asc=False)).otherwise(F.col("l"))
        gains = F.transform(F.slice(changed, 1, k), lambda g, i: F.when(g > 0, g / F.log2(i + 2.0)).otherwise(0.0))
        return rows.select("query_id", F.aggregate(gains, F.lit(0.0), lambda a, x: a + x).alias("idcg"), "relevant")

    def rows(self, without: DataFrame | None = None) -> DataFrame:
        """``query_id, product_id, grade``, a row for each query and relevant product; a profile's are dealt by salts.

        ``without``: pairs (``query_id, product_id``) that are left out.  They go along with their
        query as a list, so that what is shuffled are queries and grades, not these rows.
        """
        salts = 32
        of = self.queries.select("query_id", "profile", F.col("product_id").alias("__own"), "less")
        if without is not None:
            of = of.join(without.groupBy("query_id").agg(F.collect_set("product_id").alias("__without")), "query_id", "left")
        of = of.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
        grade = F.col("grade") - F.when(F.col("product_id") == F.col("__own"), F.col("less")).otherwise(0.0)
        dealt = self.grades.withColumn("__salt", F.pmod(F.xxhash64("product_id"), F.lit(salts)).cast("int"))
        rows = dealt.join(of, ["profile", "__salt"])
        if without is not None:
            rows = rows.where(~F.coalesce(F.array_contains("__without", F.col("product_id")), F.lit(False)))
        return rows.select("query_id", "product_id", grade.alias("grade")).where("grade > 0")

    def products(self) -> DataFrame:
        """``product_id`` of each product that is relevant to a query."""
        asks = self.queries.groupBy("profile").agg(F.count("*").alias("asks"))
        lost = self.own.where("grade <= less").groupBy("profile", "product_id").agg(F.count("*").alias("lost"))
        rows = self.grades.where("grade > 0").join(asks, "profile").join(lost, ["profile", "product_id"], "left")
        return rows.where("asks > coalesce(lost, 0)").select("product_id").distinct()


def graded(pairs: DataFrame, judgments: DataFrame | SharedGrades) -> DataFrame:
    """``pairs`` (``query_id, product_id``) with their ``grade`` if it is over 0, else null."""
    if isinstance(judgments, SharedGrades):
        return judgments.of(pairs)
    return pairs.join(judgments.where("grade > 0").select("query_id", "product_id", "grade"), ["query_id", "product_id"], "left")


def ranking_metrics(ranking: DataFrame, judgments: DataFrame | SharedGrades, k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Metrics of each query of ``judgments`` (``query_id, product_id, grade``).

    The ideal ranking is over all judged grades.  Reciprocal rank looks at the whole
    list, the others at the first k; precision divides by the products there are.  A
    query without a ranking has zeros.  ``by`` names columns of ``ranking`` that tell
    several rankings apart.
    """
    keys = ["query_id", *by]
    if isinstance(judgments, SharedGrades):
        ideal = judgments.ideal(k)
        base = ideal.select("query_id")
    else:
        w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "product_id")
        ideal = judgments.where("grade > 0").withColumn("r", F.row_number().over(w)).groupBy("query_id").agg(
            F.sum(F.when(F.col("r") <= k, F.col("grade") / F.log2(F.col("r") + 1.0))).alias("idcg"), F.count("*").alias("relevant")
        )
        base = judgments.select("query_id").distinct()
    hits = graded(ranking, judgments)
    top = F.col("rank") <= k
    got = hits.groupBy(*keys).agg(
        F.sum(F.when(top, F.coalesce("grade", F.lit(0.0)) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.count_if(top).alias("n"),
        F.count_if(top & F.col("grade").isNotNull()).alias("hits"),
        F.min(F.when(F.col("grade").isNotNull(), F.col("rank"))).alias("first"),
    )
    if by:
        base = base.join(F.broadcast(ranking.select(*by).distinct()))  # a row a configuration
    out = base.join(got, keys, "left").join(ideal, "query_id", "left")
    zero = F.lit(0.0)
    return out.select(
        *keys,
        F.coalesce(F.try_divide("dcg", "idcg"), zero).alias("ndcg"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.coalesce(1.0 / F.col("first"), zero).alias("mrr"),
        F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("n")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("relevant")), zero).alias("recall"),
    )


def report(per_query: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Number of queries and means of the metrics."""
    return per_query.groupBy(*by).agg(F.count("*").alias("queries"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


def full_report(per_query: DataFrame, diversity: DataFrame, novelty_: DataFrame, coverage: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``report`` with the means of diversity and novelty, over the queries that have one, and the catalog coverage."""
    keys = ["query_id", *by]
    rows = per_query.join(diversity.select(*keys, "diversity"), keys, "left").join(novelty_.select(*keys, "novelty"), keys, "left")
    extra = rows.groupBy(*by).agg(F.count("*").alias("queries"), *[F.round(F.avg(m), 6).alias(m) for m in (*METRICS, "diversity", "novelty")])
    return extra.join(F.broadcast(coverage.select("coverage")))  # one row


def hit_list(ranking: DataFrame, judgments: DataFrame | SharedGrades) -> DataFrame:
    """For each query of ``ranking``, its first relevant rank and the relevant products it holds, in order of rank."""
    hits = graded(ranking, judgments)
    found = F.array_sort(F.collect_list(F.when(F.col("grade").isNotNull(), F.struct("rank", "product_id", "grade"))))
    return hits.groupBy("query_id").agg(F.min(F.when(F.col("grade").isNotNull(), F.col("rank"))).alias("first_rank"), found.alias("hits"))


def case_counters(cases: DataFrame, single: tuple[str, ...], multi: tuple[str, ...] = ()) -> DataFrame:
    """``field, value, cases`` of each single-valued field (null as ``unknown``) and each value of list-valued fields."""
    sides = [F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias("value")) for f in single]

    def listed(field: str):
        found = F.transform(F.array_distinct(field), lambda v: F.struct(F.lit(field).alias("field"), v.cast("string").alias("value")))
        return F.coalesce(found, F.array().cast("array<struct<field:string,value:string>>"))

    pairs = reduce(lambda a, b: F.concat(a, b), [F.array(*sides), *[listed(f) for f in multi]])
    return cases.select(F.explode(pairs).alias("p")).groupBy(F.col("p.field").alias("field"), F.col("p.value").alias("value")).agg(F.count("*").alias("cases"))


def dataset_statistics(judgments: DataFrame | SharedGrades, queries: DataFrame) -> DataFrame:
    """Queries, relevant products together and a query, and distinct products."""
    n = queries.agg(F.count_distinct("query_id").alias("queries"))
    if isinstance(judgments, SharedGrades):  # of the same queries
        sums = judgments.relevant().agg(F.coalesce(F.sum("relevant"), F.lit(0)).alias("relevant")).join(F.broadcast(judgments.products().agg(F.count("*").alias("products"))))
    else:
        sums = judgments.where("grade > 0").join(queries.select("query_id").distinct(), "query_id", "left_semi").agg(F.count("*").alias("relevant"), F.count_distinct("product_id").alias("products"))
    return n.join(F.broadcast(sums)).withColumn("avg_relevant", F.round(F.coalesce(F.try_divide(F.col("relevant").cast("double"), F.col("queries")), F.lit(0.0)), 6))  # one row each


def popularity_lists(queries: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k items with most rows in ``items`` (``product_id, n``), for every query alike."""
    return _same_for_all(queries, items.orderBy(F.desc("n"), "product_id").limit(k).select((-F.col("n")).alias("o"), "product_id"))


def random_lists(queries: DataFrame, items: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """K items by a seeded hash, for every query alike."""
    lot = F.md5(F.concat(F.col("product_id").cast("string"), F.lit(f"|{seed}")).cast("binary"))
    return _same_for_all(queries, items.select(lot.alias("o"), "product_id").orderBy("o", "product_id").limit(k))


def _same_for_all(queries: DataFrame, top: DataFrame) -> DataFrame:
    row = top.agg(F.array_sort(F.collect_list(F.struct("o", "product_id"))).alias("l"))  # one row of k items
    lists = queries.select("query_id").distinct().join(F.broadcast(row)).select("query_id", F.posexplode("l").alias("pos", "x"))
    return lists.select("query_id", F.col("x.product_id").alias("product_id"), (F.col("pos") + 1).alias("rank"))


def nearest_product_lists(queries: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """Item neighbours: the k products whose pooled vectors (``product_id, vector``) are most like the query's."""
    from tidemark.functions.vectors import l2_normalize
    from tidemark.operators.retrieval import vector_search

    asked = queries.select("query_id", l2_normalize(F.col("vector")).alias("vector"))
    there = products.select(F.col("product_id").alias("point_id"), l2_normalize(F.col("vector")).alias("vector"))
    return vector_search(asked, there, k).select("query_id", F.col("point_id").alias("product_id"), "rank")


def config_comparison(per_query: DataFrame, subsets: DataFrame) -> DataFrame:
    """``per_query`` (``query_id, config`` and metrics, config ``baseline`` or ``candidate``) by subset, combined by the subsets' sizes, and decided.

    ``subsets``: ``query_id, subset``.  One row a subset, and one for all, null, that
    weighs each subset's means by its number of queries; a query in two subsets counts in both.
    """
    rows = per_query.join(subsets.select("query_id", "subset").distinct(), "query_id")
    means = rows.groupBy("subset", "config").agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in METRICS])
    all_ = means.groupBy("config").agg(F.sum("n").alias("n"), *[F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("n")), F.sum("n")), F.lit(0.0)).alias(m) for m in METRICS])
    both = means.unionByName(all_.withColumn("subset", F.lit(None).cast(dict(means.dtypes)["subset"])))
    wide = both.groupBy("subset").agg(F.max("n").alias("queries"), *[F.round(F.max(F.when(F.col("config") == c, F.col(m))), 6).alias(f"{c}_{m}") for c in ("baseline", "candidate") for m in METRICS])
    return retrieval_decision(wide)


def list_diversity(ranking: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """For each query, the mean of one less cosine over the pairs of its first k products; 0 under two.

    Needs no pairs: over unit vectors they sum to (|sum|^2 - n) / 2.
    """
    cells = ranking.where(F.col("rank") <= k).join(vectors, "product_id").select("query_id", "product_id", F.posexplode("vector").alias("pos", "x"))
    sums = cells.groupBy("query_id", "pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    total = sums.groupBy("query_id").agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("q"), F.max("n").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return total.select("query_id", F.round(F.when(F.col("n") > 1, 1 - ((F.col("s2") - F.col("q")) / 2) / pairs).otherwise(0.0), 6).alias("diversity"))


def catalog_coverage(ranking: DataFrame, catalog: DataFrame, item: str = "product_id") -> DataFrame:
    """A10: recommended products over all; 0 for an empty catalog."""
    shown = ranking.agg(F.count_distinct(item).alias("recommended"))
    total = catalog.agg(F.count_distinct(item).alias("total"))
    return shown.join(total).select("recommended", "total", F.round(F.coalesce(F.try_divide(F.col("recommended").cast("double"), F.col("total")), F.lit(0.0)), 6).alias("coverage"))


def novelty(ranking: DataFrame, popularity: DataFrame, item: str = "product_id", floor: float = 0.001) -> DataFrame:
    """For each query, the mean of -log2 of the products' popularity, ``floor`` at least."""
    share = F.greatest(F.coalesce("share", F.lit(floor)), F.lit(floor))
    return ranking.join(popularity.select(item, "share"), item, "left").groupBy("query_id").agg(F.round(F.avg(-F.log2(share)), 6).alias("novelty"))


def breakdown(per_query: DataFrame, tags: DataFrame, single: tuple[str, ...], multi: tuple[str, ...]) -> DataFrame:
    """Means of the metrics by each single-valued field and by each value of list-valued fields.

    One pass of grouping sets; a query in several slices counts in each.
    """
    rows = per_query.join(tags, "query_id")
    sides = [F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias("value")) for f in single]

    def listed(field: str):
        return F.transform(F.array_distinct(field), lambda v: F.struct(F.lit(field).alias("field"), v.cast("string").alias("value")))

    lists = [listed(f) for f in multi]
    pairs = reduce(lambda a, b: F.concat(a, b), [F.array(*sides), *lists])
    return report(rows.select("query_id", *METRICS, F.explode(pairs).alias("p")).select("*", "p.field", "p.value"), ("field", "value"))


def weighted_mean(parts: DataFrame, value: str, count: str) -> DataFrame:
    """Mean over subsets, weighted by their counts."""
    return parts.agg(F.round(F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(count)), F.sum(count)), F.lit(0.0)), 6).alias(value))


def copies_in(key: Column, sample: Column, seed: int) -> Column:
    """A Poisson(1) number from a hash of key, sample and seed: how often a row is drawn."""
    text = F.concat_ws("|", key.cast("string"), sample.cast("string"), F.lit(str(seed)))
    lot = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    out, edge, p = F.lit(0), 0.0, 0.36787944117144233
    for n in range(1, 9):
        edge += p
        out = out + F.when(lot >= edge, 1).otherwise(0)
        p /= n
    return out


def bootstrap_ci(scores: DataFrame, value: str, samples: int = 200, seed: int = 13, key: str = "query_id", confidence: float = 0.95) -> DataFrame:
    """Mean and percentile interval of resampled means.

    Every row gets a Poisson(1) number of copies in each resample, so that resamples need
    no ordering, no second pass and no shuffle of rows: sums are combined map-side into
    ``samples`` rows.
    """
    rows = scores.where(F.col(value).isNotNull()).select(key, value, F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("b")).withColumn("c", copies_in(F.col(key), F.col("b"), seed))
    means = rows.groupBy("b").agg(F.try_divide(F.sum(F.col(value) * F.col("c")), F.sum("c")).alias("m"))
    edges = means.agg(F.round(F.percentile("m", (1 - confidence) / 2), 6).alias("lower"), F.round(F.percentile("m", (1 + confidence) / 2), 6).alias("upper"))
    return scores.agg(F.round(F.avg(value), 6).alias("mean")).join(edges)


def retrieval_decision(metrics: DataFrame, min_gain: float = 0.01, drops: tuple[tuple[str, float], ...] = (("mrr", 0.005), ("hit", 0.01), ("recall", 0.01))) -> DataFrame:
    """Candidate or baseline, from one row with ``baseline_x`` and ``candidate_x`` of each metric x; review if one is null."""
    gain = F.round(F.col("candidate_ndcg") - F.col("baseline_ndcg"), 6)
    held = F.lit(True)
    known = F.col("candidate_ndcg").isNotNull() & F.col("baseline_ndcg").isNotNull()
    for name, most in drops:
        held = held & (F.round(F.col(f"candidate_{name}") - F.col(f"baseline_{name}"), 6) >= -most)
        known = known & F.col(f"candidate_{name}").isNotNull() & F.col(f"baseline_{name}").isNotNull()
    return metrics.select("*", gain.alias("ndcg_delta"), held.alias("guardrails_passed"), F.when(~known, "manual_review").when((gain >= min_gain) & held, "candidate").otherwise("baseline").alias("recommended_config"))
