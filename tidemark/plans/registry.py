"""The registered queries of the engine, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vectors as V
from tidemark.operators import calibration, chunking, evaluation, faithfulness, guardrails, interactions, leakage, querybank, retrieval, serving
from tidemark.plans import fixtures as X
from tidemark.session import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def merkle_sql(name: str, ids: str, depth: int = 4) -> str:
    """Levels ``{name}4`` to ``{name}0`` of the Merkle tree over the digests of a query's column ``id``."""
    out = f"{name}i AS (SELECT id, md5(id) AS h FROM ({ids})), {name}{depth} AS (SELECT h[1:{depth}] AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM {name}i GROUP BY 1)"
    for k in range(depth - 1, -1, -1):
        out += f", {name}{k} AS (SELECT left(p, {k}) AS p, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(p || d, '' ORDER BY p)) AS d FROM {name}{k + 1} GROUP BY 1)"
    return out


def queries() -> dict[str, Query]:
    from tidemark.plans import decisions, lifecycle, stores  # noqa: F401 - they register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


# --- SQL of the fixtures ---------------------------------------------------------------

NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g'))"
REVIEWS = "SELECT doc_id, text, CAST(doc_id % 7 AS DOUBLE) AS rating, source AS user_id, 'p' || (doc_id % 50) AS parent_asin FROM documents"
INTER = "SELECT l_orderkey AS user_id, l_partkey AS item_id, CAST(CAST(l_quantity AS INT) % 5 + 1 AS DOUBLE) AS rating, l_shipdate AS ts FROM lineitem"
POINTS = "SELECT vec_id AS point_id, CAST(embedding AS DOUBLE[]) AS vector, label, vec_id // 4 AS product_id, CAST(vec_id * 7 % 5 + 1 AS DOUBLE) AS rating FROM embeddings"
SEARCH = f"""p AS ({POINTS}), q AS (SELECT point_id AS query_id, vector, label FROM p WHERE point_id % 50 = 0),
s AS (SELECT q.query_id, p.point_id AS chunk_id, round(list_dot_product(q.vector, p.vector), 6) + 0.0::DOUBLE AS score, p.product_id, p.rating FROM q JOIN p ON q.query_id <> p.point_id WHERE {{where}}),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 100)"""
JUDGED = "j AS (SELECT q.query_id, p.product_id, CAST(count(*) AS DOUBLE) AS grade FROM q JOIN p ON p.label = q.label AND p.point_id <> q.query_id GROUP BY ALL)"
_ALL = SEARCH.format(where="TRUE")


def _products(method: str, source: str = "c") -> str:
    score = {"max": "max(score)", "mean": "avg(score)", "weighted_mean": "CASE WHEN sum(rating) > 0 THEN sum(score * rating) / sum(rating) ELSE avg(score) END"}[method]
    return f"SELECT query_id, product_id, round({score}, 6) AS score, count(*) AS chunk_count, avg(rating) AS avg_rating FROM {source} GROUP BY query_id, product_id"


def _blend(a: float, b: float, source: str) -> str:
    if (a, b) == (1.0, 0.0):
        return f"SELECT * FROM {source}"
    lo, hi = "min(score) OVER (PARTITION BY query_id)", "max(score) OVER (PARTITION BY query_id)"
    return f"SELECT * REPLACE (round({a}::DOUBLE * CASE WHEN {hi} - {lo} > 1e-8 THEN (score - {lo}) / ({hi} - {lo}) ELSE 1.0::DOUBLE END + {b}::DOUBLE * (avg_rating / 5.0::DOUBLE), 6) AS score) FROM {source}"


def _ranked(source: str, k: int | None = None) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM {source}" + (f" QUALIFY rank <= {k}" if k else "")


def _metrics(source: str, k: int = 10) -> str:
    return f"""
i AS (SELECT query_id, sum(CASE WHEN r <= {k} THEN grade / log2(r + 1) END) AS idcg, count(*) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, product_id) AS r FROM j) GROUP BY query_id),
h AS (SELECT r.query_id, sum(CASE WHEN r.rank <= {k} THEN coalesce(j.grade, 0) / log2(r.rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (r.rank <= {k}) AS n, count(*) FILTER (r.rank <= {k} AND j.grade IS NOT NULL) AS hits, min(CASE WHEN j.grade IS NOT NULL THEN r.rank END) AS first
      FROM {source} r LEFT JOIN j ON j.query_id = r.query_id AND j.product_id = r.product_id GROUP BY r.query_id),
m AS (SELECT i.query_id, coalesce(dcg / nullif(idcg, 0), 0) AS ndcg, CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, coalesce(1.0::DOUBLE / first, 0) AS mrr, coalesce(hits::DOUBLE / nullif(n, 0), 0) AS precision, coalesce(hits::DOUBLE / nullif(relevant, 0), 0) AS recall
      FROM i LEFT JOIN h ON h.query_id = i.query_id)"""


_MEANS = "count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall"

def _rate(a: str, b: str) -> str:
    return f"round(({a})::DOUBLE / nullif({b}, 0), 4)"


_SUBSET = "CASE query_id % 3 WHEN 0 THEN 'retrieval_dev_holdout' WHEN 1 THEN 'faithfulness_dev_seed' ELSE 'own' END"

# --- reviews and interactions ----------------------------------------------------------

_ISSUES = "(trim(text) <> '' AND length(trim(text)) < 10)"
_BAD = f"(text IS NULL OR trim(text) = '' OR {_ISSUES} OR NOT coalesce(rating BETWEEN 1 AND 5, false) OR user_id IS NULL OR parent_asin IS NULL)"


@register("review_quality_issues", f"""
WITH r AS ({REVIEWS}), s AS (SELECT count(*) FILTER (text IS NULL) AS missing_text, count(*) FILTER (trim(text) = '') AS empty_text, count(*) FILTER ({_ISSUES}) AS very_short_text,
count(*) FILTER (NOT coalesce(rating BETWEEN 1 AND 5, false)) AS invalid_rating, count(*) FILTER (user_id IS NULL) AS missing_user, count(*) FILTER (parent_asin IS NULL) AS missing_product,
count({NORM.format('text')}) - count(DISTINCT {NORM.format('text')}) AS duplicate_text, count(*) FILTER (NOT {_BAD}) AS clean_rows FROM r),
u AS (UNPIVOT s ON COLUMNS(*) INTO NAME issue VALUE reviews) SELECT issue, reviews FROM u WHERE reviews > 0 OR issue = 'clean_rows'""")
def review_quality_issues(spark, sf):
    return interactions.review_issues(X.reviews(spark, sf))


@register("clean_reviews", f"WITH r AS ({REVIEWS}) SELECT doc_id, rating, user_id, parent_asin FROM r WHERE NOT {_BAD}")
def clean_reviews(spark, sf):
    return interactions.clean_reviews(X.reviews(spark, sf)).select("doc_id", "rating", "user_id", "parent_asin")


@register("normalized_text", f"SELECT doc_id, {NORM.format('text')} AS norm, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def normalized_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("norm"), T.estimate_tokens(F.col("text")).alias("tokens"))


@register("exact_duplicate_texts", f"SELECT md5({NORM.format('text')}) AS norm_md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_texts(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5(T.normalize_text(F.col("text")).cast("binary")).alias("norm_md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@register("review_stats", f"WITH r AS ({INTER}) SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, avg(rating) AS avg_rating, 1 - count(*)::DOUBLE / (count(DISTINCT user_id)::DOUBLE * count(DISTINCT item_id)) AS sparsity FROM r")
def review_stats(spark, sf):
    return interactions.review_stats(X.interactions(spark, sf))


@register("rating_distribution", f"WITH r AS ({INTER}) SELECT rating, count(*) AS n FROM r GROUP BY rating")
def rating_distribution(spark, sf):
    return interactions.rating_distribution(X.interactions(spark, sf))


def _core_sql(rounds: int = 6) -> str:
    out, prev = [f"k0 AS ({INTER})"], "k0"
    for i in range(1, rounds + 1):
        out.append(f"u{i} AS (SELECT * FROM {prev} WHERE user_id IN (SELECT user_id FROM {prev} GROUP BY user_id HAVING count(*) >= 5))")
        out.append(f"k{i} AS (SELECT * FROM u{i} WHERE item_id IN (SELECT item_id FROM u{i} GROUP BY item_id HAVING count(*) >= 5))")
        prev = f"k{i}"
    return f"WITH {', '.join(out)} SELECT user_id, item_id, count(*) AS n, sum(rating) AS ratings FROM {prev} GROUP BY user_id, item_id"


@register("kcore_interactions", _core_sql())
def kcore_interactions(spark, sf):
    return interactions.k_core(X.interactions(spark, sf)).groupBy("user_id", "item_id").agg(F.count("*").alias("n"), F.sum("rating").alias("ratings"))


_SPLIT = "v AS (SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN ts END AS ts FROM events), e AS (SELECT *, row_number() OVER (ORDER BY ts NULLS LAST, event_id) AS i, count(*) OVER () AS n FROM v), s AS (SELECT *, CASE WHEN i <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN i <= round_even(n * (0.7::DOUBLE + 0.1::DOUBLE), 0) THEN 'val' ELSE 'test' END AS split FROM e)"


@register("temporal_split_bounds", f"WITH {_SPLIT}, b AS (SELECT split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY split) SELECT *, coalesce(last_ts < lead(first_ts) OVER (ORDER BY first_ts), true) AS ordered FROM b")
def temporal_split_bounds(spark, sf):
    return interactions.split_bounds(interactions.temporal_split(table(spark, sf, "events").select(F.when(F.col("event_id") % 97 != 0, F.col("ts")).alias("ts"), "event_id"), "ts"), "ts")


@register("item_popularity", f"WITH r AS ({INTER}) SELECT item_id, count(*) AS n, count(*) / (SELECT count(*) FROM r) AS share FROM r GROUP BY item_id")
def item_popularity(spark, sf):
    return interactions.item_popularity(X.interactions(spark, sf))


@register("popularity_topk", f"WITH r AS ({INTER}) SELECT item_id, count(*) AS n FROM r GROUP BY item_id ORDER BY n DESC, item_id LIMIT 10")
def popularity_topk(spark, sf):
    return interactions.popular_items(X.interactions(spark, sf))


@register("user_history", f"""WITH r AS (SELECT user_id, item_id, rating, ts FROM ({INTER})), w AS (SELECT *, max((rating >= 4)::INT) OVER (PARTITION BY user_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM r)
SELECT user_id, item_id, rating, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id, rating) AS INT) AS place, CASE WHEN n < 5 THEN 'warming' ELSE 'warm' END AS level FROM w WHERE rating >= 4 OR pos = 0 QUALIFY place <= 5""")
def user_history(spark, sf):
    return retrieval.user_history(X.interactions(spark, sf), ["ts", "item_id", "rating"]).select("user_id", "item_id", "rating", "place", "level")


# --- retrieval -------------------------------------------------------------------------


@register("vector_topk", f"WITH {_ALL} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM c")
def vector_topk(spark, sf):
    return X.chunks(spark, sf).select("query_id", "chunk_id", "score", "rank")


@register("vector_topk_filtered", f"WITH {SEARCH.format(where='p.rating >= 4')} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank, rating FROM c")
def vector_topk_filtered(spark, sf):
    return X.chunks(spark, sf, least_rating=4.0).select("query_id", "chunk_id", "score", "rank", "rating")


for _m in ("max", "mean", "weighted_mean"):
    register(f"product_scores_{_m}", f"WITH {_ALL} {_products(_m)}")(lambda spark, sf, m=_m: retrieval.product_scores(X.chunks(spark, sf), m))


@register("weighted_ranking", f"WITH {_ALL}, a AS ({_products('max')}), b AS ({_blend(0.8, 0.2, 'a')}), r AS ({_ranked('b', 10)}) SELECT query_id, product_id, score, chunk_count, avg_rating, CAST(rank AS INT) AS rank FROM r")
def weighted_ranking(spark, sf):
    return retrieval.recommend(X.chunks(spark, sf))


@register("exclude_after_limit", f"WITH {_ALL}, a AS ({_products('max')}), b AS ({_blend(0.8, 0.2, 'a')}), r AS ({_ranked('b', 10)}) SELECT query_id, product_id, score, CAST(rank AS INT) AS rank FROM r WHERE NOT (product_id % 3 = 0)")
def exclude_after_limit(spark, sf):
    top = retrieval.recommend(X.chunks(spark, sf))
    return retrieval.exclude_products(top, top.select("query_id", "product_id").where("product_id % 3 = 0")).select("query_id", "product_id", "score", "rank")


@register("evidence_gate", f"""WITH {_ALL}, t AS (SELECT c.*, d.text FROM c LEFT JOIN documents d ON d.doc_id = c.chunk_id),
a AS (SELECT query_id, product_id, count(*) AS chunk_count, CAST(coalesce(sum(length(text)), 0) // 4 AS BIGINT) AS total_tokens, max(score) AS top_score FROM t GROUP BY query_id, product_id)
SELECT *, CASE WHEN chunk_count < 2 THEN 'insufficient_chunks' WHEN total_tokens < 200 THEN 'insufficient_tokens' WHEN top_score < 0.2 THEN 'low_relevance' END AS refusal_type, chunk_count >= 2 AND total_tokens >= 200 AND top_score >= 0.2 AS is_sufficient FROM a""")
def evidence_gate(spark, sf):
    return retrieval.evidence_gate(_observed(spark, sf), 2, 200, 0.2)


def _observed(spark, sf):
    """Products of each query with the size of their evidence; a chunk's text is the document of its id."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.length("text").alias("chars"))
    rows = X.chunks(spark, sf).join(d, "chunk_id", "left")
    return rows.groupBy("query_id", "product_id").agg(F.count("*").alias("chunk_count"), F.floor(F.coalesce(F.sum("chars"), F.lit(0)) / 4).alias("total_tokens"), F.max("score").alias("top_score"))


_POOLED = "u AS (SELECT product_id, generate_subscripts(vector, 1) - 1 AS pos, unnest(vector) AS x FROM p), "


def _pooled(how: str) -> str:
    agg = {"mean": "avg", "max": "max"}[how]
    return f"{_POOLED} g AS (SELECT product_id, pos, {agg}(x) AS x FROM u GROUP BY ALL), pv AS (SELECT product_id, pos, x / sqrt(sum(x * x) OVER (PARTITION BY product_id)) AS x FROM g)"


for _h in ("mean", "max"):

    def _pooled_query(spark, sf, how=_h):
        """The coordinates of pooled vectors."""
        pooled = retrieval.pooled_vectors(X.points(spark, sf), how=how)
        return pooled.select("product_id", F.posexplode("vector").alias("pos", "x")).select("product_id", "pos", (F.round("x", 6) + 0.0).alias("x"))

    register(f"pooled_vectors_{_h}", f"WITH p AS ({POINTS}), {_pooled(_h)} SELECT product_id, CAST(pos AS INT) AS pos, round(x, 6) + 0.0::DOUBLE AS x FROM pv")(_pooled_query)


@register("embedding_validation", "SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong_size, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS not_finite, count(*) FILTER (abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.01) AS not_unit FROM embeddings")
def embedding_validation(spark, sf):
    return serving.embedding_validation(table(spark, sf, "embeddings"), "embedding", 64)


# --- evaluation ------------------------------------------------------------------------

_RANKING = f"{_ALL}, {JUDGED}, a AS ({_products('max')}), r AS ({_ranked('a', 10)})"


def _ranking(spark, sf, k: int = 10):
    return retrieval.ranked(retrieval.product_scores(X.chunks(spark, sf)), k)


@register("retrieval_metrics_per_query", f"WITH {_RANKING}, {_metrics('r')} SELECT query_id, round(ndcg, 6) AS ndcg, hit, round(mrr, 6) AS mrr, round(precision, 6) AS precision, round(recall, 6) AS recall FROM m")
def retrieval_metrics_per_query(spark, sf):
    rows = evaluation.ranking_metrics(_ranking(spark, sf), X.shared_grades(spark, sf))
    return rows.select("query_id", *[F.round(m, 6).alias(m) for m in evaluation.METRICS])


@register("retrieval_report", f"WITH {_RANKING}, {_metrics('r')} SELECT {_MEANS} FROM m")
def retrieval_report(spark, sf):
    return evaluation.report(evaluation.ranking_metrics(_ranking(spark, sf), X.shared_grades(spark, sf)))


@register("list_diversity", f"""WITH {_RANKING}, {_pooled('mean')}, pq AS (SELECT a.query_id, a.product_id AS pa, b.product_id AS pb FROM r a JOIN r b ON a.query_id = b.query_id AND a.product_id < b.product_id),
dc AS (SELECT query_id, pa, pb, sum(v.x * w.x) AS cosine FROM pq JOIN pv v ON v.product_id = pa JOIN pv w ON w.product_id = pb AND w.pos = v.pos GROUP BY ALL),
dn AS (SELECT DISTINCT query_id FROM r) SELECT dn.query_id, round(coalesce(avg(1 - cosine), 0), 6) AS diversity FROM dn LEFT JOIN dc ON dc.query_id = dn.query_id GROUP BY dn.query_id""")
def list_diversity(spark, sf):
    return evaluation.list_diversity(_ranking(spark, sf), retrieval.pooled_vectors(X.points(spark, sf)))


@register("catalog_coverage", f"WITH {_RANKING} SELECT count(DISTINCT product_id) AS recommended, (SELECT count(DISTINCT product_id) FROM p) AS total, round(count(DISTINCT product_id)::DOUBLE / (SELECT count(DISTINCT product_id) FROM p), 6) AS coverage FROM r")
def catalog_coverage(spark, sf):
    return evaluation.catalog_coverage(_ranking(spark, sf), X.points(spark, sf))


_POP = "pop AS (SELECT item_id AS product_id, count(*) / (SELECT count(*) FROM lineitem) AS share FROM (SELECT l_partkey AS item_id FROM lineitem) GROUP BY item_id)"


@register("novelty", f"WITH {_RANKING}, {_POP} SELECT query_id, round(avg(-log2(greatest(coalesce(share, 0.001::DOUBLE), 0.001::DOUBLE))), 6) AS novelty FROM r LEFT JOIN pop USING (product_id) GROUP BY query_id")
def novelty(spark, sf):
    popular = interactions.item_popularity(X.interactions(spark, sf)).select(F.col("item_id").alias("product_id"), "share")
    return evaluation.novelty(_ranking(spark, sf), popular)


def _sweep_sql(configs: list[tuple[str, str]]) -> str:
    parts = [f"SELECT '{name}' AS config, * FROM (WITH r AS ({sql}), {_metrics('r')} SELECT {_MEANS} FROM m)" for name, sql in configs]
    return f"WITH {_ALL}, {JUDGED}, a AS ({_products('max')}) " + " UNION ALL ".join(parts)


_PAIRS = ((1.0, 0.0), (0.9, 0.1), (0.8, 0.2), (0.7, 0.3), (0.6, 0.4), (0.5, 0.5))


@register("weight_sweep", _sweep_sql([(f"{a}/{b}", f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM ({_blend(a, b, 'a')}) QUALIFY rank <= 10") for a, b in _PAIRS]))
def weight_sweep(spark, sf):
    """One search and one scoring of products; every weight pair is a row of each product."""
    products = retrieval.product_scores(X.chunks(spark, sf))
    every = retrieval.weight_rankings(products, _PAIRS, 10)
    return evaluation.report(evaluation.ranking_metrics(every, X.shared_grades(spark, sf), by=("config",)), ("config",))


@register("aggregation_sweep", f"WITH {_ALL}, {JUDGED} " + " UNION ALL ".join(f"SELECT '{m}' AS config, * FROM (WITH a AS ({_products(m)}), r AS ({_ranked('a', 10)}), {_metrics('r')} SELECT {_MEANS} FROM m)" for m in ("max", "mean", "weighted_mean")))
def aggregation_sweep(spark, sf):
    found = X.chunks(spark, sf)
    every = None
    for m in ("max", "mean", "weighted_mean"):
        part = retrieval.ranked(retrieval.product_scores(found, m), 10).withColumn("config", F.lit(m))
        every = part if every is None else every.unionByName(part)
    return evaluation.report(evaluation.ranking_metrics(every, X.shared_grades(spark, sf), by=("config",)), ("config",))


@register("k_sweep", f"WITH {_ALL}, {JUDGED}, a AS ({_products('max')}), r AS ({_ranked('a', 20)}) " + " UNION ALL ".join(f"SELECT {k} AS k, * FROM (WITH {_metrics('r', k)} SELECT {_MEANS} FROM m)" for k in (5, 10, 20)))
def k_sweep(spark, sf):
    top = _ranking(spark, sf, 20)
    parts = [evaluation.report(evaluation.ranking_metrics(top, X.shared_grades(spark, sf), k)).withColumn("k", F.lit(k)) for k in (5, 10, 20)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("metric_breakdown", f"WITH {_RANKING}, {_metrics('r')}, l AS (SELECT m.*, q.label FROM m JOIN q USING (query_id)), t AS (SELECT *, 'label' AS field, CAST(label AS VARCHAR) AS value FROM l UNION ALL SELECT *, 'tags', CASE WHEN query_id % 100 = 0 THEN 'even' ELSE 'odd' END FROM l UNION ALL SELECT *, 'tags', 'all' FROM l) SELECT field, value, {_MEANS} FROM t GROUP BY field, value")
def metric_breakdown(spark, sf):
    tags = X.queries(spark, sf).select("query_id", "label", F.array(F.when(F.col("query_id") % 100 == 0, "even").otherwise("odd"), F.lit("all")).alias("tags"))
    return evaluation.breakdown(evaluation.ranking_metrics(_ranking(spark, sf), X.shared_grades(spark, sf)), tags, ("label",), ("tags",))


@register("baseline_comparison", f"""WITH {_ALL}, {JUDGED}, a AS ({_products('max')}), {_pooled('mean')},
n AS (SELECT product_id, count(*) AS n FROM p GROUP BY product_id),
pr AS (SELECT q.query_id, t.product_id, t.rank FROM q JOIN (SELECT product_id, row_number() OVER (ORDER BY n DESC, product_id) AS rank FROM n QUALIFY rank <= 10) t ON TRUE),
rd AS (SELECT q.query_id, t.product_id, t.rank FROM q JOIN (SELECT product_id, row_number() OVER (ORDER BY md5(CAST(product_id AS VARCHAR) || '|42'), product_id) AS rank FROM n QUALIFY rank <= 10) t ON TRUE),
qu AS (SELECT query_id, generate_subscripts(vector, 1) - 1 AS pos, unnest(vector) AS x FROM q), qn AS (SELECT query_id, pos, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS x FROM qu),
kn AS (SELECT query_id, product_id, round(sum(qn.x * pv.x), 6) AS score FROM qn JOIN pv USING (pos) GROUP BY ALL), kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM kn QUALIFY rank <= 10),
rt AS ({_ranked('a', 10)}) """ + " UNION ALL ".join(f"SELECT '{name}' AS method, * FROM (WITH {_metrics(src)} SELECT {_MEANS} FROM m)" for name, src in (("popularity", "pr"), ("random", "rd"), ("item_neighbours", "kr"), ("retrieval", "rt"))))
def baseline_comparison(spark, sf):
    """Popularity, a seeded random list, item neighbours, and retrieval."""
    n = X.points(spark, sf).groupBy("product_id").agg(F.count("*").alias("n"))
    asked = X.queries(spark, sf)
    lists = {
        "popularity": evaluation.popularity_lists(asked, n),
        "random": evaluation.random_lists(asked, n),
        "item_neighbours": evaluation.nearest_product_lists(asked, retrieval.pooled_vectors(X.points(spark, sf))),
        "retrieval": _ranking(spark, sf),
    }
    every = None
    for name, rows in lists.items():
        part = rows.select("query_id", "product_id", "rank").withColumn("method", F.lit(name))
        every = part if every is None else every.unionByName(part)
    return evaluation.report(evaluation.ranking_metrics(every, X.shared_grades(spark, sf), by=("method",)), ("method",))


@register("rating_filter_sweep", " UNION ALL ".join(f"SELECT '{name}' AS config, * FROM (WITH {SEARCH.format(where=where)}, {JUDGED}, a AS ({_products('max')}), r AS ({_ranked('a', 10)}), {_metrics('r')} SELECT {_MEANS} FROM m)" for name, where in (("none", "TRUE"), ("3.0", "p.rating >= 3"), ("4.0", "p.rating >= 4"))))
def rating_filter_sweep(spark, sf):
    """The ranking with a least rating of none, 3 and 4."""
    every = None
    for name, least in (("none", None), ("3.0", 3.0), ("4.0", 4.0)):
        part = retrieval.ranked(retrieval.product_scores(X.chunks(spark, sf, least_rating=least)), 10).withColumn("config", F.lit(name))
        every = part if every is None else every.unionByName(part)
    return evaluation.report(evaluation.ranking_metrics(every, X.shared_grades(spark, sf), by=("config",)), ("config",))


@register("full_report", f"""WITH {_RANKING}, {_metrics('r')}, {_pooled('mean')}, {_POP}, pq AS (SELECT a.query_id, a.product_id AS pa, b.product_id AS pb FROM r a JOIN r b ON a.query_id = b.query_id AND a.product_id < b.product_id),
cs AS (SELECT query_id, pa, pb, sum(v.x * w.x) AS cosine FROM pq JOIN pv v ON v.product_id = pa JOIN pv w ON w.product_id = pb AND w.pos = v.pos GROUP BY ALL), dv AS (SELECT query_id, round(avg(1 - cosine), 6) AS diversity FROM cs GROUP BY query_id),
nv AS (SELECT query_id, CASE WHEN query_id % 100 = 0 THEN round(avg(-log2(greatest(coalesce(share, 0.001::DOUBLE), 0.001::DOUBLE))), 6) END AS novelty FROM r LEFT JOIN pop USING (product_id) GROUP BY query_id)
SELECT {_MEANS}, round(avg(diversity), 6) AS diversity, round(avg(novelty), 6) AS novelty, (SELECT round(count(DISTINCT product_id)::DOUBLE / (SELECT count(DISTINCT product_id) FROM p), 6) FROM r) AS coverage FROM m LEFT JOIN dv USING (query_id) LEFT JOIN nv USING (query_id)""")
def full_report(spark, sf):
    """All means; novelty is known for every other query only, and its mean is over those."""
    ranking = _ranking(spark, sf)
    popular = interactions.item_popularity(X.interactions(spark, sf)).select(F.col("item_id").alias("product_id"), "share")
    return evaluation.full_report(
        evaluation.ranking_metrics(ranking, X.shared_grades(spark, sf)), evaluation.list_diversity(ranking, retrieval.pooled_vectors(X.points(spark, sf))),
        evaluation.novelty(ranking, popular).withColumn("novelty", F.when(F.col("query_id") % 100 == 0, F.col("novelty"))), evaluation.catalog_coverage(ranking, X.points(spark, sf)),
    )


@register("hit_list", f"WITH {_RANKING}, h AS (SELECT r.query_id, r.rank, r.product_id, j.grade FROM r LEFT JOIN j ON j.query_id = r.query_id AND j.product_id = r.product_id) SELECT query_id, CAST(min(rank) FILTER (grade > 0) AS INT) AS first_rank, coalesce(string_agg(product_id || ':' || CAST(grade AS INT), ',' ORDER BY rank) FILTER (grade > 0), '') AS hits FROM h GROUP BY query_id")
def hit_list(spark, sf):
    found = evaluation.hit_list(_ranking(spark, sf), X.shared_grades(spark, sf))
    shown = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["product_id"].cast("string"), h["grade"].cast("int").cast("string"))), ",")
    return found.select("query_id", "first_rank", shown.alias("hits"))


@register("case_counters", f"WITH p AS ({POINTS}), q AS (SELECT point_id AS query_id, CASE WHEN label > 0 THEN label END AS label, ['all', CASE WHEN point_id % 100 = 0 THEN 'even' ELSE 'odd' END, 'all'] AS tags FROM p WHERE point_id % 50 = 0), t AS (SELECT 'label' AS field, coalesce(CAST(label AS VARCHAR), 'unknown') AS value FROM q UNION ALL SELECT 'tags', unnest(list_distinct(tags)) FROM q) SELECT field, value, count(*) AS cases FROM t GROUP BY ALL")
def case_counters(spark, sf):
    rows = X.queries(spark, sf).select(F.when(F.col("label") > 0, F.col("label")).alias("label"), F.array(F.lit("all"), F.when(F.col("query_id") % 100 == 0, "even").otherwise("odd"), F.lit("all")).alias("tags"))
    return evaluation.case_counters(rows, ("label",), ("tags",))


@register("dataset_statistics", f"WITH p AS ({POINTS}), q AS (SELECT point_id AS query_id, vector, label FROM p WHERE point_id % 50 = 0), {JUDGED} SELECT (SELECT count(*) FROM q) AS queries, count(*) AS relevant, count(DISTINCT product_id) AS products, round(count(*)::DOUBLE / (SELECT count(*) FROM q), 6) AS avg_relevant FROM j WHERE grade > 0")
def dataset_statistics(spark, sf):
    return evaluation.dataset_statistics(X.shared_grades(spark, sf), X.queries(spark, sf))


def _config_sql() -> str:
    side = "SELECT '{c}' AS config, * FROM (WITH r AS ({r}), {m} SELECT * FROM m)"
    both = " UNION ALL ".join(side.format(c=c, r=_ranked(src, 10), m=_metrics("r")) for c, src in (("baseline", "a"), ("candidate", "b")))
    cols = ", ".join(f"round(max(CASE WHEN config = '{c}' THEN {m} END), 6) AS {c}_{m}" for c in ("baseline", "candidate") for m in evaluation.METRICS)
    means = ", ".join(f"avg({m}) AS {m}" for m in evaluation.METRICS)
    whole = ", ".join(f"sum({m} * n) / sum(n) AS {m}" for m in evaluation.METRICS)
    ok = "round(candidate_mrr - baseline_mrr, 6) >= -0.005 AND round(candidate_hit - baseline_hit, 6) >= -0.01 AND round(candidate_recall - baseline_recall, 6) >= -0.01"
    return f"""WITH {_ALL}, {JUDGED}, a AS ({_products('max')}), b AS ({_blend(0.8, 0.2, 'a')}), pm AS ({both}), ps AS (SELECT pm.*, {_SUBSET} AS subset FROM pm UNION ALL SELECT pm.*, 'every' FROM pm),
g AS (SELECT subset, config, count(*) AS n, {means} FROM ps GROUP BY ALL), ga AS (SELECT * FROM g UNION ALL SELECT NULL, config, sum(n), {whole} FROM g GROUP BY config), wd AS (SELECT subset, CAST(max(n) AS BIGINT) AS queries, {cols} FROM ga GROUP BY subset)
SELECT *, round(candidate_ndcg - baseline_ndcg, 6) AS ndcg_delta, {ok} AS guardrails_passed, CASE WHEN round(candidate_ndcg - baseline_ndcg, 6) >= 0.01 AND {ok} THEN 'candidate' ELSE 'baseline' END AS recommended_config FROM wd"""


@register("retrieval_config_comparison", _config_sql())
def retrieval_config_comparison(spark, sf):
    """Two configurations over four subsets."""
    products = retrieval.product_scores(X.chunks(spark, sf))
    sides = [retrieval.ranked(p, 10).withColumn("config", F.lit(c)) for c, p in (("baseline", products), ("candidate", retrieval.weighted_ranking(products)))]
    per_query = evaluation.ranking_metrics(sides[0].unionByName(sides[1]), X.shared_grades(spark, sf), by=("config",))
    m = F.col("query_id") % 3
    own = F.when(m == 0, "retrieval_dev_holdout").when(m == 1, "faithfulness_dev_seed").otherwise("own")
    subsets = X.queries(spark, sf).select("query_id", F.explode(F.array(own, F.lit("every"))).alias("subset"))
    return evaluation.config_comparison(per_query, subsets)


@register("retrieval_ab_decision", f"""WITH {_ALL}, {JUDGED}, a AS ({_products('max')}), b AS ({_blend(0.8, 0.2, 'a')}),
x AS (SELECT * FROM (WITH r AS ({_ranked('a', 10)}), {_metrics('r')} SELECT {_MEANS} FROM m)), y AS (SELECT * FROM (WITH r AS ({_ranked('b', 10)}), {_metrics('r')} SELECT {_MEANS} FROM m))
SELECT x.ndcg AS baseline_ndcg, y.ndcg AS candidate_ndcg, round(y.ndcg - x.ndcg, 6) AS ndcg_delta, round(y.mrr - x.mrr, 6) >= -0.005 AND round(y.hit - x.hit, 6) >= -0.01 AND round(y.recall - x.recall, 6) >= -0.01 AS guardrails_passed,
CASE WHEN round(y.ndcg - x.ndcg, 6) >= 0.01 AND round(y.mrr - x.mrr, 6) >= -0.005 AND round(y.hit - x.hit, 6) >= -0.01 AND round(y.recall - x.recall, 6) >= -0.01 THEN 'candidate' ELSE 'baseline' END AS recommended_config FROM x, y""")
def retrieval_ab_decision(spark, sf):
    products = retrieval.product_scores(X.chunks(spark, sf))
    j = X.shared_grades(spark, sf)
    one = evaluation.report(evaluation.ranking_metrics(retrieval.ranked(products, 10), j)).select(*[F.col(m).alias(f"baseline_{m}") for m in evaluation.METRICS])
    two = evaluation.report(evaluation.ranking_metrics(retrieval.ranked(retrieval.weighted_ranking(products), 10), j)).select(*[F.col(m).alias(f"candidate_{m}") for m in evaluation.METRICS])
    return evaluation.retrieval_decision(one.join(two)).select("baseline_ndcg", "candidate_ndcg", "ndcg_delta", "guardrails_passed", "recommended_config")


def _copies_sql(key: str, sample: str, seed: int) -> str:
    edges, e, p = [], 0.0, 0.36787944117144233
    for n in range(1, 9):
        e += p
        edges.append(f"(lot >= {e!r}::DOUBLE)::INT")
        p /= n
    return f"(SELECT {' + '.join(edges)} FROM (SELECT ('0x' || md5({key} || '|' || {sample} || '|{seed}')[1:8])::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS lot))"


@register("bootstrap_ci", f"""WITH {_RANKING}, {_metrics('r')}, b AS (SELECT unnest(range(1, 201)) AS b), bs AS (SELECT b, ndcg, {_copies_sql('query_id', 'b', 13)} AS c FROM m, b),
e AS (SELECT b, sum(ndcg * c) / nullif(sum(c), 0) AS v FROM bs GROUP BY b) SELECT (SELECT round(avg(ndcg), 6) FROM m) AS mean, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM e""")
def bootstrap_ci(spark, sf):
    return evaluation.bootstrap_ci(evaluation.ranking_metrics(_ranking(spark, sf), X.shared_grades(spark, sf)), "ndcg")


# --- calibration -----------------------------------------------------------------------

_GRID_SCORES = (0.10, 0.15, 0.20, 0.25, 0.30)
_OBS = f"""{_ALL}, {JUDGED}, t AS (SELECT c.*, length(d.text) AS chars FROM c LEFT JOIN documents d ON d.doc_id = c.chunk_id),
o AS (SELECT t.query_id, t.product_id, count(*) AS chunk_count, coalesce(sum(chars), 0) // 4 AS total_tokens, max(score) AS top_score, coalesce(any_value(j.grade), 0) AS grade FROM t LEFT JOIN j ON j.query_id = t.query_id AND j.product_id = t.product_id GROUP BY t.query_id, t.product_id)"""
_GRID = f"""{_OBS}, g AS (SELECT a.min_tokens, b.min_chunks, s.min_score FROM (SELECT CAST(unnest({list(calibration.TOKENS)}) AS INT) AS min_tokens) a, (SELECT CAST(unnest({list(calibration.CHUNKS)}) AS INT) AS min_chunks) b, (SELECT CAST(unnest({list(_GRID_SCORES)}) AS DOUBLE) AS min_score) s),
tq AS (SELECT q.query_id, count(o.query_id) AS n, count(*) FILTER (o.grade > 0) AS r, coalesce(sum(o.grade) FILTER (o.grade > 0), 0) AS g FROM q LEFT JOIN o ON o.query_id = q.query_id GROUP BY q.query_id),
tt AS (SELECT count(*) AS total_queries, CAST(sum(n) AS BIGINT) AS total_observations, count(*) FILTER (r > 0) AS candidate_hit_queries, CAST(sum(r) AS BIGINT) AS total_retrieved_relevant, sum(g) AS total_retrieved_relevant_grade_mass FROM tq),
pq AS (SELECT g.min_tokens, g.min_chunks, g.min_score, o.query_id, count(*) AS n, count(*) FILTER (o.grade > 0) AS r, coalesce(sum(o.grade) FILTER (o.grade > 0), 0) AS gm FROM g JOIN o ON o.total_tokens >= g.min_tokens AND o.chunk_count >= g.min_chunks AND o.top_score >= g.min_score GROUP BY ALL),
pc AS (SELECT min_tokens, min_chunks, min_score, count(*) FILTER (r > 0) AS accepted_queries, CAST(sum(n) AS BIGINT) AS accepted_count, CAST(sum(r) AS BIGINT) AS accepted_relevant_count, sum(gm) AS accepted_relevant_grade_mass FROM pq GROUP BY ALL),
z AS (SELECT g.*, tt.*, coalesce(accepted_queries, 0) AS accepted_queries, coalesce(accepted_count, 0) AS accepted_count, coalesce(accepted_relevant_count, 0) AS accepted_relevant_count, coalesce(accepted_relevant_grade_mass, 0) AS accepted_relevant_grade_mass, coalesce(accepted_count, 0) - coalesce(accepted_relevant_count, 0) AS accepted_irrelevant_count
      FROM g CROSS JOIN tt LEFT JOIN pc ON pc.min_tokens = g.min_tokens AND pc.min_chunks = g.min_chunks AND pc.min_score = g.min_score),
rr AS (SELECT *, coalesce(candidate_hit_queries::DOUBLE / nullif(total_queries, 0), 0) AS r_hit, coalesce(accepted_queries::DOUBLE / nullif(total_queries, 0), 0) AS r_success, coalesce(accepted_queries::DOUBLE / nullif(candidate_hit_queries, 0), 0) AS r_conditional,
      coalesce(accepted_count::DOUBLE / nullif(total_observations, 0), 0) AS r_acceptance, coalesce(accepted_relevant_count::DOUBLE / nullif(accepted_count, 0), 0) AS r_precision, coalesce(accepted_relevant_count::DOUBLE / nullif(total_retrieved_relevant, 0), 0) AS r_pass,
      coalesce(accepted_relevant_grade_mass / nullif(total_retrieved_relevant_grade_mass, 0), 0) AS r_mass FROM z),
yr AS (SELECT *, coalesce(r_success / nullif(r_hit, 0), 0) AS r_retention FROM rr),
y AS (SELECT * EXCLUDE (r_hit, r_success, r_conditional, r_acceptance, r_precision, r_pass, r_mass, r_retention), round(r_hit, 4) AS candidate_hit_rate, round(r_success, 4) AS query_success_rate, round(r_conditional, 4) AS conditional_query_success_rate, round(r_retention, 4) AS query_success_retention,
      round(r_acceptance, 4) AS acceptance_rate, round(r_precision, 4) AS precision_at_accept, round(r_pass, 4) AS retrieved_relevant_pass_rate, round(r_mass, 4) AS retrieved_relevant_grade_mass_pass_rate FROM yr)"""
_RAW = "y.*, yr.r_hit, yr.r_success, yr.r_conditional, yr.r_acceptance, yr.r_precision, yr.r_pass, yr.r_mass FROM y JOIN yr USING (min_tokens, min_chunks, min_score)"
_TIER = "CASE WHEN r_success >= (SELECT max(r_success) FROM yr) * 0.95::DOUBLE AND accepted_relevant_count > 0 THEN 0 WHEN accepted_relevant_count > 0 THEN 1 ELSE 2 END"
_PLACE = "r_precision DESC, r_success DESC, r_mass DESC, min_tokens, min_chunks, min_score"
_BEST = f"SELECT * EXCLUDE (r_hit, r_success, r_conditional, r_acceptance, r_precision, r_pass, r_mass) FROM (SELECT {_RAW}) ORDER BY {_TIER}, {_PLACE} LIMIT 1"
_LONG = "l AS (SELECT min_tokens, min_chunks, min_score, unnest(['candidate_hit_rate', 'query_success_rate', 'conditional_query_success_rate', 'query_success_retention', 'acceptance_rate', 'precision_at_accept', 'retrieved_relevant_pass_rate', 'retrieved_relevant_grade_mass_pass_rate']) AS metric, unnest([r_hit, r_success, r_conditional, r_retention, r_acceptance, r_precision, r_pass, r_mass]) AS value FROM yr)"


def _observations(spark, sf):
    return evaluation.graded(_observed(spark, sf), X.shared_grades(spark, sf)).na.fill({"grade": 0.0})


def _sweep(spark, sf):
    return calibration.threshold_metrics(X.queries(spark, sf), _observations(spark, sf), scores=_GRID_SCORES)


@register("gate_threshold_grid", f"WITH {_GRID} SELECT * FROM y")
def gate_threshold_grid(spark, sf):
    return _sweep(spark, sf)


@register("gate_recommended_threshold", f"WITH {_GRID} {_BEST}")
def gate_recommended_threshold(spark, sf):
    return calibration.recommended_threshold(_sweep(spark, sf))


@register("gate_threshold_comparison", f"""WITH {_GRID}, {_LONG}
SELECT a.metric, round(a.value, 4) AS baseline, round(b.value, 4) AS candidate, round(b.value - a.value, 4) AS delta FROM l a JOIN l b USING (metric) WHERE (a.min_tokens, a.min_chunks, a.min_score) = (20, 1, 0.2::DOUBLE) AND (b.min_tokens, b.min_chunks, b.min_score) = (100, 1, 0.25::DOUBLE)""")
def gate_threshold_comparison(spark, sf):
    return calibration.compare_thresholds(_sweep(spark, sf), (20, 1, 0.2), (100, 1, 0.25))


_DELTAS = ", ".join(f"round({r} - (SELECT {r} FROM yr WHERE (min_tokens, min_chunks, min_score) = (20, 1, 0.2::DOUBLE)), 4) AS {n}_delta" for n, r in (("precision_at_accept", "r_precision"), ("query_success_rate", "r_success"), ("conditional_query_success_rate", "r_conditional"), ("retrieved_relevant_pass_rate", "r_pass"), ("retrieved_relevant_grade_mass_pass_rate", "r_mass"), ("acceptance_rate", "r_acceptance")))


@register("gate_sweep_report", f"""WITH {_GRID}, k AS (SELECT {_RAW}), tp AS (SELECT *, row_number() OVER (ORDER BY {_PLACE}) AS place FROM k),
u AS (SELECT *, 'top' AS role FROM tp WHERE place <= 20 UNION ALL SELECT *, 0, 'current' FROM k WHERE (min_tokens, min_chunks, min_score) = (20, 1, 0.2::DOUBLE) UNION ALL SELECT * FROM (SELECT *, 0, 'recommended' FROM k ORDER BY {_TIER}, {_PLACE} LIMIT 1))
SELECT * EXCLUDE (r_hit, r_success, r_conditional, r_acceptance, r_precision, r_pass, r_mass), {_DELTAS}, round((SELECT max(r_success) FROM yr) * 0.95::DOUBLE, 4) AS required_query_success_rate FROM u""")
def gate_sweep_report(spark, sf):
    return calibration.sweep_report(_sweep(spark, sf), (20, 1, 0.2))


_BOOT = """x AS (SELECT q.query_id, count(o.query_id) AS n, count(*) FILTER (o.grade > 0) AS r, count(*) FILTER (o.total_tokens >= 20 AND o.chunk_count >= 1 AND o.top_score >= 0.2) AS an, count(*) FILTER (o.grade > 0 AND o.total_tokens >= 20 AND o.chunk_count >= 1 AND o.top_score >= 0.2) AS ar FROM q LEFT JOIN o ON o.query_id = q.query_id GROUP BY q.query_id)"""


@register("gate_bootstrap", f"""WITH {_OBS}, {_BOOT}, b AS (SELECT unnest(range(1, 201)) AS b), bs AS (SELECT b, x.*, {_copies_sql('query_id', 'b', 13)} AS c FROM x, b),
e AS (SELECT b, coalesce(sum(c * ar)::DOUBLE / nullif(sum(c * an), 0), 0) AS p, coalesce(sum(c * (ar > 0)::INT)::DOUBLE / nullif(sum(c), 0), 0) AS s, coalesce(sum(c * (ar > 0)::INT)::DOUBLE / nullif(sum(c * (r > 0)::INT), 0), 0) AS k, coalesce(sum(c * ar)::DOUBLE / nullif(sum(c * r), 0), 0) AS v FROM bs GROUP BY b),
l AS (SELECT unnest(['precision_at_accept', 'query_success_rate', 'conditional_query_success_rate', 'retrieved_relevant_pass_rate']) AS metric, unnest([p, s, k, v]) AS v FROM e)
SELECT metric, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.025), 4) AS lower, round(quantile_cont(v, 0.975), 4) AS upper FROM l GROUP BY metric""")
def gate_bootstrap(spark, sf):
    return calibration.bootstrap_thresholds(X.queries(spark, sf), _observations(spark, sf), (20, 1, 0.2))


_ATT = "att AS (SELECT point_id AS query_id, label AS source_type, CASE WHEN point_id % 150 = 0 THEN 'timeout' END AS error FROM p WHERE point_id % 50 = 0)"
_DONE = f"""{_OBS}, {_ATT}, dn AS (SELECT query_id, source_type FROM att WHERE error IS NULL), dr AS (SELECT dn.query_id, count(o.query_id) AS n, count(*) FILTER (o.grade > 0) AS r FROM dn LEFT JOIN o ON o.query_id = dn.query_id GROUP BY dn.query_id),
rc AS (SELECT query_id, count(*) AS relevant_count FROM j WHERE grade > 0 GROUP BY query_id)"""


def _attempted(spark, sf):
    return X.queries(spark, sf).select("query_id", F.col("label").alias("source_type"), F.when(F.col("query_id") % 150 == 0, "timeout").alias("error"))


def _completed(spark, sf):
    attempted = _attempted(spark, sf)
    relevant = X.shared_grades(spark, sf).relevant().withColumnRenamed("relevant", "relevant_count")
    done = attempted.where("error is null").select("query_id", "source_type").join(relevant, "query_id", "left").na.fill(0)
    return done, calibration.restrict(_observations(spark, sf), done), attempted.where("error is not null").select("query_id", "source_type")


@register("calibration_dataset_summary", f"""WITH {_DONE}, f AS (SELECT count(DISTINCT query_id) AS failed_queries FROM att WHERE error IS NOT NULL),
sm AS (SELECT count(*) AS queries, min(n) AS min_candidates, quantile_cont(n, 0.5) AS median_candidates, max(n) AS max_candidates, round(avg(n), 3) AS mean_candidates, CAST(sum(n) AS BIGINT) AS observations, CAST(sum(r) AS BIGINT) AS relevant_observations,
count(*) FILTER (r > 0) AS candidate_hit_queries, round(avg((r > 0)::INT::DOUBLE), 4) AS candidate_hit_rate, min(coalesce(relevant_count, 0)) AS min_relevant_items, quantile_cont(coalesce(relevant_count, 0), 0.5) AS median_relevant_items, max(coalesce(relevant_count, 0)) AS max_relevant_items FROM dr LEFT JOIN rc USING (query_id))
SELECT sm.*, failed_queries, queries + failed_queries AS attempted_queries, round(failed_queries::DOUBLE / (queries + failed_queries), 4) AS failed_query_rate, round(queries::DOUBLE / (queries + failed_queries), 4) AS query_coverage_rate FROM sm, f""")
def calibration_dataset_summary(spark, sf):
    return calibration.dataset_summary(*_completed(spark, sf))


@register("calibration_group_counts", f"WITH p AS ({POINTS}), {_ATT} SELECT source_type, count(*) FILTER (error IS NULL) AS completed, count(*) FILTER (error IS NOT NULL) AS failed FROM att GROUP BY source_type")
def calibration_group_counts(spark, sf):
    done, _, failed = _completed(spark, sf)
    return calibration.group_counts(done, "source_type", failed)


@register("calibration_dataset_rows", f"""WITH {_ALL}, {JUDGED}, {_ATT}, a AS ({_products('max')}), r AS ({_ranked('a', 10)}), k AS (SELECT r.query_id, r.product_id, CAST(r.rank AS INT) AS rank, coalesce(j.grade, 0) AS grade FROM r JOIN att ON att.query_id = r.query_id AND att.error IS NULL LEFT JOIN j ON j.query_id = r.query_id AND j.product_id = r.product_id) SELECT * FROM k""")
def calibration_dataset_rows(spark, sf):
    _, rows = calibration.dataset_rows(X.shared_grades(spark, sf), _ranking(spark, sf, 20), _attempted(spark, sf))
    return rows.select("query_id", "product_id", "rank", "grade")


@register("calibration_failure_budget", f"WITH p AS ({POINTS}), {_ATT}, s AS (SELECT count(DISTINCT query_id) AS attempted, count(DISTINCT CASE WHEN error IS NOT NULL THEN query_id END) AS failed FROM att) SELECT attempted, failed, round(failed::DOUBLE / attempted, 4) AS failure_rate, failed <= 25 AND failed::DOUBLE / attempted <= 0.02 AS within_budget FROM s")
def calibration_failure_budget(spark, sf):
    return calibration.failure_budget(_attempted(spark, sf))


@register("missed_relevant_items", f"WITH {_ALL}, {JUDGED}, a AS ({_products('max')}), r AS ({_ranked('a', 10)}) SELECT j.query_id, j.product_id, j.grade FROM j ANTI JOIN r ON r.query_id = j.query_id AND r.product_id = j.product_id WHERE grade > 0")
def missed_relevant_items(spark, sf):
    return calibration.missed_items(X.shared_grades(spark, sf), _ranking(spark, sf))




@register("gate_holdout_comparison", f"""WITH {_OBS}, ss AS (SELECT q.query_id, {_SUBSET.replace('query_id', 'q.query_id')} AS subset, o.product_id, o.grade, o.total_tokens, o.chunk_count, o.top_score FROM q LEFT JOIN o ON o.query_id = q.query_id),
sd AS (SELECT *, 'baseline' AS side, coalesce(total_tokens >= 20 AND chunk_count >= 1 AND top_score >= 0.2, false) AS ok FROM ss UNION ALL SELECT *, 'candidate', coalesce(total_tokens >= 100 AND chunk_count >= 2 AND top_score >= 0.25, false) FROM ss),
pq AS (SELECT subset, side, query_id, count(product_id) AS n, count(*) FILTER (grade > 0) AS r, coalesce(sum(grade) FILTER (grade > 0), 0) AS g, count(*) FILTER (ok) AS an, count(*) FILTER (ok AND grade > 0) AS ar, coalesce(sum(grade) FILTER (ok AND grade > 0), 0) AS ag FROM sd GROUP BY ALL),
hc AS (SELECT subset, side, count(*)::DOUBLE AS q, sum(n)::DOUBLE AS n, sum(r)::DOUBLE AS r, sum(g)::DOUBLE AS g, sum(an)::DOUBLE AS an, sum(ar)::DOUBLE AS ar, sum(ag)::DOUBLE AS ag, count(*) FILTER (r > 0)::DOUBLE AS hq, count(*) FILTER (ar > 0)::DOUBLE AS aq FROM pq GROUP BY ALL),
l AS (SELECT subset, side, unnest(['candidate_hit_rate', 'query_success_rate', 'conditional_query_success_rate', 'query_success_retention', 'acceptance_rate', 'precision_at_accept', 'retrieved_relevant_pass_rate', 'retrieved_relevant_grade_mass_pass_rate']) AS metric,
unnest([hq / q, aq / q, coalesce(aq / nullif(hq, 0), 0), coalesce((aq / q) / nullif(hq / q, 0), 0), coalesce(an / nullif(n, 0), 0), coalesce(ar / nullif(an, 0), 0), coalesce(ar / nullif(r, 0), 0), coalesce(ag / nullif(g, 0), 0)]) AS v FROM hc)
SELECT a.subset, CASE a.subset WHEN 'retrieval_dev_holdout' THEN 'promotion_holdout' WHEN 'faithfulness_dev_seed' THEN 'diagnostic_non_promotion' ELSE 'custom_non_promotion' END AS role, a.metric, round(a.v, 4) AS baseline, round(b.v, 4) AS candidate, round(b.v - a.v, 4) AS delta
FROM l a JOIN l b ON a.subset = b.subset AND a.metric = b.metric WHERE a.side = 'baseline' AND b.side = 'candidate'""")
def gate_holdout_comparison(spark, sf):
    m = F.col("query_id") % 3
    queries = X.queries(spark, sf).select("query_id", F.when(m == 0, "retrieval_dev_holdout").when(m == 1, "faithfulness_dev_seed").otherwise("own").alias("subset"))
    return calibration.holdout_comparison(queries, _observations(spark, sf), (20, 1, 0.2), (100, 2, 0.25))


@register("case_evidence_metrics", f"""WITH {_ALL}, t AS (SELECT c.query_id, c.product_id, CAST(length(coalesce(d.text, '')) // 4 AS BIGINT) AS tokens FROM c LEFT JOIN documents d ON d.doc_id = c.chunk_id)
SELECT query_id, product_id, count(*) AS chunk_count, CAST(sum(tokens) AS BIGINT) AS total_tokens, min(tokens) AS min_chunk_tokens, max(tokens) AS max_chunk_tokens FROM t GROUP BY ALL""")
def case_evidence_metrics(spark, sf):
    """A20 over the evidence of each query's products."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    rows = X.chunks(spark, sf).join(d, "chunk_id", "left").groupBy("query_id", "product_id").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("evidence_texts"))
    return calibration.evidence_metrics(rows).drop("evidence_texts")


@register("limited_queries", "SELECT event_id AS query_id, (SELECT count(*) FROM events) > 50 AS sample_limited FROM events ORDER BY event_id LIMIT 50")
def limited_queries(spark, sf):
    return calibration.limit_queries(table(spark, sf, "events").select(F.col("event_id").alias("query_id")), 50, ["query_id"])


# --- text policies and verification ----------------------------------------------------

QUERY_TEXTS = (
    "latest firmware version of this router", "current draw of a usb hub", "issue tracker for webcam", "webcam with the fewest complaints", "Is the $2024 laptop worth it?", "best laptop of 2024", "should I skip this monitor",
    "comfortable running shoes", "ergonomic office chair", "good one for my kid", "safest power bank for evacuations", "phone case made in the USA", "gen 3 earbuds", "keyboard with return rates", "", "  !!  ", "noise-floor of the microphone",
)
_TEXTS = "v AS (SELECT unnest([" + ", ".join("'" + q.replace("'", "''") + "'" for q in QUERY_TEXTS) + "]) AS text UNION ALL SELECT text FROM benchmark UNION ALL SELECT p_name FROM part)"


def _texts(spark, sf):
    listed = spark.createDataFrame([(q,) for q in QUERY_TEXTS], "text string")
    return listed.unionByName(table(spark, sf, "benchmark").select("text")).unionByName(table(spark, sf, "part").select(F.col("p_name").alias("text")))


_N = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_W = "(^|[^a-z0-9])"
_E = "([^a-z0-9]|$)"
_REC = (
    rf"(regexp_matches(n, '{_W}(latest|newest|recent|updated|up[\s-]+to[\s-]+date|firmware|version|generation|today){_E}') OR (regexp_matches(n, '{_W}current{_E}') AND NOT regexp_matches(n, '{_W}current[\s-]+(draw|flow|input|limit|load|output|rating)\b'))"
    rf" OR regexp_matches(n, '{_W}gen[\s-]+([a-z]|[0-9]+){_E}') OR regexp_matches(n, '(^|[^$0-9a-z_])20[0-9][0-9]\b'))"
)
_NEG = (
    rf"(regexp_matches(n, '{_W}(complaints?|problems?|fail(ed|ing|s|ures?)?|defects?|overheat(ed|ing|s)?|disconnect(ed|ing|s)?|return[\s-]+rates?){_E}') OR (regexp_matches(n, '{_W}issues?{_E}') AND NOT regexp_matches(n, '{_W}issues?[\s-]+track(er|ing)?\b'))"
    rf" OR regexp_matches(n, '{_W}(avoid|broken|battery[\s-]+swelling|double[\s-]+click|crackling|lag|noise[\s-]+floor|not[\s-]+reliable|durability[\s-]+issue|skip|worst){_E}'))"
)


@register("query_slices", f"WITH {_TEXTS}, t AS (SELECT text, {_N} AS n FROM v) SELECT text, {_REC} AS recency_sensitive, {_NEG} AS negative_problem FROM t")
def query_slices(spark, sf):
    s = T.query_slices(F.col("text"))
    return _texts(spark, sf).select("text", F.array_contains(s, T.RECENCY_SLICE).alias("recency_sensitive"), F.array_contains(s, T.NEGATIVE_SLICE).alias("negative_problem"))


def _terms_sql(phrases) -> str:
    listed = ", ".join("'" + p.replace("'", "''") + "'" for p in T._terms(phrases))
    return f"list_filter([{listed}], lambda t: contains(' ' || n || ' ', ' ' || trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) || ' '))"


def _policy_sql() -> str:
    whens = ["WHEN n = '' THEN ['clarify', 'ambiguous_query', '']"]
    scope = f"len({_terms_sql(T.IN_SCOPE)}) > 0"
    for action, reason, phrases, lifted in T.POLICY:
        terms = _terms_sql(phrases)
        whens.append(f"WHEN len({terms}) > 0" + (f" AND NOT ({scope})" if lifted else "") + f" THEN ['{action}', '{reason}', array_to_string({terms}, '|')]")
    return f"WITH {_TEXTS}, t AS (SELECT text, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS n FROM v), d AS (SELECT text, CASE {' '.join(whens)} ELSE ['allow', 'in_scope', ''] END AS d FROM t) SELECT text, d[1] AS action, d[2] AS reason, d[3] AS terms FROM d"


@register("query_policy", _policy_sql())
def query_policy(spark, sf):
    return _texts(spark, sf).withColumn("d", T.query_policy(F.col("text"))).select("text", "d.action", "d.reason", F.array_join("d.terms", "|").alias("terms"))


_EXPL = r"""x AS (SELECT doc_id, text, (CASE WHEN doc_id % 9 = 0 THEN 'It may not be the best match for you: ' WHEN doc_id % 13 = 0 THEN 'Highly recommended and perfect for all: ' ELSE 'Buyers say ' END) || '"' ||
(CASE WHEN doc_id % 5 = 0 THEN 'no such words as these in it ' || doc_id ELSE translate(substr(text, CAST(doc_id * 7919 % greatest(length(text) - 40, 1) AS INT) + 1, 40), '"''' || chr(10) || '[]', '     ') END) || '" [review_' || (CASE WHEN doc_id % 7 = 0 THEN doc_id + 1 ELSE doc_id END) || ']' AS explanation FROM documents)"""
_QUOTES = r"list_filter(list_transform(list_concat(regexp_extract_all(explanation, '\x22([^\x22]+)\x22', 1), regexp_extract_all(explanation, '\x27([^\x27]+)\x27', 1)), lambda y: trim(y)), lambda y: length(y) >= 4)"
_IN = f"(contains({NORM.format('text')}, {NORM.format('y')}) OR (len(string_split({NORM.format('y')}, ' ')) >= 3 AND contains({NORM.format('text')}, array_to_string(string_split({NORM.format('y')}, ' ')[1:greatest(3, CAST(floor(len(string_split({NORM.format('y')}, ' ')) * 0.8::DOUBLE) AS INT))], ' '))))"


@register("quote_verification", f"WITH {_EXPL}, z AS (SELECT doc_id, text, {_QUOTES} AS quotes FROM x), f AS (SELECT doc_id, CAST(len(list_filter(quotes, lambda y: {_IN})) AS BIGINT) AS quotes_found, CAST(len(quotes) AS BIGINT) AS n FROM z) SELECT doc_id, quotes_found, n - quotes_found AS quotes_missing, n = quotes_found AS all_verified FROM f")
def quote_verification(spark, sf):
    return faithfulness.verify_quotes(X.explanations(spark, sf)).select("doc_id", "quotes_found", "quotes_missing", "all_verified")


@register("citation_verification", f"WITH {_EXPL}, z AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN doc_id + 1 ELSE doc_id END AS cited, regexp_extract(explanation, '\"([^\"]+)\"', 1) AS y FROM x) SELECT doc_id, CAST((cited = doc_id AND {_IN})::INT AS BIGINT) AS n_valid, 1 - CAST((cited = doc_id AND {_IN})::INT AS BIGINT) AS n_invalid, cited = doc_id AND {_IN} AS all_valid FROM z")
def citation_verification(spark, sf):
    return faithfulness.verify_citations(X.explanations(spark, sf)).select("doc_id", "n_valid", "n_invalid", "all_valid")


_PH = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in T.FORBIDDEN) + "]"


@register("forbidden_phrases", f"WITH {_EXPL} SELECT doc_id, array_to_string(list_filter({_PH}, lambda p: contains(lower(explanation), p)), '|') AS violations FROM x")
def forbidden_phrases(spark, sf):
    return X.explanations(spark, sf).select("doc_id", F.array_join(T.forbidden_phrases(F.col("explanation")), "|").alias("violations"))


def _any_sql(phrases) -> str:
    return "(" + " OR ".join(f"contains({_N}, '" + p.replace("'", "''") + "')" for p in phrases) + ")"


@register("observed_behavior", f"SELECT conv_id, turn, CASE WHEN {_any_sql(T.REFUSALS)} THEN 'refuse' WHEN {_any_sql(T.CLARIFY)} THEN 'clarify' WHEN {_any_sql(T.MISMATCHES)} THEN 'hedge' ELSE 'answer' END AS behavior FROM conversations")
def observed_behavior(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.observed_behavior(F.col("text")).alias("behavior"))


@register("sentences", r"SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(trim(regexp_replace(regexp_replace(text, '<br ?/>|\n', ' ', 'g'), '\s+', ' ', 'g')), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: s <> '')) AS BIGINT) AS n_sentences FROM documents WHERE text IS NOT NULL")
def sentences(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(T.split_sentences(F.col("text"))).cast("long").alias("n_sentences"))


# --- leakage ---------------------------------------------------------------------------

_TOK = r"list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
_GRAM = r"CASE WHEN trim(regexp_replace(lower({0}), '\s+', ' ', 'g')) = '' THEN [] ELSE list_distinct(list_transform(range(1, length('  ' || trim(regexp_replace(lower({0}), '\s+', ' ', 'g')) || '  ') - 1), lambda i: substr('  ' || trim(regexp_replace(lower({0}), '\s+', ' ', 'g')) || '  ', i, 3))) END"
_SEV = "CASE WHEN exact THEN 'exact_duplicate' WHEN token_jaccard >= 0.75 AND trigram_jaccard >= 0.72 THEN 'high_confidence_near_duplicate' WHEN token_jaccard >= 0.6 OR trigram_jaccard >= 0.68 THEN 'semantic_watchlist' END"


def _pairs_sql(left: str, right: str, on: str) -> str:
    prep = f"SELECT id, text, {_N} AS norm, {_TOK.format('text')} AS tokens, {_GRAM.format('text')} AS grams FROM"

    def shared(c: str) -> str:
        return f"SELECT x.id AS i, y.id AS j, count(*) AS n FROM (SELECT id, unnest({c}) AS e FROM a) x JOIN (SELECT id, unnest({c}) AS e FROM b) y ON x.e = y.e GROUP BY ALL"

    def ratio(n: str, c: str) -> str:
        return f"round(coalesce(coalesce({n}, 0)::DOUBLE / nullif(len(a.{c}) + len(b.{c}) - coalesce({n}, 0), 0), 0), 6)"

    return f"""a AS ({prep} ({left})), b AS ({prep} ({right})), it AS ({shared('tokens')}), ig AS ({shared('grams')}),
iq AS (SELECT a.id AS i, b.id AS j FROM a JOIN b ON a.norm = b.norm), ip AS (SELECT i, j FROM it UNION SELECT i, j FROM ig UNION SELECT i, j FROM iq),
w AS (SELECT a.id AS left_id, b.id AS right_id, {ratio('it.n', 'tokens')} AS token_jaccard, {ratio('ig.n', 'grams')} AS trigram_jaccard, a.norm = b.norm AS exact
      FROM ip JOIN a ON a.id = ip.i JOIN b ON b.id = ip.j LEFT JOIN it ON it.i = ip.i AND it.j = ip.j LEFT JOIN ig ON ig.i = ip.i AND ig.j = ip.j WHERE {on}),
v AS (SELECT left_id, right_id, 0.0::DOUBLE AS cosine, token_jaccard, trigram_jaccard, 0.0::DOUBLE AS item_coverage, {_SEV} AS severity FROM w WHERE severity IS NOT NULL)"""


_SHORT = "SELECT min(p_partkey) AS id, p_name || ' ' || p_type AS text FROM part GROUP BY p_name, p_type UNION ALL SELECT -1 - item_id, text FROM benchmark"
_BENCH = "SELECT min(p_partkey) AS id, p_name || ' ' || p_brand AS text FROM part GROUP BY p_name, p_brand UNION ALL SELECT -1 - item_id, text FROM benchmark"


def _surface(spark, sf):
    """Two surfaces of short texts: names with types, names with brands, and the benchmark in both."""
    b = table(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("id"), "text")
    p = table(spark, sf, "part")
    sides = [p.groupBy("p_name", c).agg(F.min("p_partkey").alias("id")).select("id", F.concat_ws(" ", "p_name", c).alias("text")).unionByName(b) for c in ("p_type", "p_brand")]
    return sides[0], sides[1]


def _leaks(spark, sf):
    left, right = _surface(spark, sf)
    return leakage.flagged_pairs(left, right, "id", "id")


@register("leakage_pairs", f"WITH {_pairs_sql(_SHORT, _BENCH, 'TRUE')} SELECT * FROM v")
def leakage_pairs(spark, sf):
    return _leaks(spark, sf)


_RISK = "s AS (SELECT count(*) FILTER (severity = 'exact_duplicate') AS exact, count(*) FILTER (severity = 'high_confidence_near_duplicate') AS near, count(*) FILTER (severity = 'semantic_watchlist') AS watch, count(DISTINCT right_id) FILTER (severity = 'semantic_watchlist') AS watch_right FROM v) SELECT *, CASE WHEN exact > 0 OR near >= 10 THEN 'high' WHEN near > 0 OR watch_right >= 20 THEN 'moderate' ELSE 'low' END AS risk_level FROM s"


@register("leakage_risk", f"WITH {_pairs_sql(_SHORT, _BENCH, 'TRUE')}, {_RISK}")
def leakage_risk(spark, sf):
    return leakage.leakage_risk(_leaks(spark, sf))


_STRONG = "e AS (SELECT left_id, right_id FROM v WHERE severity IN ('exact_duplicate', 'high_confidence_near_duplicate')), reach(id, other) AS (SELECT id, id FROM (SELECT id FROM a) UNION SELECT r.id, CASE WHEN e.left_id = r.other THEN e.right_id ELSE e.left_id END FROM reach r JOIN e ON e.left_id = r.other OR e.right_id = r.other), k AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"


def _components(spark, sf):
    rows, _ = _surface(spark, sf)
    pairs = leakage.flagged_pairs(rows, rows, "id", "id", same=True).where(F.col("severity") != "semantic_watchlist")
    return leakage.components(rows, pairs)


@register("paraphrase_components", f"WITH RECURSIVE {_pairs_sql(_SHORT, _SHORT, 'a.id < b.id')}, {_STRONG} SELECT id, component FROM k")
def paraphrase_components(spark, sf):
    return _components(spark, sf)


_KEYS = "l AS (SELECT component, count(*) AS members, sha256(string_agg(a.norm || chr(9) || a.id, chr(10) ORDER BY a.norm || chr(9) || a.id)) AS assignment_key FROM k JOIN a USING (id) GROUP BY component) SELECT component, members, 'qpc_' || assignment_key[1:16] AS component_id, assignment_key FROM l"


@register("component_keys", f"WITH RECURSIVE {_pairs_sql(_SHORT, _SHORT, 'a.id < b.id')}, {_STRONG}, {_KEYS}")
def component_keys(spark, sf):
    rows, _ = _surface(spark, sf)
    return leakage.component_keys(_components(spark, sf), rows.select("id", T.squeeze(F.lower("text")).alias("norm")))


def _conversations(spark, sf):
    """Two surfaces of whole texts, every row: conversations, and the benchmark with conversations."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return c, table(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("id"), "text").unionByName(c)


_TURNS = "SELECT conv_id * 100 + turn AS id, text FROM conversations"
_TURNS_TOO = f"SELECT -1 - item_id AS id, text FROM benchmark UNION ALL {_TURNS}"


@register("conversation_leakage_pairs", f"WITH {_pairs_sql(_TURNS, _TURNS_TOO, 'TRUE')} SELECT * FROM v")
def conversation_leakage_pairs(spark, sf):
    return leakage.flagged_pairs(*_conversations(spark, sf), "id", "id", sketches=True)


@register("conversation_leakage_risk", f"WITH {_pairs_sql(_TURNS, _TURNS_TOO, 'TRUE')}, {_RISK}")
def conversation_leakage_risk(spark, sf):
    return leakage.text_risk(*_conversations(spark, sf), "id", "id")


def _conversation_components(spark, sf):
    rows, _ = _conversations(spark, sf)
    return leakage.components(rows, leakage.strong_links(rows, "id"))


@register("conversation_components", f"WITH RECURSIVE {_pairs_sql(_TURNS, _TURNS, 'a.id < b.id')}, {_STRONG} SELECT id, component FROM k")
def conversation_components(spark, sf):
    return _conversation_components(spark, sf)


@register("conversation_component_keys", f"WITH RECURSIVE {_pairs_sql(_TURNS, _TURNS, 'a.id < b.id')}, {_STRONG}, {_KEYS}")
def conversation_component_keys(spark, sf):
    rows, _ = _conversations(spark, sf)
    return leakage.component_keys(_conversation_components(spark, sf), rows.select("id", T.squeeze(F.lower("text")).alias("norm")))


_FRAC = "(('0x' || sha256(CAST(doc_id AS VARCHAR))[1:16])::UBIGINT::DOUBLE / 18446744073709551615.0::DOUBLE)"


@register("split_assignment", f"SELECT doc_id, round({_FRAC}, 12) AS fraction, CASE WHEN {_FRAC} < 0.8 THEN CASE WHEN {_FRAC} / 0.8::DOUBLE < 0.75 THEN 'retrieval_dev_holdout' ELSE 'retrieval_final_report' END ELSE CASE WHEN ({_FRAC} - 0.8::DOUBLE) / (1 - 0.8::DOUBLE) < 1.0::DOUBLE / 3 THEN 'faithfulness_dev_seed' ELSE 'faithfulness_final_seed' END END AS subset FROM documents")
def split_assignment(spark, sf):
    return leakage.split_assignment(table(spark, sf, "documents").select("doc_id"), F.col("doc_id").cast("string"))


@register("point_ids", "SELECT doc_id, md5('review_' || doc_id || '_0') AS point_id FROM documents")
def point_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", V.point_id(F.concat(F.lit("review_"), F.col("doc_id").cast("string")), F.lit(0)).alias("point_id"))


# --- query bank ------------------------------------------------------------------------

_JSRC = "SELECT CASE WHEN l_linestatus = 'O' THEN 'train' ELSE 'test' END AS split, 'q' || (l_orderkey % 500) AS query, l_partkey + l_linenumber % 2 * 1000000 AS product_id, CASE l_returnflag WHEN 'A' THEN 'E' WHEN 'N' THEN 'S' ELSE 'C' END AS label FROM lineitem"
_CORP = "SELECT p_partkey AS product_id FROM part"


def _judgment_rows(spark, sf):
    """Lines as judgments; those with an odd number are of products that the corpus lacks."""
    li = table(spark, sf, "lineitem")
    label = F.when(F.col("l_returnflag") == "A", "E").when(F.col("l_returnflag") == "N", "S").otherwise("C")
    return li.select(F.when(F.col("l_linestatus") == "O", "train").otherwise("test").alias("split"), F.concat(F.lit("q"), F.col("l_orderkey") % 500).alias("query"), (F.col("l_partkey") + F.col("l_linenumber") % 2 * 1000000).alias("product_id"), label.alias("label"))


@register("esci_overlap_bank", f"WITH s AS ({_JSRC}), g AS (SELECT split, query, product_id, max(CASE label WHEN 'E' THEN 3.0::DOUBLE WHEN 'S' THEN 2.0::DOUBLE END) AS grade, list(DISTINCT label) AS l FROM s WHERE label IN ('E', 'S') AND product_id IN ({_CORP}) GROUP BY ALL) SELECT split, query, count(*) AS n_relevant, sum(grade) AS grade_mass, array_to_string(list_sort(list_distinct(flatten(list(l)))), ',') AS labels FROM g GROUP BY ALL HAVING count(*) >= 3")
def esci_overlap_bank(spark, sf):
    corpus = table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"))
    bank = querybank.judged_queries(_judgment_rows(spark, sf), corpus, 3)
    return bank.select("split", "query", "n_relevant", "grade_mass", F.array_join("labels", ",").alias("labels"))


@register("query_candidates", "SELECT p_name AS text, count(*) AS record_count, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS labels, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS locales, min(p_partkey) AS first_row FROM part GROUP BY p_name")
def query_candidates(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_name").alias("text"), F.col("p_type").alias("label"), F.col("p_brand").alias("locale"), F.col("p_partkey").alias("row_id"))
    return querybank.candidates(rows).select("text", "record_count", F.array_join("labels", ",").alias("labels"), F.array_join("locales", ",").alias("locales"), "first_row")


@register("numbered_candidates", "SELECT printf('qc_%05d', row_number() OVER (ORDER BY p_name, p_partkey)) AS query_id, p_name, p_partkey FROM part")
def numbered_candidates(spark, sf):
    return querybank.numbered(table(spark, sf, "part").select("p_name", "p_partkey"), "qc", ["p_name", "p_partkey"]).select("query_id", "p_name", "p_partkey")


@register("numbered_by_size", "SELECT printf('mq_%05d', row_number() OVER (ORDER BY CASE WHEN p_partkey % 31 <> 0 THEN p_size END DESC NULLS FIRST, p_partkey)) AS query_id, p_partkey FROM part")
def numbered_by_size(spark, sf):
    """W9 with integers, in falling order, with nulls."""
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 31 != 0, F.col("p_size")).alias("size"))
    return querybank.numbered(rows, "mq", [F.col("size").desc_nulls_first(), "p_partkey"]).select("query_id", "p_partkey")


@register("corpus_anchor", f"WITH {merkle_sql('m', 'SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS id FROM lineitem')} SELECT n AS products, d AS fingerprint FROM m0")
def corpus_anchor(spark, sf):
    return querybank.corpus_anchor(table(spark, sf, "lineitem"), "l_partkey")


@register("bank_summary", "WITH t AS (SELECT item_id AS id, 'bench' AS s, 'k:' || (item_id % 3) AS g FROM benchmark) SELECT 'source_type' AS kind, s AS value, count(DISTINCT id) AS queries FROM t GROUP BY s UNION ALL SELECT 'tag', g, count(DISTINCT id) FROM t GROUP BY g")
def bank_summary(spark, sf):
    b = table(spark, sf, "benchmark")
    return querybank.bank_summary(b.select(F.col("item_id").alias("query_id"), F.lit("bench").alias("source_type"), F.array(F.concat(F.lit("k:"), F.col("item_id") % 3)).alias("subset_tags")))


# --- guardrails ------------------------------------------------------------------------

_EVID = "ev AS (SELECT user_id AS case_id, event_id, CASE WHEN event_id % 11 <> 0 THEN epoch_us(ts) // 1000 - (event_id % 1500) * 86400000 END AS timestamp_ms, CAST(event_id % 5 + 1 AS DOUBLE) AS rating, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END AS verified_purchase, event_type FROM events)"
_AGE = f"greatest(({X.REFERENCE_MS} - timestamp_ms) / 86400000.0::DOUBLE, 0.0::DOUBLE)"


@register("evidence_age_histogram", f"WITH {_EVID}, g AS (SELECT *, {_AGE} AS age FROM ev) SELECT CASE WHEN timestamp_ms IS NULL THEN 'missing_timestamp' WHEN age <= 30 THEN 'lte_30_days' WHEN age <= 365 THEN 'days_31_to_365' WHEN age <= 1095 THEN 'days_366_to_1095' ELSE 'gt_1095_days' END AS bucket, count(*) AS n FROM g GROUP BY 1")
def evidence_age_histogram(spark, sf):
    return guardrails.age_histogram(X.evidence(spark, sf), X.REFERENCE_MS)


_REPORT = f"""{_EVID}, g AS (SELECT *, CASE WHEN timestamp_ms IS NOT NULL THEN {_AGE} END AS age FROM ev),
rp AS (SELECT case_id, count(*) AS evidence_chunk_count, count(timestamp_ms) AS timestamp_available_count, {_rate('count(timestamp_ms)', 'count(*)')} AS timestamp_available_rate,
strftime(make_timestamp(min(timestamp_ms) * 1000), '%Y-%m-%d') AS evidence_date_min, strftime(make_timestamp(max(timestamp_ms) * 1000), '%Y-%m-%d') AS evidence_date_max,
round(quantile_cont(age, 0.5), 1) AS median_evidence_age_days, round(max(age), 1) AS max_evidence_age_days, count(*) FILTER (age > 365) AS old_review_count, {_rate('count(*) FILTER (age > 365)', 'count(age)')} AS old_review_share,
count(*) FILTER (age > 1095) AS very_old_review_count, {_rate('count(*) FILTER (age > 1095)', 'count(age)')} AS very_old_review_share, count(age) > 0 AND count(*) FILTER (age > 365) = count(age) AS all_timestamped_evidence_old,
count(verified_purchase) AS verified_purchase_available_count, {_rate('count(*) FILTER (verified_purchase)', 'count(verified_purchase)')} AS verified_purchase_true_rate, count(rating) AS rating_available_count,
count(*) FILTER (rating <= 2) AS negative_review_count, {_rate('count(*) FILTER (rating <= 2)', 'count(rating)')} AS negative_review_rate, count(*) FILTER (rating <= 2) > 0 AS has_negative_review_evidence, {X.REFERENCE_MS}::BIGINT AS reference_timestamp_ms, '2024-02-01' AS reference_date, min(timestamp_ms) AS evidence_timestamp_min, max(timestamp_ms) AS evidence_timestamp_max, 365 AS old_review_days_threshold, 1095 AS very_old_review_days_threshold,
count(*) FILTER (verified_purchase) AS verified_purchase_true_count, {_rate('count(verified_purchase)', 'count(*)')} AS verified_purchase_available_rate, count(*) FILTER (age IS NULL) AS missing_timestamp_count, count(*) FILTER (age <= 30) AS recent_count, count(*) FILTER (age > 30 AND age <= 365) AS within_old_count, count(*) FILTER (age > 365 AND age <= 1095) AS within_very_old_count, count(*) FILTER (age > 1095) AS beyond_very_old_count FROM g GROUP BY case_id)"""


@register("evidence_age_report", f"WITH {_REPORT} SELECT * FROM rp")
def evidence_age_report(spark, sf):
    return guardrails.evidence_report(X.evidence(spark, sf), X.REFERENCE_MS)


@register("evidence_report_summary", f"WITH {_REPORT} SELECT count(*) AS report_count, CAST(sum(evidence_chunk_count) AS BIGINT) AS total_evidence_chunks, count(*) FILTER (timestamp_available_count > 0) AS cases_with_any_timestamp_count, count(*) FILTER (all_timestamped_evidence_old) AS cases_all_timestamped_evidence_old_count, count(*) FILTER (has_negative_review_evidence) AS cases_with_negative_review_evidence_count, round(avg(timestamp_available_rate), 4) AS timestamp_available_rate_mean, round(avg(median_evidence_age_days), 1) AS median_evidence_age_days_mean, round(avg(old_review_share), 4) AS old_review_share_mean, round(avg(very_old_review_share), 4) AS very_old_review_share_mean, round(avg(verified_purchase_true_rate), 4) AS verified_purchase_true_rate_mean, round(avg(negative_review_rate), 4) AS negative_review_rate_mean FROM rp")
def evidence_report_summary(spark, sf):
    return guardrails.report_summary(guardrails.evidence_report(X.evidence(spark, sf), X.REFERENCE_MS))


_FRESH = f"""{_REPORT}, fr AS (SELECT *, CASE WHEN case_id % 2 <> 0 THEN 'not_applicable' WHEN timestamp_available_count = 0 THEN 'missing_timestamps' WHEN very_old_review_share >= 1 THEN 'very_stale' WHEN all_timestamped_evidence_old THEN 'stale' ELSE 'fresh_enough' END AS risk_level,
CASE WHEN case_id % 3 = 0 THEN 'hedge' ELSE 'answer' END AS behavior FROM rp), fv AS (SELECT *, risk_level IN ('missing_timestamps', 'very_stale', 'stale') AS applicable, risk_level IN ('missing_timestamps', 'very_stale', 'stale') AND behavior NOT IN ('hedge', 'refuse') AS violation FROM fr)"""


def _fresh(spark, sf):
    reports = guardrails.evidence_report(X.evidence(spark, sf), X.REFERENCE_MS)
    return guardrails.freshness_risk(reports, F.col("case_id") % 2 == 0, F.when(F.col("case_id") % 3 == 0, "hedge").otherwise("answer"))


@register("freshness_risk", f"WITH {_FRESH} SELECT case_id, risk_level, behavior, applicable, violation FROM fv")
def freshness_risk(spark, sf):
    return _fresh(spark, sf).select("case_id", "risk_level", "behavior", "applicable", "violation")


@register("freshness_summary", f"""WITH {_FRESH}, fsum AS (SELECT count(*) AS cases, count(*) FILTER (risk_level <> 'not_applicable') AS recency_sensitive, count(*) FILTER (applicable) AS applicable_cases, count(*) FILTER (violation) AS violations, round(count(*) FILTER (violation)::DOUBLE / nullif(count(*) FILTER (applicable), 0), 4) AS violation_rate,
count(*) FILTER (applicable AND NOT violation) AS safe_cases, round(count(*) FILTER (applicable AND NOT violation)::DOUBLE / nullif(count(*) FILTER (applicable), 0), 4) AS safe_rate FROM fv)
SELECT *, concat_ws(',', CASE WHEN recency_sensitive < 3 THEN 'too_few_recency_sensitive_cases' END, CASE WHEN applicable_cases < 3 THEN 'too_few_applicable_cases' END) AS coverage_failure_reasons, CASE WHEN recency_sensitive < 3 OR applicable_cases < 3 THEN 'insufficient_coverage' WHEN violation_rate > 0 THEN 'blocked' ELSE 'pass' END AS promotion_status FROM fsum""")
def freshness_summary(spark, sf):
    return guardrails.freshness_summary(_fresh(spark, sf))


@register("freshness_counters", f"WITH {_FRESH} SELECT 'risk_level' AS counter, risk_level AS value, count(*) AS n FROM fv WHERE applicable GROUP BY 2 UNION ALL SELECT 'behavior', behavior, count(*) FROM fv WHERE applicable GROUP BY 2 UNION ALL SELECT 'recency_risk_level', risk_level, count(*) FROM fv WHERE risk_level <> 'not_applicable' GROUP BY 2")
def freshness_counters(spark, sf):
    return guardrails.freshness_counters(_fresh(spark, sf))


_CASES = "bc AS (SELECT doc_id AS query_id, CASE doc_id % 4 WHEN 0 THEN 'refuse' WHEN 1 THEN 'clarify' WHEN 2 THEN 'hedge_or_refuse' ELSE 'answer' END AS expected, CASE WHEN quality = 1 AND toxic = 0 THEN CASE doc_id % 4 WHEN 0 THEN 'refuse' WHEN 1 THEN 'clarify' WHEN 2 THEN 'hedge' ELSE 'answer' END WHEN toxic = 1 THEN 'answer' ELSE 'hedge' END AS observed FROM labels)"


def _cases(spark, sf):
    m = F.col("doc_id") % 4
    expected = F.when(m == 0, "refuse").when(m == 1, "clarify").when(m == 2, "hedge_or_refuse").otherwise("answer")
    good = F.when(m == 0, "refuse").when(m == 1, "clarify").when(m == 2, "hedge").otherwise("answer")
    return table(spark, sf, "labels").select(F.col("doc_id").alias("query_id"), expected.alias("expected"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), good).when(F.col("toxic") == 1, "answer").otherwise("hedge").alias("observed"))


@register("behavior_confusion", f"WITH {_CASES} SELECT expected, {', '.join(f'count(*) FILTER (observed = {chr(39)}{b}{chr(39)}) AS {b}' for b in guardrails.BEHAVIORS)} FROM bc GROUP BY expected")
def behavior_confusion(spark, sf):
    return guardrails.behavior_confusion(_cases(spark, sf))


# --- faithfulness ----------------------------------------------------------------------


@register("judge_agreement", "SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 1) AS both_pass, count(*) FILTER (quality = 0 AND toxic = 0) AS both_fail, count(*) FILTER (quality = 1 AND toxic = 0) AS first_only, count(*) FILTER (quality = 0 AND toxic = 1) AS second_only, round(avg((quality = toxic)::INT::DOUBLE), 6) AS agreement, round(coalesce(corr(quality, toxic), 0), 6) AS correlation FROM labels")
def judge_agreement(spark, sf):
    return faithfulness.judge_agreement(table(spark, sf, "labels"), F.col("quality"), F.col("toxic"))


_SCORED = f"{_EXPL}, sc AS (SELECT doc_id, explanation, round(('0x' || md5(CAST(doc_id AS VARCHAR))[1:8])::UBIGINT::DOUBLE / 4294967295.0::DOUBLE, 6) AS score FROM x)"


@register("claim_report", f"WITH {_SCORED}, p AS (SELECT doc_id % 200 AS explanation_id, count(*) AS n, count(*) FILTER (score >= 0.5) AS p, sum(score) AS s, min(score) AS lo, max(score) AS hi FROM sc GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS claims, count(*) AS explanations, round(sum(s) / sum(n), 6) AS avg_score, min(lo) AS min_score, max(hi) AS max_score, round(sum(p) / sum(n), 6) AS pass_rate, count(*) FILTER (n = p) AS all_pass, count(*) FILTER (p < n) AS any_fail FROM p")
def claim_report(spark, sf):
    return faithfulness.claim_report(X.scored(spark, sf).select((F.col("doc_id") % 200).alias("explanation_id"), "score"))


@register("adjusted_faithfulness", f"""WITH {_SCORED}, f AS (SELECT score >= 0.5 AS ok, {_any_sql(T.REFUSALS + T.MISMATCHES).replace('text', 'explanation')} AS non FROM sc), s AS (SELECT count(*) AS n_total, count(*) FILTER (non) AS n_refusals, count(*) FILTER (ok) AS raw, count(*) FILTER (ok OR non) AS n_passed FROM f)
SELECT n_total, n_refusals, n_total - n_refusals AS n_evaluated, round(raw::DOUBLE / n_total, 6) AS raw_pass_rate, round(n_passed::DOUBLE / n_total, 6) AS adjusted_pass_rate, round(n_refusals::DOUBLE / n_total, 6) AS refusal_rate, n_passed, n_total - n_passed AS n_failed FROM s""")
def adjusted_faithfulness(spark, sf):
    return faithfulness.adjusted_faithfulness(X.scored(spark, sf))


@register("faithfulness_by_lang", f"WITH {_SCORED} SELECT d.lang, count(score) AS n, round(avg(score), 6) AS mean, min(score) AS min, max(score) AS max, round(coalesce(stddev_samp(score), 0), 6) AS std, round(avg((score >= 0.5)::INT::DOUBLE), 6) AS pass_rate FROM sc JOIN documents d USING (doc_id) GROUP BY d.lang")
def faithfulness_by_lang(spark, sf):
    return faithfulness.score_report(X.scored(spark, sf).select("doc_id", "score").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id"), ("lang",))


@register("stratified_sample", """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 17 <> 0 THEN lang END AS lang FROM documents), c AS (SELECT lang, count(*) AS n FROM d GROUP BY lang),
f AS (SELECT *, CASE WHEN count(*) OVER () <= 100 THEN 1 ELSE 0 END AS first FROM c), i AS (SELECT *, n - first AS lft, 100 - sum(first) OVER () AS rest FROM f),
j AS (SELECT *, CAST(rest * lft AS DOUBLE) / sum(lft) OVER () AS ideal FROM i), b AS (SELECT *, least(lft, CAST(floor(ideal) AS BIGINT)) AS base FROM j),
q AS (SELECT *, first + base + CASE WHEN lft > base AND row_number() OVER (ORDER BY (lft > base)::INT DESC, ideal - base DESC, n DESC, lang DESC NULLS LAST) <= 100 - sum(first + base) OVER () THEN 1 ELSE 0 END AS quota FROM b),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) AS r FROM d) SELECT r.doc_id, r.lang FROM r JOIN q ON r.lang IS NOT DISTINCT FROM q.lang WHERE r.r <= q.quota""")
def stratified_sample(spark, sf):
    """W13, with a stratum of documents without a language."""
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 17 != 0, F.col("lang")).alias("lang"))
    return faithfulness.stratified_sample(rows, "lang", 100, "doc_id")


@register("premise_packing", "WITH d AS (SELECT doc_id, source, text, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents), b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d) SELECT doc_id, source, CASE WHEN before + tokens > 508 THEN text[1:CAST((508 - before) * 4 AS INT)] ELSE text END AS text FROM b WHERE before < 508 OR before = 0")
def premise_packing(spark, sf):
    return faithfulness.pack_budget(table(spark, sf, "documents").select("doc_id", "source", "text"), "source", ["doc_id"])


@register("confidence_terciles", f"WITH {_SCORED}, v AS (SELECT doc_id, score, CASE WHEN doc_id % 19 <> 0 THEN score END AS confidence FROM sc), o AS (SELECT score, doc_id, row_number() OVER (ORDER BY confidence NULLS FIRST, doc_id) - 1 AS i, count(*) OVER () AS n FROM v) SELECT CASE WHEN i < n // 3 THEN 'low' WHEN i < 2 * n // 3 THEN 'mid' ELSE 'high' END AS tercile, count(*) AS rows, round(avg(score), 6) AS mean_score FROM o GROUP BY 1")
def confidence_terciles(spark, sf):
    rows = X.scored(spark, sf).select("doc_id", "score", F.when(F.col("doc_id") % 19 != 0, F.col("score")).alias("confidence"))
    return faithfulness.tercile_means(rows, "confidence", "score", "doc_id")


# --- serving ---------------------------------------------------------------------------


@register("latency_summary", "SELECT event_type, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(coalesce(stddev_samp(value), 0), 6) AS std FROM events GROUP BY event_type")
def latency_summary(spark, sf):
    return serving.latency_summary(table(spark, sf, "events"), ("event_type",), "value")


_SAMPLES = """sp AS (SELECT CASE WHEN event_id % 10 = 0 THEN 'warmup' ELSE 'measured' END AS phase, CASE WHEN event_id % 17 = 0 THEN 503 WHEN event_id % 29 <> 0 THEN 200 END AS status, CASE event_id % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'semantic' WHEN 2 THEN 'miss' WHEN 3 THEN 'unknown' END AS cache_result, event_type AS query, value,
CASE WHEN event_id % 3 <> 0 THEN round(value * 0.8, 3) END AS server_ms, event_id % 4 <> 0 AS timing, event_id % 5 < 3 AS header, CASE WHEN event_id % 6 <> 0 THEN event_id % 7 <> 0 END AS grounded, CASE WHEN event_id % 6 <> 0 THEN event_id % 14 <> 0 END AS aware FROM events)"""


def _samples(spark, sf):
    i = F.col("event_id")
    known = F.when(i % 5 == 0, "exact").when(i % 5 == 1, "semantic").when(i % 5 == 2, "miss").when(i % 5 == 3, "unknown")
    return table(spark, sf, "events").select(
        F.when(i % 10 == 0, "warmup").otherwise("measured").alias("phase"), F.when(i % 17 == 0, 503).when(i % 29 != 0, 200).alias("status"), known.alias("cache_result"), F.col("event_type").alias("query"), "value",
        F.when(i % 3 != 0, F.round(F.col("value") * 0.8, 3)).alias("server_ms"), (i % 4 != 0).alias("server_timing_header_present"), (i % 5 < 3).alias("cache_result_header_present"),
        F.when(i % 6 != 0, i % 7 != 0).alias("grounded_success"), F.when(i % 6 != 0, i % 14 != 0).alias("refusal_aware_success"),
    )


@register("load_phase_summary", f"""WITH {_SAMPLES} SELECT phase, count(*) AS total_requests, count(*) FILTER (status = 200) AS successful, count(*) FILTER (coalesce(status, 0) <> 200) AS errors, count(*) FILTER (status = 200 AND timing) AS timing_headers, count(*) FILTER (status = 200 AND header) AS cache_headers,
count(*) FILTER (status = 200 AND cache_result IN ('exact', 'semantic')) AS cache_hits, round(count(*) FILTER (status = 200 AND cache_result IN ('exact', 'semantic'))::DOUBLE / nullif(count(*) FILTER (status = 200 AND cache_result <> 'unknown'), 0), 4) AS cache_hit_rate, count(*) FILTER (status = 200 AND grounded IS NOT NULL) AS judged,
round(count(*) FILTER (status = 200 AND grounded)::DOUBLE / nullif(count(*) FILTER (status = 200 AND grounded IS NOT NULL), 0), 4) AS grounded_rate, round(count(*) FILTER (status = 200 AND grounded IS NOT NULL AND aware)::DOUBLE / nullif(count(*) FILTER (status = 200 AND grounded IS NOT NULL), 0), 4) AS refusal_aware_rate, count(DISTINCT query) AS queries FROM sp GROUP BY phase""")
def load_phase_summary(spark, sf):
    return serving.phase_summary(_samples(spark, sf))


@register("load_status_counts", f"WITH {_SAMPLES} SELECT phase, CAST(status AS VARCHAR) AS status, count(*) AS requests FROM sp GROUP BY phase, status")
def load_status_counts(spark, sf):
    return serving.status_counts(_samples(spark, sf))


@register("headline_metric", f"WITH {_SAMPLES} SELECT round(quantile_cont(server_ms, 0.95), 6) AS headline_ms, 'server' AS source, round(quantile_cont(server_ms, 0.95), 6) <= 500 AS pass FROM sp WHERE phase = 'measured'")
def headline_metric(spark, sf):
    rows = _samples(spark, sf).where("phase = 'measured'")
    server, client = (serving.latency_summary(rows, value=v).select(F.col("p95").alias(n)) for v, n in (("server_ms", "server_p95"), ("value", "client_p95")))
    return serving.headline(server.join(F.broadcast(client)))


@register("headline_fallback", f"WITH {_SAMPLES} SELECT round(quantile_cont(value, 0.95), 6) AS headline_ms, 'client_fallback' AS source, round(quantile_cont(value, 0.95), 6) <= 500 AS pass FROM sp WHERE phase = 'warmup'")
def headline_fallback(spark, sf):
    s = serving.latency_summary(_samples(spark, sf).where("phase = 'warmup'"), value="value")
    return serving.headline(s.select(F.lit(None).cast("double").alias("server_p95"), F.col("p95").alias("client_p95")))


@register("cache_stats", "WITH RECURSIVE r AS (SELECT event_id AS request_id, epoch_us(ts) AS t, event_type || ':' || (user_id % 20) AS key, event_id % 100 / 100.0::DOUBLE AS sim FROM events), m(key, t) AS (SELECT key, min(t) FROM r GROUP BY key UNION ALL SELECT m.key, min(r.t) FROM m JOIN r ON r.key = m.key AND r.t > m.t + 3600000000 GROUP BY m.key), f AS (SELECT m.key, min(r.request_id) AS request_id FROM m JOIN r ON r.key = m.key AND r.t = m.t GROUP BY m.key, m.t), h AS (SELECT r.sim, f.request_id IS NULL AS hit FROM r LEFT JOIN f USING (key, request_id)) SELECT count(*) AS requests, count(*) FILTER (hit) AS hits, round(avg(hit::INT::DOUBLE), 6) AS hit_rate, round(avg(sim) FILTER (hit), 6) AS avg_similarity FROM h")
def cache_stats(spark, sf):
    found = serving.exact_cache(X.requests(spark, sf)).withColumn("similarity", (F.col("request_id") % 100) / 100.0)
    return serving.cache_stats(found, "similarity")


@register("cache_exact_sim", """WITH RECURSIVE r AS (SELECT event_id AS request_id, epoch_us(ts) AS t, event_type || ':' || (user_id % 20) AS key FROM events),
m(key, t) AS (SELECT key, min(t) FROM r GROUP BY key UNION ALL SELECT m.key, min(r.t) FROM m JOIN r ON r.key = m.key AND r.t > m.t + 3600000000 GROUP BY m.key),
f AS (SELECT m.key, min(r.request_id) AS request_id FROM m JOIN r ON r.key = m.key AND r.t = m.t GROUP BY m.key, m.t)
SELECT r.key, r.request_id, f.request_id IS NULL AS hit FROM r LEFT JOIN f USING (key, request_id)""")
def cache_exact_sim(spark, sf):
    return serving.exact_cache(X.requests(spark, sf))


@register("cache_lag_hits", "WITH r AS (SELECT event_id AS request_id, ts, event_type || ':' || (user_id % 20) AS key FROM events) SELECT request_id, key, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY key ORDER BY ts, request_id) <= 3600000000, false) AS hit FROM r")
def cache_lag_hits(spark, sf):
    return serving.lag_hits(X.requests(spark, sf), "key", "ts", 3600).select("request_id", "key", "hit")


@register("request_counters", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS requests, round(sum(value), 4) AS total, count(*) FILTER (value <= 50) AS le_50, count(*) FILTER (value <= 100) AS le_100, count(*) FILTER (value <= 250) AS le_250, count(*) FILTER (value <= 500) AS le_500 FROM events GROUP BY ALL")
def request_counters(spark, sf):
    return serving.request_counters(table(spark, sf, "events"))


def _doc_chunks(spark, sf):
    return chunking.chunk_reviews(table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "text"))


def _last(mark: str) -> str:
    """Characters of the fifth before the last of a mark, if that is not at its beginning."""
    cut = f"length(regexp_extract(tail, '(?s)^(.*){mark}', 1))"
    return f"CASE WHEN regexp_matches(tail, '(?s){mark}') AND {cut} > 0 THEN s + 480 + {cut} + 1 END"


_WINDOW_END = f"(SELECT CASE WHEN s + 600 < length(x) THEN coalesce({_last('[.] ')}, {_last('! ')}, {_last('[?] ')}, {_last(chr(92) + 'n')}, s + 600) ELSE s + 600 END FROM (SELECT {{t}} AS x, {{s}} AS s, substr({{t}}, {{s}} + 481, 120) AS tail))"
_CHUNKS = rf"""st AS (SELECT doc_id AS review_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL), lt AS (SELECT * FROM st WHERE length(t) // 4 > 200),
w(review_id, t, i, b, e) AS (SELECT review_id, t, 0, 0, {_WINDOW_END.format(t='t', s='0')} FROM lt UNION ALL SELECT review_id, t, i + 1, e - 120, {_WINDOW_END.format(t='t', s='(e - 120)')} FROM w WHERE e < length(t)),
cw AS (SELECT review_id, i, regexp_replace(substr(t, b + 1, e - b), '^\s+|\s+$', '', 'g') AS text FROM w), ck AS (SELECT review_id, i, text FROM cw WHERE text <> '' UNION ALL SELECT review_id, 0, t FROM st WHERE t <> '' AND length(t) // 4 <= 200),
ch AS (SELECT review_id, CAST(row_number() OVER (PARTITION BY review_id ORDER BY i) - 1 AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY review_id) AS INT) AS total_chunks, text FROM ck)"""


@register("chunk_sliding_window", f"WITH RECURSIVE {_CHUNKS} SELECT * FROM ch")
def chunk_sliding_window(spark, sf):
    return _doc_chunks(spark, sf)


@register("chunks_per_review", f"WITH RECURSIVE {_CHUNKS}, n AS (SELECT review_id, count(*) AS n_chunks FROM ch GROUP BY review_id) SELECT n_chunks, count(*) AS reviews FROM n GROUP BY n_chunks")
def chunks_per_review(spark, sf):
    return serving.chunks_per_review(_doc_chunks(spark, sf))


_HV = "list_transform(range(0, 8), lambda i: ('0x' || md5(sentence || '|' || i)[1:8])::UBIGINT::DOUBLE / 4294967295.0::DOUBLE * 2 - 1)"
_SENT = r"list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(regexp_replace(t, '<br ?/>|\n', ' ', 'g'), '\s+', ' ', 'g')), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@register("topic_chunks", rf"""WITH st AS (SELECT doc_id AS review_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL), sl AS (SELECT review_id, {_SENT} AS l FROM st WHERE length(t) // 4 > 200),
sn AS (SELECT review_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS sentence FROM sl WHERE len(l) > 2), sv AS (SELECT *, {_HV} AS h FROM sn), sc AS (SELECT *, round(list_dot_product(h, lead(h) OVER (PARTITION BY review_id ORDER BY pos)), 6) AS sim FROM sv),
se AS (SELECT *, quantile_cont(sim, 0.15) OVER (PARTITION BY review_id) AS edge FROM sc), sk AS (SELECT *, coalesce(sum((sim < edge)::INT) OVER (PARTITION BY review_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM se)
SELECT review_id, CAST(chunk AS BIGINT) AS chunk, string_agg(sentence, ' ' ORDER BY pos) AS text FROM sk GROUP BY review_id, chunk""")
def topic_chunks(spark, sf):
    """W5, W6 with vectors that a hash of the sentence gives (M7)."""
    sentences = chunking.sentences_of(table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "text"))
    return chunking.topic_chunks(sentences.withColumn("vector", V.hash_cells(F.col("sentence"))))


@register("corpus_statistics", "SELECT count(*) AS chunks, count(DISTINCT doc_id) AS reviews, count(DISTINCT doc_id % 50) AS products, quantile_cont(length(text), 0.5) AS median_chars, round(avg(length(text)), 6) AS mean_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars FROM documents")
def corpus_statistics(spark, sf):
    return serving.corpus_statistics(table(spark, sf, "documents").select("text", F.col("doc_id").alias("review_id"), (F.col("doc_id") % 50).alias("product_id")))


@register("review_months", "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1 DESC LIMIT 24")
def review_months(spark, sf):
    return serving.month_histogram(table(spark, sf, "lineitem"), "l_shipdate")


@register("first_ratings", "WITH r AS (SELECT l_partkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS i FROM lineitem) SELECT l_quantity AS rating, count(*) AS n FROM r WHERE i = 1 GROUP BY 1")
def first_ratings(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("o", F.struct("l_orderkey", "l_linenumber", "l_quantity"))
    return serving.first_ratings(li, "l_partkey", "l_quantity", "o")


@register("chars_per_token", "SELECT count(n_chars / nullif(length(text) // 4, 0)) AS n, round(avg(n_chars / nullif(length(text) // 4, 0)), 6) AS mean, round(stddev_samp(n_chars / nullif(length(text) // 4, 0)), 6) AS std FROM documents")
def chars_per_token(spark, sf):
    return serving.chars_per_token(table(spark, sf, "documents").withColumn("tokens", T.estimate_tokens(F.col("text"))), "n_chars", "tokens")
