"""Recommendations from history and query, and the request path from policy to cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import REFUSAL_MESSAGES, RECENCY_SLICE, cache_key, explanation_prompt, forbidden_phrases, query_policy, query_slices, refusal_message, sanitize_query, strip
from tidemark.operators.faithfulness import verify_citations
from tidemark.operators.guardrails import evidence_report, freshness_risk
from tidemark.operators.retrieval import evidence_gate, product_scores, ranked, user_history, warmup_level, weighted_ranking

# Least ratings by level, the query of somebody without one, and what a level's scores are.
MIN_RATING = {"cold": 4.0, "warming": 4.0, "warm": 3.0}
DEFAULT_QUERY = "highly rated quality products"
METHOD = {"cold": "max", "warming": "max", "warm": "weighted_mean"}
KEPT, CHARS = 5, 300


def history_queries(users: DataFrame, history: DataFrame, order: list[str]) -> DataFrame:
    """``user_id, level, query_text`` of each user of ``users`` (``user_id, query``).

    Without history the query, or the default one; with a little, the query and what the
    user liked; with more, what they liked alone: the first 300 characters of the first five
    texts rated 4 or more, of any texts if none is.
    """
    liked = user_history(history, order).select("user_id", "place", F.substring(F.coalesce("text", F.lit("")), 1, CHARS).alias("t"))
    texts = liked.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda s: s["t"]), " ").alias("liked"))
    count = history.groupBy("user_id").agg(F.count("*").alias("n"))
    rows = users.join(count, "user_id", "left").join(texts, "user_id", "left").withColumn("level", warmup_level(F.col("n")))
    asked = F.when(strip(F.col("query")) != "", F.col("query"))
    text = F.when(F.col("level") == "cold", F.coalesce(asked, F.lit(DEFAULT_QUERY))).when(F.col("level") == "warming", F.concat_ws(" ", asked, F.col("liked"))).otherwise(F.col("liked"))
    return rows.select("user_id", "level", text.alias("query_text"))


def hybrid_recommend(levels: DataFrame, chunks: DataFrame, history: DataFrame, k: int = 10) -> DataFrame:
    """``user_id, product_id, score, rank`` from the chunks that each user's query found.

    ``levels``: ``user_id, level``; ``chunks``: ``query_id`` (the user), ``chunk_id,
    product_id, score, rating``.  A level has its own least rating and its own way to score
    products; what the user knows already goes after the cut, so that fewer may be left.
    """
    least = F.lit(None).cast("double")
    for level, value in MIN_RATING.items():
        least = F.when(F.col("level") == level, F.lit(value)).otherwise(least)
    of_user = chunks.join(levels.select(F.col("user_id").alias("query_id"), "level"), "query_id").where(F.col("rating") >= least)
    parts = [weighted_ranking(product_scores(of_user.where(F.col("level").isin(*[v for v, m in METHOD.items() if m == method])), method)) for method in sorted(set(METHOD.values()))]
    top = ranked(parts[0].unionByName(parts[1]), k)
    known = history.select(F.col("user_id").alias("query_id"), "product_id").distinct()
    return top.join(known, ["query_id", "product_id"], "left_anti").select(F.col("query_id").alias("user_id"), "product_id", "score", "rank")


def best_evidence(chunks: DataFrame) -> DataFrame:
    """``query_id, product_id`` with the chunk of the highest score (of equal ones the least id)."""
    top = F.min_by(F.struct("chunk_id", "score"), F.struct(-F.col("score"), F.col("chunk_id")))
    return chunks.groupBy("query_id", "product_id").agg(top.alias("b")).select("query_id", "product_id", F.col("b.chunk_id").alias("chunk_id"), F.col("b.score").alias("score"))


def explain(products: DataFrame, reference_ms: int, min_chunks: int = 1, min_tokens: int = 20, min_score: float = 0.7, most: int = 3) -> DataFrame:
    """P20: what each product is explained by: ``products`` with ``source, explanation, prompt, violations, all_valid``.

    ``products``: ``query_id, query, product_id, avg_rating, chunk_count, total_tokens,
    top_score``, ``evidence`` (structs ``review_id, rating, text, timestamp_ms,
    verified_purchase``), and the model's texts as columns: ``draft``, and ``retry``, asked
    for with stricter instructions (null where it wasn't).

    In order: too little evidence is refused; a query for what is recent, with evidence that
    is old or undated, is hedged; else the draft stands, or the retry if the draft has
    forbidden phrases and there is one.  Citations are checked against the evidence shown.
    """
    gated = evidence_gate(products, min_chunks, min_tokens, min_score)
    keyed = gated.withColumn("__case", F.concat_ws("|", F.col("query_id").cast("string"), F.col("product_id").cast("string")))
    pieces = keyed.select(F.col("__case").alias("case_id"), F.explode_outer("evidence").alias("e")).where("e is not null").select("case_id", "e.timestamp_ms", "e.rating", "e.verified_purchase")
    reports = evidence_report(pieces, reference_ms).select(F.col("case_id").alias("__case"), "timestamp_available_count", "very_old_review_share", "all_timestamped_evidence_old")
    rows = keyed.join(reports, "__case", "left").na.fill({"timestamp_available_count": 0})
    rows = freshness_risk(rows, F.array_contains(query_slices(F.col("query")), RECENCY_SLICE), F.lit("answer"))
    rows = rows.withColumn("__prompt", explanation_prompt(F.col("query"), F.col("product_id"), F.col("avg_rating"), F.col("chunk_count"), F.col("evidence"), most))
    again = (F.size(forbidden_phrases(F.coalesce("draft", F.lit("")))) > 0) & F.col("retry").isNotNull()
    hedge = F.concat(F.lit("This may not be the best match for a query about what is recent: the review evidence is "), F.replace(F.col("risk_level"), F.lit("_"), F.lit(" ")), F.lit("."))
    source = F.when(~F.col("is_sufficient"), "quality_gate_refusal").when(F.col("applicable"), "freshness_hedge").when(again, "retry").otherwise("draft")
    rows = rows.withColumn("source", source)
    text = F.when(F.col("source") == "quality_gate_refusal", refusal_message(F.col("query"), F.col("refusal_type"), F.col("chunk_count"), F.col("total_tokens"))).when(F.col("source") == "freshness_hedge", hedge).when(F.col("source") == "retry", F.col("retry")).otherwise(F.col("draft"))
    written = F.col("source").isin("draft", "retry")
    rows = rows.withColumns({"explanation": strip(text), "prompt": F.when(written, F.col("__prompt.prompt")), "prompt_kind": F.when(written, F.col("__prompt.kind")), "evidence_texts": F.col("__prompt.texts"), "evidence_ids": F.col("__prompt.ids")})
    rows = verify_citations(rows.withColumn("explanation", F.coalesce("explanation", F.lit(""))))
    rows = rows.withColumns({"violations": F.when(written, forbidden_phrases(F.col("explanation"))), "all_valid": F.when(written, F.col("all_valid"))})
    return rows.select(*products.columns, "source", "refusal_type", "risk_level", "prompt_kind", "prompt", "explanation", "violations", "all_valid")


def handle_requests(requests: DataFrame, cached: DataFrame, products: DataFrame, k: Column, explain_flag: Column, min_rating: Column) -> DataFrame:
    """``requests`` (``request_id, query``) with how each is answered: ``sanitized, cache_key, path, behavior, returned``.

    ``path`` is ``policy`` where the query policy ends the request, ``cache`` where ``cached``
    (``cache_key``) has its key and it asks for explanations, ``empty`` without a product,
    else ``explained`` or ``listed``.  ``products``: ``request_id, product_id``, what the
    search found for it; ``returned`` counts them, and ``put`` says what goes into the cache.
    """
    rows = requests.withColumn("sanitized", sanitize_query(F.col("query"))).withColumn("__d", query_policy(F.col("sanitized")))
    rows = rows.withColumn("cache_key", cache_key(F.col("sanitized"), k, explain_flag, min_rating)).withColumn("__explain", explain_flag)
    found = products.groupBy("request_id").agg(F.count_distinct("product_id").alias("__n"))
    rows = rows.join(cached.select("cache_key", F.lit(True).alias("__hit")).distinct(), "cache_key", "left").join(found, "request_id", "left")
    hit = F.col("__explain") & F.col("__hit").isNotNull()
    n = F.coalesce("__n", F.lit(0))
    path = F.when(F.col("__d.action") != "allow", "policy").when(hit, "cache").when(n == 0, "empty").when(F.col("__explain"), "explained").otherwise("listed")
    rows = rows.withColumn("path", path)
    live = F.col("path").isin("explained", "listed")
    return rows.select("request_id", "sanitized", "cache_key", "path", F.when(F.col("path") == "policy", F.col("__d.action")).otherwise("allow").alias("behavior"), F.when(live, F.least(n, k.cast("long"))).otherwise(0).alias("returned"), (F.col("path") == "explained").alias("put"))


def product_rows(ranking: DataFrame, chunks: DataFrame, texts: DataFrame, most: int = 5) -> DataFrame:
    """Ranked products with their evidence as ``explain`` wants it: the best chunks of each, with text, stars, time and flag.

    ``texts``: ``chunk_id, review_id, text, timestamp_ms, verified_purchase``.
    """
    own = Window.partitionBy("query_id", "product_id").orderBy(F.desc("score"), "chunk_id")
    best = chunks.join(ranking.select("query_id", "product_id"), ["query_id", "product_id"], "left_semi").withColumn("__r", F.row_number().over(own))
    full = best.join(texts, "chunk_id", "left")
    piece = F.struct("__r", F.col("review_id"), "rating", F.coalesce("text", F.lit("")).alias("text"), "timestamp_ms", "verified_purchase")
    sums = full.groupBy("query_id", "product_id").agg(
        F.count("*").alias("chunk_count"), F.floor(F.coalesce(F.sum(F.length("text")), F.lit(0)) / 4).alias("total_tokens"), F.max("score").alias("top_score"), F.avg("rating").alias("avg_rating"),
        F.array_sort(F.collect_list(F.when(F.col("__r") <= most, piece))).alias("evidence"),
    )
    return ranking.select("query_id", "product_id", "rank").join(sums, ["query_id", "product_id"])


def refusal_reasons() -> list[str]:
    """The reasons that have a message of their own."""
    return [r for r in REFUSAL_MESSAGES if r is not None]
