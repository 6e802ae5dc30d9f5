"""Queries over cases, boundary behaviour, checks, recommendations, texts and banks, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import boundary, cases, checks, faithfulness, fingerprints, guardrails, leakage, querybank, recommend, retrieval
from tidemark.plans import fixtures as X
from tidemark.plans import registry as R
from tidemark.plans.registry import register
from tidemark.session import table

# --- texts -----------------------------------------------------------------------------

EXPLANATIONS = (
    'Reviewers say "great sound" [review_1] and "long battery" [review_22].', 'According to reviews, customers report "sharp picture" [review_3] . One reviewer confirms it  works ,  mostly.', "One user said   fine", 'Users note "a". "b" [review_9]',
    "reviewers also mention heat", "", "Nothing to clean here.", 'One reviewer describes it as "solid" and "heavy" [review_77] .', "Reviewer call it good", "One reviewer likes it", "Users also note x [review_12]  and   y",
)


def _lit(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _clean_sql(text: str) -> str:
    out = f"regexp_replace({text}, '\\s*\\[review_[0-9]+\\]', '', 'g')"
    phrases = [
        "according to reviews?,?\\s*", "customers report\\s+", "reviewers?\\s+call\\s+it\\s+", "reviewers?\\s+describe\\s+(it|this)\\s+as\\s+", "reviewers?\\s+find\\s+it\\s+", "reviewers?\\s+report\\s+", "reviewers say\\s+",
        "one user said\\s+", "one user found\\s+", "one reviewer found\\s+", "one reviewer confirms?\\s+(it\\s+)?", "one reviewer\\s+calls?\\s+it\\s+", "one reviewer\\s+describes?\\s+it\\s+as\\s+", "one reviewer\\s+", "users mention\\s+",
        "users also note\\s+", "users note\\s+", "reviewers?\\s+(also\\s+)?note\\s+", "reviewers?\\s+(also\\s+)?mention\\s+", "reviewers?\\s+confirm\\s+", "reviewers?\\s+praise\\s+", "reviewers?\\s+highlight\\s+",
    ]
    for p in phrases:
        out = f"regexp_replace({out}, '{p}', '', 'gi')"
    for p, r in (('\\s+and\\s+"', '. The product is "'), ('\\.\\s+"', '. The product is "'), ("\\s+\\.", "."), ("\\s+,", ","), ("\\s{2,}", " "), ("^\\s+|\\s+$", "")):
        out = f"regexp_replace({out}, '{p}', '{r}', 'g')"
    return out


_SAID = "xs AS (SELECT unnest([" + ", ".join(_lit(e) for e in EXPLANATIONS) + "]) AS text UNION ALL SELECT text FROM conversations)"


@register("cleaned_explanations", f"WITH {_SAID} SELECT text, {_clean_sql('text')} AS cleaned FROM xs")
def cleaned_explanations(spark, sf):
    rows = spark.createDataFrame([(e,) for e in EXPLANATIONS], "text string").unionByName(table(spark, sf, "conversations").select("text"))
    return rows.select("text", T.clean_explanation(F.col("text")).alias("cleaned"))


_REFUSED = "rf AS (SELECT item_id, text, CASE item_id % 4 WHEN 0 THEN 'insufficient_chunks' WHEN 1 THEN 'insufficient_tokens' WHEN 2 THEN 'low_relevance' END AS reason, item_id % 3 AS chunks, item_id * 7 AS tokens, CASE WHEN length(text) <= 100 THEN replace(text, '\"', '''') ELSE substr(replace(text, '\"', ''''), 1, 97) || '...' END AS q FROM benchmark)"


@register("refusal_messages", f"""WITH {_REFUSED} SELECT item_id, CASE reason
WHEN 'insufficient_chunks' THEN 'I cannot provide a confident recommendation for this product based on the available review evidence. Only ' || chunks || ' review excerpt(s) were found, which is insufficient to make a well-grounded recommendation for your query about "' || q || '".'
WHEN 'insufficient_tokens' THEN 'I cannot provide a meaningful recommendation for this product. The available review evidence is too brief (' || tokens || ' tokens) to support a well-grounded explanation for your query about "' || q || '".'
WHEN 'low_relevance' THEN 'I found reviews for this product, but none of them discuss "' || q || '" specifically. The reviews I found focus on other features or use cases, so I cannot provide a grounded recommendation for what you''re asking.' || chr(10) || chr(10) || 'You could try:' || chr(10) || '- Broadening your search (e.g., "wireless earbuds" instead of "wireless earbuds for running")' || chr(10) || '- Asking about a specific feature mentioned in the product description' || chr(10) || '- Searching for a different product that better matches your needs'
ELSE 'I cannot provide a recommendation for this product due to insufficient review evidence for your query about "' || q || '".' END AS message FROM rf""")
def refusal_messages(spark, sf):
    i = F.col("item_id")
    reason = F.when(i % 4 == 0, "insufficient_chunks").when(i % 4 == 1, "insufficient_tokens").when(i % 4 == 2, "low_relevance")
    return table(spark, sf, "benchmark").select("item_id", T.refusal_message(F.col("text"), reason, i % 3, i * 7).alias("message"))


def _evidence(spark, sf):
    """The first five documents of a language that are pieces of evidence of each of forty products, in order of their ids."""
    d = table(spark, sf, "documents").withColumn("product", F.col("doc_id") % 40)
    place = F.row_number().over(Window.partitionBy("lang", "product").orderBy("doc_id"))
    piece = F.struct("doc_id", F.concat(F.lit("review_"), F.col("doc_id").cast("string")).alias("review_id"), F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 6).cast("double")).alias("rating"), "text")
    return d.withColumn("i", place).where("i <= 5").groupBy("lang", "product").agg(F.array_sort(F.collect_list(piece)).alias("evidence"))


_CLEAN_Q = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '[\r\n\t]+', ' ', 'g'), '[\x00-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g'))"


@register("formatted_evidence", f"""WITH e AS (SELECT lang, doc_id % 40 AS product, doc_id, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 6 AS DOUBLE) END AS rating, text, row_number() OVER (PARTITION BY lang, doc_id % 40 ORDER BY doc_id) AS i FROM documents),
s AS (SELECT *, {_CLEAN_Q} AS clean FROM e)
SELECT lang, product, coalesce(string_agg('[review_' || doc_id || '] (' || CAST(coalesce(rating, 0) AS INT) || '/5 stars): "' || clean || '"', chr(10) || chr(10) ORDER BY i) FILTER (i <= 5), '(No review evidence available)') AS evidence,
count(rating) FILTER (i <= 3) >= 2 AND coalesce(max(rating) FILTER (i <= 3) - min(rating) FILTER (i <= 3), 0) >= 2 AS mixed, string_agg('review_' || doc_id, ',' ORDER BY i) FILTER (i <= 3) AS ids FROM s GROUP BY lang, product""")
def formatted_evidence(spark, sf):
    """T20, R1."""
    e = F.col("evidence")
    return _evidence(spark, sf).select("lang", "product", T.format_evidence(e).alias("evidence"), T.mixed_ratings(e).alias("mixed"), F.array_join(T.evidence_lists(e, 3)["ids"], ",").alias("ids"))


@register("json_digests", """SELECT p_partkey, sha256('{"name":"' || p_name || '","size":' || p_size || ',"type":null}') AS digest FROM part""")
def json_digests(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.json_digest(size=F.col("p_size"), name=F.col("p_name"), type=F.lit(None).cast("string")).alias("digest"))


# --- cases -----------------------------------------------------------------------------

_BUND = f"""{R._OBS}, att AS (SELECT query_id, CASE WHEN query_id % 150 = 0 THEN 'timeout' END AS error FROM q), ra AS ({R._ranked('a', 10)}),
b1 AS (SELECT ra.query_id, ra.product_id, o.chunk_count, o.total_tokens, o.top_score FROM ra JOIN o ON o.query_id = ra.query_id AND o.product_id = ra.product_id WHERE ra.rank = 1 AND ra.query_id % 100 <> 50),
oc AS (SELECT att.query_id, CASE WHEN error IS NOT NULL THEN 'retrieval_error' WHEN b1.product_id IS NULL THEN 'no_candidates_retrieved' ELSE 'bundled' END AS outcome_status, CASE WHEN error IS NULL THEN b1.product_id END AS product_id, CASE WHEN error IS NULL THEN chunk_count END AS chunk_count,
CASE WHEN error IS NULL THEN total_tokens END AS total_tokens, CASE WHEN error IS NULL THEN top_score END AS top_score, CASE WHEN error IS NULL AND b1.product_id IS NOT NULL THEN 'faithfulness_dev_seed:' || att.query_id END AS bundle_id FROM att LEFT JOIN b1 ON b1.query_id = att.query_id)"""
_BUND_A = _BUND.replace(", att AS", f", a AS ({R._products('max')}), att AS", 1)


def _outcomes(spark, sf):
    """Queries with an error for each third and no candidates for each other one; the rest have a best product."""
    attempted = X.queries(spark, sf).select("query_id", F.col("query_id").cast("string").alias("query"), F.when(F.col("query_id") % 150 == 0, "timeout").alias("error"))
    best = R._ranking(spark, sf).select("query_id", "product_id", "rank").join(R._observed(spark, sf).select("query_id", "product_id", "chunk_count", "total_tokens", "top_score"), ["query_id", "product_id"]).where("query_id % 100 <> 50")
    return cases.freeze_bundles(attempted, best.select("query_id", "product_id", "rank", "chunk_count", "total_tokens", "top_score"), "faithfulness_dev_seed")


@register("seed_bundle_outcomes", f"WITH {_BUND_A} SELECT query_id, outcome_status, product_id, chunk_count, top_score, bundle_id FROM oc")
def seed_bundle_outcomes(spark, sf):
    return _outcomes(spark, sf).select("query_id", "outcome_status", "product_id", "chunk_count", "top_score", "bundle_id")


@register("seed_bundle_summary", f"WITH {_BUND_A}, sm AS (SELECT count(*) AS total_queries, count(*) FILTER (outcome_status = 'bundled') AS bundled, count(*) FILTER (outcome_status = 'no_candidates_retrieved') AS no_candidates, count(*) FILTER (outcome_status = 'retrieval_error') AS errors FROM oc) SELECT *, total_queries - bundled AS not_bundled, round(bundled::DOUBLE / total_queries, 6) AS bundle_rate FROM sm")
def seed_bundle_summary(spark, sf):
    return cases.bundle_summary(_outcomes(spark, sf))


_MAT = f"{_BUND_A}, mc AS (SELECT *, CASE WHEN outcome_status <> 'bundled' THEN NULL WHEN chunk_count < 2 THEN 'insufficient_chunks' WHEN total_tokens < 400 THEN 'insufficient_tokens' WHEN top_score < 0.3 THEN 'low_relevance' END AS why FROM oc), md AS (SELECT query_id, CASE WHEN outcome_status <> 'bundled' THEN outcome_status WHEN why IS NULL THEN 'materialized' ELSE 'insufficient_evidence' END AS outcome_status, CASE WHEN outcome_status = 'bundled' AND why IS NULL THEN 'case:' || bundle_id END AS case_id, why AS gate_refusal_type FROM mc)"


def _materialized(spark, sf):
    return cases.materialize_cases(_outcomes(spark, sf), 2, 400, 0.3)


@register("materialized_cases", f"WITH {_MAT} SELECT * FROM md")
def materialized_cases(spark, sf):
    return _materialized(spark, sf).select("query_id", "outcome_status", "case_id", "gate_refusal_type")


@register("case_outcome_summary", f"""WITH {_MAT}, sm AS (SELECT count(*) AS total_queries, count(*) FILTER (outcome_status = 'materialized') AS materialized, count(*) FILTER (outcome_status = 'insufficient_evidence') AS insufficient, count(*) FILTER (outcome_status = 'no_candidates_retrieved') AS no_candidates, count(*) FILTER (outcome_status = 'retrieval_error') AS errors FROM md)
SELECT *, total_queries - materialized AS not_materialized, materialized + insufficient AS with_candidates, round(materialized::DOUBLE / total_queries, 6) AS materialization_rate, round((materialized + insufficient)::DOUBLE / total_queries, 6) AS candidate_rate, round(coalesce(materialized::DOUBLE / nullif(materialized + insufficient, 0), 0), 6) AS gate_pass_rate FROM sm""")
def case_outcome_summary(spark, sf):
    return cases.case_summary(_materialized(spark, sf))


@register("case_field_counts", f"WITH {_MAT} SELECT 'outcome_status' AS field, outcome_status AS value, count(*) AS n FROM md GROUP BY outcome_status UNION ALL SELECT 'gate_refusal_type', gate_refusal_type, count(*) FROM md WHERE gate_refusal_type IS NOT NULL GROUP BY gate_refusal_type")
def case_field_counts(spark, sf):
    return cases.field_counts(_materialized(spark, sf), ("outcome_status", "gate_refusal_type"))


_INV = """o AS (SELECT event_id AS query_id, CASE WHEN event_id % 5 = 0 THEN 'no_candidates_retrieved' ELSE 'bundled' END AS status, CASE WHEN event_id % 31 = 0 THEN 'other' ELSE 's' END AS o_subset, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id END AS o_id, user_id AS product, CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_type END AS kind FROM events),
b AS (SELECT event_id AS query_id, 's' AS b_subset, CASE WHEN event_id % 17 = 0 THEN event_id + 1 ELSE event_id END AS b_id, CASE WHEN event_id % 19 = 0 THEN user_id + 1 ELSE user_id END AS product, event_type AS kind FROM events WHERE event_id % 7 <> 0),
z AS (SELECT coalesce(o.query_id, b.query_id) AS query_id, o.query_id IS NOT NULL AS has_o, b.query_id IS NOT NULL AS has_b, coalesce(o.status = 'bundled', false) AS marked, o.o_subset, b.b_subset, o.o_id, b.b_id, o.product AS op, b.product AS bp, o.kind AS ok, b.kind AS bk FROM o FULL JOIN b ON o.query_id = b.query_id)"""


@register("bundle_inventory", f"""WITH {_INV} SELECT query_id, 'missing_bundle' AS problem FROM z WHERE marked AND NOT has_b UNION ALL SELECT query_id, 'unexpected_bundle' FROM z WHERE has_b AND NOT marked UNION ALL SELECT query_id, 'bundle_subset' FROM z WHERE has_b AND b_subset IS DISTINCT FROM 's'
UNION ALL SELECT query_id, 'outcome_subset' FROM z WHERE has_o AND o_subset IS DISTINCT FROM 's' UNION ALL SELECT query_id, 'bundle_id' FROM z WHERE has_b AND marked AND o_id IS NOT NULL AND o_id IS DISTINCT FROM b_id
UNION ALL SELECT query_id, 'field:product' FROM z WHERE has_b AND marked AND op IS DISTINCT FROM bp UNION ALL SELECT query_id, 'field:kind' FROM z WHERE has_b AND marked AND ok IS DISTINCT FROM bk""")
def bundle_inventory(spark, sf):
    """J14, U5 over events, some of them without a bundle, some with another subset, id, product or kind."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    outcomes = e.select(
        i.alias("query_id"), F.when(i % 5 == 0, "no_candidates_retrieved").otherwise("bundled").alias("outcome_status"), F.when(i % 31 == 0, "other").otherwise("s").alias("source_subset"),
        F.when(i % 13 != 0, i).alias("bundle_id"), F.col("user_id").alias("product"), F.when(i % 23 != 0, F.col("event_type")).alias("kind"),
    )
    bundles = e.where(i % 7 != 0).select(i.alias("query_id"), F.lit("s").alias("source_subset"), F.when(i % 17 == 0, i + 1).otherwise(i).alias("bundle_id"), F.when(i % 19 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("product"), F.col("event_type").alias("kind"))
    return cases.inventory_problems(bundles, outcomes, "s", ("product", "kind"))


_CL = "cl AS (SELECT doc_id AS explanation_id, round(('0x' || md5(doc_id || '/' || i)[1:8])::UBIGINT::DOUBLE / 4294967295.0::DOUBLE, 6) AS score FROM (SELECT doc_id, unnest(range(0, doc_id % 4)) AS i FROM documents))"
_MM = f"""{R._SCORED}, {_CL}, ex AS (SELECT sc.doc_id AS explanation_id, sc.explanation, sc.score, x.text FROM sc JOIN x ON x.doc_id = sc.doc_id), qz AS (SELECT explanation_id, text, {R._QUOTES} AS quotes FROM ex),
qf AS (SELECT explanation_id, CAST(len(list_filter(quotes, lambda y: {R._IN})) AS BIGINT) AS found, CAST(len(quotes) AS BIGINT) AS n FROM qz), cp AS (SELECT explanation_id, count(*) AS n, count(*) FILTER (score >= 0.5) AS p, sum(score) AS s, min(score) AS lo FROM cl GROUP BY explanation_id),
mm AS (SELECT ex.explanation_id, ex.explanation, ex.score, qf.found, qf.n AS quotes, coalesce(cp.n, 1) AS n, coalesce(cp.p, (ex.score >= 0.5)::INT) AS p, coalesce(cp.s, ex.score) AS s, coalesce(cp.lo, ex.score) AS lo FROM ex JOIN qf USING (explanation_id) LEFT JOIN cp USING (explanation_id))"""
_MMS = "count(*) AS samples, CAST(sum(found) AS BIGINT) AS quotes_found, CAST(sum(quotes) AS BIGINT) AS quotes_total, CAST(sum(n) AS BIGINT) AS claims, min(lo) AS claim_min_score, round(avg((score >= 0.5)::INT::DOUBLE), 4) AS full_pass_rate, round(avg(score), 4) AS full_avg_score, round(coalesce(sum(found)::DOUBLE / nullif(sum(quotes), 0), 0), 4) AS quote_rate, round(sum(p)::DOUBLE / sum(n), 4) AS claim_pass_rate, round(sum(s) / sum(n), 4) AS claim_avg_score"


def _claims(spark, sf):
    """None to three claims of each explanation."""
    n = F.col("doc_id") % 4
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("explanation_id"), F.posexplode(F.array_repeat(F.lit(1), n.cast("int"))).alias("i", "one"))
    share = F.conv(F.substring(F.md5(F.concat_ws("/", F.col("explanation_id").cast("string"), F.col("i").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967295.0
    return d.select("explanation_id", F.round(share, 6).alias("score"))


def _explained(spark, sf):
    return X.scored(spark, sf).withColumnRenamed("doc_id", "explanation_id")


@register("multi_metric_report", f"WITH {_MM} SELECT {_MMS} FROM mm")
def multi_metric_report(spark, sf):
    return cases.multi_metric_report(_explained(spark, sf), _claims(spark, sf))


@register("slice_report", f"""WITH {_MM}, sl AS (SELECT *, unnest(list_distinct(['k' || (explanation_id % 3), CASE WHEN explanation_id % 2 = 0 THEN 'even' ELSE 'k' || (explanation_id % 3) END])) AS slice FROM mm),
g AS (SELECT slice, {_MMS}, count(*) FILTER ({R._any_sql(T.REFUSALS).replace('text', 'explanation')}) AS refusals, count(*) FILTER (score < 0.5) AS failed FROM sl GROUP BY slice)
SELECT *, round(refusals::DOUBLE / samples, 4) AS refusal_rate, round(failed::DOUBLE / samples, 4) AS failure_rate, round(samples::DOUBLE / (SELECT count(*) FROM mm), 4) AS share FROM g""")
def slice_report(spark, sf):
    """A42 with rows in one slice or two."""
    k = F.concat(F.lit("k"), (F.col("explanation_id") % 3).cast("string"))
    return cases.slice_report(_explained(spark, sf), _claims(spark, sf), F.array(k, F.when(F.col("explanation_id") % 2 == 0, "even").otherwise(k)))


@register("case_diagnostics", f"""WITH {R._REPORT}, cs AS (SELECT DISTINCT user_id AS case_id, CASE user_id % 3 WHEN 0 THEN 'latest webcam of 2024' WHEN 1 THEN 'avoid broken cables' ELSE 'a good lamp' END AS query, CASE user_id % 4 WHEN 0 THEN 'I cannot recommend this' WHEN 1 THEN 'It is not suitable for it' ELSE 'It is fine' END AS explanation, CAST(user_id % 10 AS DOUBLE) / 10 AS score FROM events),
dd AS (SELECT cs.*, rp.evidence_chunk_count, coalesce(rp.timestamp_available_count, 0) AS ta, rp.very_old_review_share AS vo, rp.all_timestamped_evidence_old AS old FROM cs LEFT JOIN rp ON rp.case_id = cs.case_id),
df AS (SELECT *, case_id % 3 = 0 AS recent, case_id % 4 = 0 AS refused, score < 0.5 AS hallucinated, CASE case_id % 4 WHEN 0 THEN 'refuse' WHEN 1 THEN 'hedge' ELSE 'answer' END AS behavior FROM dd),
dg AS (SELECT *, CASE WHEN NOT recent THEN 'not_applicable' WHEN ta = 0 THEN 'missing_timestamps' WHEN vo >= 1 THEN 'very_stale' WHEN old THEN 'stale' ELSE 'fresh_enough' END AS risk_level FROM df)
SELECT case_id, refused, hallucinated, behavior, risk_level, risk_level IN ('missing_timestamps', 'very_stale', 'stale') AS applicable, risk_level IN ('missing_timestamps', 'very_stale', 'stale') AND behavior NOT IN ('hedge', 'refuse') AS violation, evidence_chunk_count FROM dg""")
def case_diagnostics(spark, sf):
    u = table(spark, sf, "events").select(F.col("user_id").alias("case_id")).distinct()
    i = F.col("case_id")
    own = u.select("case_id", F.when(i % 3 == 0, "latest webcam of 2024").when(i % 3 == 1, "avoid broken cables").otherwise("a good lamp").alias("query"))
    said = u.select("case_id", F.when(i % 4 == 0, "I cannot recommend this").when(i % 4 == 1, "It is not suitable for it").otherwise("It is fine").alias("explanation"), ((i % 10).cast("double") / 10).alias("score"))
    reports = guardrails.evidence_report(X.evidence(spark, sf), X.REFERENCE_MS)
    return cases.case_diagnostics(own, said, reports).select("case_id", "refused", "hallucinated", "behavior", "risk_level", "applicable", "violation", "evidence_chunk_count")


@register("confidence_correlations", f"WITH {R._SCORED}, v AS (SELECT score, length(text)::DOUBLE AS size, doc_id % 7 AS k FROM sc JOIN documents USING (doc_id)) SELECT 'size' AS signal, round(corr(size, score), 6) AS correlation FROM v UNION ALL SELECT 'k', round(corr(k, score), 6) FROM v UNION ALL SELECT 'one', 0.0::DOUBLE")
def confidence_correlations(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.length("text").alias("size"), (F.col("doc_id") % 7).alias("k"), F.lit(1).alias("one"))
    return faithfulness.confidence_correlations(X.scored(spark, sf).select("doc_id", "score").join(d, "doc_id"), "score", ("size", "k", "one"))


@register("grounding_delta", f"WITH {R._SCORED}, v AS (SELECT CASE WHEN doc_id % 5 <> 0 THEN score END AS a, CASE WHEN doc_id % 3 <> 0 THEN round(score / 2, 6) END AS b FROM sc) SELECT count(a) AS n_with, count(b) AS n_without, round(avg(a), 6) AS mean_with, round(avg(b), 6) AS mean_without, round(avg(a) - avg(b), 6) AS delta FROM v")
def grounding_delta(spark, sf):
    i = F.col("doc_id")
    rows = X.scored(spark, sf).select(F.when(i % 5 != 0, F.col("score")).alias("a"), F.when(i % 3 != 0, F.round(F.col("score") / 2, 6)).alias("b"))
    return faithfulness.grounding_delta(rows, "a", "b")


# --- boundary behaviour ----------------------------------------------------------------

OPENINGS = (*R.QUERY_TEXTS, *(f"{a} {b}" for a in ("latest", "good one:", "safest", "worst", "plain", "current", "avoid any") for b in ("webcam", "router", "puppy food", "usb hub", "laptop", "monitor for my kid")))
#: ``i, text``: benchmark items and turns of conversations, each behind one of the openings, so that every rule of the policy is met.
_ROWS = f"(SELECT i, ([{', '.join(_lit(t) for t in OPENINGS)}])[1 + i % {len(OPENINGS)}] || ' ' || coalesce(text, '') AS text FROM (SELECT item_id AS i, text FROM benchmark UNION ALL SELECT 1000000 + conv_id * 100 + turn, text FROM conversations))"


def _rows(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("i"), "text")
    turns = table(spark, sf, "conversations").select((1_000_000 + F.col("conv_id") * 100 + F.col("turn")).alias("i"), "text")
    opening = F.element_at(F.array(*[F.lit(t) for t in OPENINGS]), (F.col("i") % len(OPENINGS) + 1).cast("int"))
    return items.unionByName(turns).select("i", F.concat(opening, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))



def _entries(spark, sf):
    """Bank rows of which some have provenance, some tags, some neither."""
    i = F.col("i")
    return _rows(spark, sf).select(
        i.cast("long").alias("query_id"), "text", F.when(i % 5 == 0, "out_of_scope").when(i % 5 == 1, "ambiguous").when(i % 5 == 2, "boundary").when(i % 5 == 3, "answerable").alias("answerability"),
        F.array(F.lit("boundary_eval"), F.concat(F.lit("boundary_type:"), F.when(i % 2 == 0, "ambiguous_query").otherwise(" ")), F.when(i % 7 == 0, "behavior:refuse").otherwise("x"), F.when(i % 3 == 0, "evaluation_surface:policy_terminal").otherwise("evaluation_lane:runtime_e2e"), F.lit("challenge_tag:c1")).alias("subset_tags"),
        F.when(i % 11 == 0, " clarify ").alias("expected_behavior"), F.when(i % 4 == 0, "low_evidence_boundary").alias("boundary_type"), F.when(i % 13 == 0, "runtime_e2e").alias("evaluation_surface"),
        F.when(i % 17 == 0, "policy_terminal").alias("evaluation_lane"), F.when(i % 6 == 0, F.array(F.lit("own"), F.lit(" "))).alias("challenge_tags"),
    )


_CTX = f"""en AS {_ROWS},
cx AS (SELECT CAST(i AS BIGINT) AS query_id, text AS query, {_CLEAN_Q} AS sq, CASE WHEN i % 11 = 0 THEN 'clarify' WHEN i % 7 = 0 THEN 'refuse' ELSE CASE i % 5 WHEN 0 THEN 'refuse' WHEN 1 THEN 'clarify' WHEN 2 THEN 'hedge_or_refuse' ELSE 'answer' END END AS expected,
CASE WHEN i % 4 = 0 THEN 'low_evidence_boundary' WHEN i % 2 = 0 THEN 'ambiguous_query' END AS boundary_type, CASE WHEN i % 13 = 0 THEN 'runtime_e2e' WHEN i % 17 = 0 THEN 'policy_terminal' WHEN i % 3 = 0 THEN 'policy_terminal' ELSE 'runtime_e2e' END AS surface, CASE WHEN i % 6 = 0 THEN 'own' ELSE 'c1' END AS tag FROM en)"""


@register("boundary_context", f"WITH {_CTX} SELECT query_id, sq AS sanitized_query, expected, boundary_type, surface AS evaluation_surface, tag AS challenge_tags FROM cx")
def boundary_context(spark, sf):
    return boundary.case_context(_entries(spark, sf)).select("query_id", "sanitized_query", "expected", "boundary_type", "evaluation_surface", F.array_join("challenge_tags", ",").alias("challenge_tags"))


def _policy_of(text: str, source: str) -> str:
    """The policy SQL of the registry over other texts."""
    sql = R._policy_sql()
    body = sql[sql.index("t AS (SELECT text") :]
    return body[: body.rindex(" SELECT text, d[1]")].replace("FROM v", f"FROM {source}").replace("t AS (SELECT text", f"pt AS (SELECT {text} AS text", 1).replace("lower(text)", f"lower({text})").replace("FROM t)", "FROM pt)").replace("d AS (SELECT text", "pd AS (SELECT text")


_EVAL = f"""{_CTX}, {_policy_of('sq', 'cx')}, pu AS (SELECT DISTINCT text, d FROM pd),
pr AS (SELECT i AS query_id, unnest(CASE i % 6 WHEN 0 THEN ['refuse', 'answer'] WHEN 1 THEN ['refuse', 'refuse'] WHEN 2 THEN ['hedge', 'refuse', 'error'] WHEN 3 THEN ['error'] WHEN 4 THEN ['clarify', 'hedge'] ELSE [] END) AS observed FROM en),
pa AS (SELECT query_id, count(*) AS n, bool_or(observed = 'answer') AS an, bool_or(observed = 'clarify') AS cl, bool_or(observed = 'hedge') AS he, bool_or(observed = 'refuse') AS re FROM pr GROUP BY query_id),
e1 AS (SELECT cx.*, pu.d, cx.query_id % 10 = 9 AS failed, pa.n, CASE WHEN an THEN 'answer' WHEN cl THEN 'clarify' WHEN he THEN 'hedge' WHEN re THEN 'refuse' WHEN n > 0 THEN 'error' ELSE 'refuse' END AS said,
CASE WHEN an THEN 'query_contains_direct_answer' WHEN cl THEN 'query_contains_clarification' WHEN he THEN 'query_contains_mismatch_warning' WHEN re THEN 'all_products_refused' WHEN n > 0 THEN 'all_product_evaluations_failed' ELSE 'no_candidates_retrieved' END AS src FROM cx JOIN pu ON pu.text = cx.sq LEFT JOIN pa ON pa.query_id = cx.query_id),
bev AS (SELECT *, CASE WHEN d[1] <> 'allow' THEN d[1] WHEN failed THEN 'error' ELSE said END AS observed, CASE WHEN d[1] <> 'allow' THEN 'query_policy:' || d[2] WHEN failed THEN 'retrieval_error' ELSE src END AS behavior_source, d[1] = 'allow' AS reached, CASE WHEN d[1] <> 'allow' OR failed THEN 0 ELSE coalesce(n, 0) END AS products FROM e1),
em AS (SELECT *, NOT (reached AND failed) AND expected = observed AS strict_match, NOT (reached AND failed) AND (expected = observed OR (expected = 'hedge_or_refuse' AND observed IN ('hedge', 'refuse'))) AS acceptable_match, CASE surface WHEN 'runtime_e2e' THEN reached WHEN 'policy_terminal' THEN NOT reached ELSE false END AS kept FROM bev)"""
_RECENT = R._REC.replace("(n, ", "(" + R._N.replace("text", "query") + ", ")


def _evaluated(spark, sf):
    rows = _entries(spark, sf)
    i = F.col("query_id")
    failed = rows.where(i % 10 == 9).select("query_id", F.lit("timeout").alias("error"))
    lists = [["refuse", "answer"], ["refuse", "refuse"], ["hedge", "refuse", "error"], ["error"], ["clarify", "hedge"]]
    said = F.array().cast("array<string>")
    for k, names in enumerate(lists):
        said = F.when(i % 6 == k, F.array(*[F.lit(n) for n in names])).otherwise(said)
    products = rows.select("query_id", F.posexplode(said).alias("product_id", "observed"))
    return boundary.evaluate_cases(boundary.case_context(rows), failed, products)


@register("boundary_cases", f"WITH {_EVAL} SELECT query_id, expected, observed, behavior_source, reached AS retrieval_path_reached, CAST(products AS BIGINT) AS retrieved_product_count, strict_match, acceptable_match, kept AS surface_contract_satisfied FROM em")
def boundary_cases(spark, sf):
    return _evaluated(spark, sf).select("query_id", "expected", "observed", "behavior_source", "retrieval_path_reached", "retrieved_product_count", "strict_match", "acceptable_match", "surface_contract_satisfied")


def _share(a: str, b: str) -> str:
    return f"round(coalesce({a}::DOUBLE / nullif({b}, 0), 0), 4)"


_BSUM = f"""{_EVAL}, rc AS (SELECT *, {_RECENT} AS recent FROM em), bs AS (SELECT count(*) AS total_queries, count(*) FILTER (strict_match) AS strict_matches, count(*) FILTER (acceptable_match) AS acceptable_matches, count(*) FILTER (observed = 'error') AS error_count,
count(*) FILTER (surface = 'runtime_e2e' AND recent) AS runtime_e2e_recency_sensitive_total, count(*) FILTER (expected = 'refuse') AS refusal_required_total, count(*) FILTER (expected = 'refuse' AND observed = 'answer') AS refusal_required_false_accept_count,
count(*) FILTER (expected = 'clarify') AS ambiguous_total, count(*) FILTER (expected = 'clarify' AND observed = 'clarify') AS ambiguous_clarify_count, count(*) FILTER (expected = 'clarify' AND observed = 'answer') AS ambiguous_direct_answer_count,
count(*) FILTER (expected = 'hedge_or_refuse') AS boundary_safe_behavior_total, count(*) FILTER (expected = 'hedge_or_refuse' AND acceptable_match) AS boundary_safe_behavior_count,
count(*) FILTER (surface = 'policy_terminal') AS policy_terminal_total, count(*) FILTER (surface = 'policy_terminal' AND kept) AS policy_terminal_surface_contract_pass_count,
count(*) FILTER (surface = 'runtime_e2e') AS runtime_e2e_total, count(*) FILTER (surface = 'runtime_e2e' AND kept) AS runtime_e2e_surface_contract_pass_count,
count(*) FILTER (recent) AS freshness_sensitive_total, count(*) FILTER (recent AND observed = 'refuse') AS freshness_sensitive_refusal_count, count(*) AS surface_contract_total, count(*) FILTER (kept) AS surface_contract_pass_count FROM rc),
bt AS (SELECT *, {_share('strict_matches', 'total_queries')} AS strict_match_rate, {_share('acceptable_matches', 'total_queries')} AS acceptable_match_rate, {_share('refusal_required_false_accept_count', 'refusal_required_total')} AS refusal_required_false_accept_rate,
{_share('ambiguous_clarify_count', 'ambiguous_total')} AS ambiguous_clarify_rate, {_share('ambiguous_direct_answer_count', 'ambiguous_total')} AS ambiguous_direct_answer_rate, {_share('boundary_safe_behavior_count', 'boundary_safe_behavior_total')} AS boundary_safe_behavior_rate,
{_share('policy_terminal_surface_contract_pass_count', 'policy_terminal_total')} AS policy_terminal_surface_contract_pass_rate, {_share('runtime_e2e_surface_contract_pass_count', 'runtime_e2e_total')} AS runtime_e2e_surface_contract_pass_rate,
CASE WHEN freshness_sensitive_total > 0 THEN {_share('freshness_sensitive_refusal_count', 'freshness_sensitive_total')} END AS freshness_sensitive_refusal_rate, {_share('surface_contract_pass_count', 'surface_contract_total')} AS surface_contract_pass_rate FROM bs)"""


@register("boundary_summary", f"WITH {_BSUM} SELECT * FROM bt")
def boundary_summary(spark, sf):
    return boundary.summary(_evaluated(spark, sf))


@register("boundary_counters", f"WITH {_EVAL} SELECT 'boundary_type' AS counter, coalesce(boundary_type, 'unknown') AS value, count(*) AS n FROM em GROUP BY 2 UNION ALL SELECT 'expected', expected, count(*) FROM em GROUP BY 2 UNION ALL SELECT 'observed', observed, count(*) FROM em GROUP BY 2 UNION ALL SELECT 'evaluation_surface', surface, count(*) FROM em GROUP BY 2 UNION ALL SELECT 'behavior_source', behavior_source, count(*) FROM em GROUP BY 2 UNION ALL SELECT 'challenge_tag', tag, count(*) FROM em GROUP BY 2")
def boundary_counters(spark, sf):
    return boundary.counters(_evaluated(spark, sf))


@register("boundary_confusion", f"WITH {_EVAL} SELECT expected, {', '.join(f'count(*) FILTER (observed = {chr(39)}{b}{chr(39)}) AS {b}' for b in ('answer', 'clarify', 'hedge', 'refuse', 'error'))} FROM em GROUP BY expected")
def boundary_confusion(spark, sf):
    return boundary.confusion(_evaluated(spark, sf))


_CHK = """ck AS (SELECT * FROM (SELECT 'coverage' AS kind, unnest(['total_queries', 'refusal_required_total', 'ambiguous_total', 'boundary_safe_behavior_total', 'runtime_e2e_total', 'runtime_e2e_recency_sensitive_total']) AS metric, unnest([total_queries, refusal_required_total, ambiguous_total, boundary_safe_behavior_total, runtime_e2e_total, runtime_e2e_recency_sensitive_total])::DOUBLE AS observed, '>=' AS operator, unnest([25, 1, 1, 1, 12, 6])::DOUBLE AS threshold FROM bt)
UNION ALL SELECT 'metric', unnest(['acceptable_match_rate', 'refusal_required_false_accept_rate', 'ambiguous_clarify_rate', 'boundary_safe_behavior_rate', 'runtime_e2e_surface_contract_pass_rate', 'policy_terminal_surface_contract_pass_rate']), unnest([acceptable_match_rate, refusal_required_false_accept_rate, ambiguous_clarify_rate, boundary_safe_behavior_rate, runtime_e2e_surface_contract_pass_rate, policy_terminal_surface_contract_pass_rate]), unnest(['>=', '<=', '>=', '>=', '>=', '>=']), unnest([0.75, 0.1, 0.8, 0.8, 1.0, 1.0])::DOUBLE FROM bt
UNION ALL SELECT 'coverage', 'freshness_recency_sensitive_case_count', recency_sensitive::DOUBLE, '>=', 3.0::DOUBLE FROM fq WHERE promotion_status = 'insufficient_coverage' UNION ALL SELECT 'coverage', 'freshness_applicable_case_count', applicable_cases::DOUBLE, '>=', 3.0::DOUBLE FROM fq WHERE promotion_status = 'insufficient_coverage'
UNION ALL SELECT 'metric', 'freshness_violation_rate', coalesce(violation_rate, 0), '<=', 0.0::DOUBLE FROM fq WHERE promotion_status = 'blocked'), cv AS (SELECT *, CASE WHEN operator = '>=' THEN observed < threshold ELSE observed > threshold END AS violated FROM ck)"""
_FQ = "fs AS (SELECT count(*) FILTER (risk_level <> 'not_applicable') AS recency_sensitive, count(*) FILTER (applicable) AS applicable_cases, round(count(*) FILTER (violation)::DOUBLE / nullif(count(*) FILTER (applicable), 0), 4) AS violation_rate FROM fv), fq AS (SELECT *, CASE WHEN recency_sensitive < 3 OR applicable_cases < 3 THEN 'insufficient_coverage' WHEN violation_rate > 0 THEN 'blocked' ELSE 'pass' END AS promotion_status FROM fs)"
_GUARD = f"{_BSUM}, {R._FRESH}, {_FQ}, {_CHK}"


def _guard(spark, sf):
    return boundary.guardrail_checks(boundary.summary(_evaluated(spark, sf)), guardrails.freshness_summary(R._fresh(spark, sf)))


@register("boundary_guardrail_checks", f"WITH {_GUARD} SELECT * FROM cv")
def boundary_guardrail_checks(spark, sf):
    return _guard(spark, sf)


@register("boundary_guardrail_status", f"WITH {_GUARD}, s AS (SELECT count(*) FILTER (kind = 'coverage' AND violated) AS coverage_failures, count(*) FILTER (kind = 'metric' AND violated) AS metric_violations FROM cv) SELECT *, CASE WHEN coverage_failures > 0 THEN 'insufficient_coverage' WHEN metric_violations > 0 THEN 'fail' ELSE 'pass' END AS status FROM s")
def boundary_guardrail_status(spark, sf):
    return boundary.guardrail_status(_guard(spark, sf))


_MAN = f"""mq AS (SELECT i, text, CASE i % 6 WHEN 0 THEN 'out_of_scope_category' WHEN 1 THEN 'ambiguous_query' WHEN 2 THEN 'low_evidence_boundary' WHEN 3 THEN 'negative_problem_seeking' WHEN 4 THEN 'unsupported_attribute_claim' ELSE 'recency_sensitive_boundary' END AS boundary_type, CASE WHEN i % 3 = 0 THEN 'policy_terminal' ELSE 'runtime_e2e' END AS evaluation_surface,
'f' || (i % 9) AS challenge_family, 'fam' || (i % 21) AS family_id, CASE WHEN i % 4 <> 0 THEN 'recommendation' END AS intent, text AS query FROM {_ROWS}), mr AS (SELECT *, {_RECENT} AS recent FROM mq)"""


def _manual(spark, sf):
    i = F.col("i")
    names = ["out_of_scope_category", "ambiguous_query", "low_evidence_boundary", "negative_problem_seeking", "unsupported_attribute_claim", "recency_sensitive_boundary"]
    return _rows(spark, sf).select(
        F.concat(F.lit("bq_"), i.cast("string")).alias("manual_id"), "text", F.element_at(F.array(*[F.lit(n) for n in names]), (i % 6 + 1).cast("int")).alias("boundary_type"), F.lit("boundary").alias("answerability"), F.lit("hedge_or_refuse").alias("expected_behavior"),
        F.when(i % 3 == 0, "policy_terminal").otherwise("runtime_e2e").alias("evaluation_surface"), F.concat(F.lit("f"), (i % 9).cast("string")).alias("challenge_family"), F.array(F.lit("t"), F.concat(F.lit("t"), (i % 2).cast("string"))).alias("challenge_tags"),
        F.lit("someone").alias("author_id"), F.concat(F.lit("fam"), (i % 21).cast("string")).alias("family_id"), F.when(i % 4 != 0, "recommendation").alias("intent"),
    )


@register("manual_boundary_summary", f"""WITH {_MAN} SELECT 'boundary_type' AS counter, boundary_type AS value, count(*) AS n FROM mr GROUP BY 2 UNION ALL SELECT 'expected_behavior', 'hedge_or_refuse', count(*) FROM mr UNION ALL SELECT 'answerability', 'boundary', count(*) FROM mr UNION ALL SELECT 'evaluation_surface', evaluation_surface, count(*) FROM mr GROUP BY 2
UNION ALL SELECT 'challenge_family', challenge_family, count(*) FROM mr GROUP BY 2 UNION ALL SELECT 'intent', intent, count(*) FROM mr WHERE intent IS NOT NULL GROUP BY 2 UNION ALL SELECT 'author_id', 'someone', count(*) FROM mr UNION ALL SELECT 'challenge_tag', 't', count(*) FROM mr UNION ALL SELECT 'challenge_tag', 't' || (i % 2), count(*) FROM mr GROUP BY 2
UNION ALL SELECT 'total', 'queries', count(*) FROM mr UNION ALL SELECT 'total', 'runtime_e2e', count(*) FROM mr WHERE evaluation_surface = 'runtime_e2e' UNION ALL SELECT 'total', 'recency_sensitive', count(*) FROM mr WHERE recent UNION ALL SELECT 'total', 'runtime_e2e_recency_sensitive', count(*) FROM mr WHERE recent AND evaluation_surface = 'runtime_e2e' UNION ALL SELECT 'total', 'distinct_families', count(DISTINCT family_id) FROM mr""")
def manual_boundary_summary(spark, sf):
    return boundary.manual_summary(_manual(spark, sf))


@register("benchmark_composition", f"""WITH {_MAN}, c AS (SELECT 'total' AS rule, 'queries' AS value, count(*) AS observed, 56 AS least FROM mr UNION ALL SELECT 'total', 'recency_sensitive', count(*) FILTER (recent), 6 FROM mr UNION ALL SELECT 'total', 'runtime_e2e', count(*) FILTER (evaluation_surface = 'runtime_e2e'), 12 FROM mr
UNION ALL SELECT 'total', 'runtime_e2e_recency_sensitive', count(*) FILTER (evaluation_surface = 'runtime_e2e' AND recent), 6 FROM mr UNION ALL SELECT 'total', 'challenge_families', count(DISTINCT challenge_family), 8 FROM mr
UNION ALL SELECT 'boundary_type', t.b, (SELECT count(*) FROM mr WHERE boundary_type = t.b), t.n FROM (VALUES ('out_of_scope_category', 4), ('ambiguous_query', 6), ('low_evidence_boundary', 6), ('negative_problem_seeking', 6), ('unsupported_attribute_claim', 4), ('recency_sensitive_boundary', 8)) t(b, n)
UNION ALL SELECT 'runtime_boundary_type', t.b, (SELECT count(*) FROM mr WHERE boundary_type = t.b AND evaluation_surface = 'runtime_e2e'), t.n FROM (VALUES ('low_evidence_boundary', 2), ('negative_problem_seeking', 2), ('recency_sensitive_boundary', 6)) t(b, n))
SELECT rule, value, CAST(observed AS BIGINT) AS observed, CAST(least AS BIGINT) AS least, observed >= least AS ok FROM c""")
def benchmark_composition(spark, sf):
    return boundary.composition_checks(_manual(spark, sf))


@register("boundary_source_problems", "SELECT 'duplicate_text' AS problem, v.t AS value, count(*) AS n FROM (SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM conversations) v GROUP BY v.t HAVING count(*) > 1 UNION ALL SELECT 'duplicate_id', CAST(conv_id AS VARCHAR), count(*) FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def boundary_source_problems(spark, sf):
    """S13 over conversations, whose ids repeat with each turn."""
    return boundary.source_problems(table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("manual_id"), "text"))


# --- checks ----------------------------------------------------------------------------


_ART = "ar AS (SELECT event_type AS artifact, max(ts) AS modified, count(*) FILTER (value > 900) AS errors FROM events WHERE event_type <> 'click' GROUP BY event_type), st AS (SELECT min(modified) + INTERVAL 500 MILLISECOND AS t FROM ar), ex AS (SELECT DISTINCT event_type AS artifact FROM events UNION ALL SELECT 'never')"
_INVT = f"{_ART}, iv AS (SELECT ex.artifact, modified IS NOT NULL AS present, coalesce(modified >= (SELECT t FROM st) - INTERVAL 1 SECOND, false) AS fresh_for_run, modified IS NOT NULL AND coalesce(errors, 0) = 0 AS valid FROM ex LEFT JOIN ar ON ar.artifact = ex.artifact)"


def _inventory(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = e.where("event_type <> 'click'").groupBy(F.col("event_type").alias("artifact")).agg(F.max("ts").alias("modified"), F.count_if(F.col("value") > 900).alias("errors"))
    expected = e.select(F.col("event_type").alias("artifact")).distinct().unionByName(spark.createDataFrame([("never",)], "artifact string"))
    start = found.agg(F.min("modified")).first()[0]
    return checks.artifact_inventory(expected, found, F.lit(start) + F.expr("INTERVAL '0.5' SECOND"))


@register("artifact_inventory", f"WITH {_INVT} SELECT *, valid AND fresh_for_run AS ready FROM iv")
def artifact_inventory(spark, sf):
    return _inventory(spark, sf)


@register("promotion_gate", f"WITH {_INVT}, {R._RANKING}, {R._metrics('r')}, n AS (SELECT round(avg(ndcg), 6) AS ndcg FROM m), w AS (SELECT CASE WHEN (SELECT count(*) FROM iv WHERE valid AND fresh_for_run) = (SELECT count(*) FROM iv) THEN 'complete' ELSE 'incomplete' END AS e, concat_ws(',', CASE WHEN (SELECT count(*) FROM iv WHERE valid AND fresh_for_run) <> (SELECT count(*) FROM iv) THEN 'execution' END, 'safety', CASE WHEN ndcg < 0.1 THEN 'ndcg_low' END, 'faithfulness_low', 'sampled') AS reasons FROM n) SELECT e AS execution_status, e = 'complete' AS execution_complete, 'fail' AS safety_status, false AS safety_green, reasons, false AS reportable FROM w")
def promotion_gate(spark, sf):
    ndcg = R.retrieval_report(spark, sf).select("ndcg")
    results = ndcg.select(F.lit("fail").alias("boundary_status"), "ndcg", F.lit(0.8).alias("faithfulness"), F.lit(None).cast("double").alias("faithfulness_target"), F.lit(True).alias("sample_limited"), F.lit(False).alias("generation_limited"))
    return checks.promotion_gate(_inventory(spark, sf), results)


_PARTS = "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS id FROM lineitem"


@register("corpus_alignment", f"WITH {R.merkle_sql('m', _PARTS)}, {R.merkle_sql('r', 'SELECT CAST(p_partkey AS VARCHAR) AS id FROM part')} SELECT m0.d AS fingerprint, (SELECT count(*) FROM lineitem) AS chunk_count, (SELECT count(*) FROM lineitem) AS points_count, true AS remote_anchor_present, r0.d AS remote_fingerprint, 5::BIGINT AS stamped_at, CASE WHEN m0.d = r0.d THEN 'aligned' ELSE 'fingerprint_differs' END AS status FROM m0, r0")
def corpus_alignment(spark, sf):
    li = table(spark, sf, "lineitem")
    n = li.agg(F.count("*").alias("chunk_count"))
    local = querybank.corpus_anchor(li, "l_partkey").select("fingerprint").join(n)
    remote = querybank.corpus_anchor(table(spark, sf, "part"), "p_partkey").select("fingerprint", F.lit(5).cast("long").alias("stamped_at"))
    return checks.anchor_alignment(local, remote, li.agg(F.count("*").alias("points_count")))


_RESP = "rs AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'refuse' WHEN 1 THEN 'answer' END AS policy, event_id % 4 AS n, event_id % 3 <> 0 AS cited, event_id % 5 <> 0 AS grounded, CASE WHEN event_id % 7 = 0 THEN 'I cannot recommend it' WHEN event_id % 11 = 0 THEN ' ' ELSE 'fine \"a\"' END AS said FROM events)"


@register("response_quality", f"WITH {_RESP}, z AS (SELECT *, coalesce(policy IN ('refuse', 'clarify', 'hedge'), false) AS p, trim(said) <> '' AND cited AND grounded AS g, trim(said) <> '' AND ((cited AND grounded) OR event_id % 7 = 0) AS v FROM rs) SELECT event_id, NOT p AND n > 0 AND g AS grounded_success, p OR (n > 0 AND v) AS refusal_aware_success FROM z")
def response_quality(spark, sf):
    i = F.col("event_id")
    said = F.when(i % 7 == 0, "I cannot recommend it").when(i % 11 == 0, " ").otherwise('fine "a"')
    rec = F.struct(said.alias("explanation"), (i % 3 != 0).alias("citations_verified"), (i % 5 != 0).alias("is_grounded"))
    rows = table(spark, sf, "events").select("event_id", F.when(i % 9 == 0, "refuse").when(i % 9 == 1, "answer").alias("policy_behavior"), F.array_repeat(rec, (i % 4).cast("int")).alias("recommendations"))
    return checks.response_quality(rows).select("event_id", "grounded_success", "refusal_aware_success")


# --- recommendations -------------------------------------------------------------------

_HIST = "hi AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 100 + doc_id // 30 ELSE doc_id % 60 END AS user_id, doc_id % 50 AS product_id, doc_id AS place, CAST(doc_id % 6 AS DOUBLE) AS rating, text FROM documents), us AS (SELECT unnest(range(0, 80)) AS user_id UNION SELECT user_id FROM hi)"
_LEV = f"{_HIST}, ul AS (SELECT us.user_id, count(hi.user_id) AS n, CASE WHEN us.user_id % 2 = 0 THEN 'q' || us.user_id END AS query FROM us LEFT JOIN hi ON hi.user_id = us.user_id GROUP BY us.user_id), lv AS (SELECT *, CASE WHEN n = 0 THEN 'cold' WHEN n < 5 THEN 'warming' ELSE 'warm' END AS level FROM ul)"


def _history(spark, sf):
    """Documents as what users read: most of sixty users, every tenth of users with three each."""
    i = F.col("doc_id")
    user = F.when(i % 10 == 0, 100 + F.floor(i / 30)).otherwise(i % 60)
    return table(spark, sf, "documents").select(user.alias("user_id"), (i % 50).alias("product_id"), i.alias("place_id"), (i % 6).cast("double").alias("rating"), "text")


def _levels(spark, sf):
    ids = spark.range(80).select(F.col("id").alias("user_id")).unionByName(_history(spark, sf).select("user_id")).distinct()
    users = ids.select("user_id", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("q"), F.col("user_id").cast("string"))).alias("query"))
    return recommend.history_queries(users, _history(spark, sf), ["place_id"])


@register("history_queries", f"""WITH {_LEV}, pk AS (SELECT *, max((rating >= 4)::INT) OVER (PARTITION BY user_id) AS any4 FROM hi), pl AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS i FROM pk WHERE rating >= 4 OR any4 = 0), tx AS (SELECT user_id, string_agg(substr(text, 1, 300), ' ' ORDER BY i) AS liked FROM pl WHERE i <= 5 GROUP BY user_id)
SELECT lv.user_id, level, CASE level WHEN 'cold' THEN coalesce(query, 'highly rated quality products') WHEN 'warming' THEN concat_ws(' ', query, liked) ELSE liked END AS query_text FROM lv LEFT JOIN tx ON tx.user_id = lv.user_id""")
def history_queries(spark, sf):
    return _levels(spark, sf)


_HYB = f"""{R._ALL}, {_LEV}, uc AS (SELECT u.user_id AS query_id, c.chunk_id, c.score, c.product_id, c.rating, u.level FROM lv u JOIN c ON c.query_id = (u.user_id % 10) * 50 WHERE c.rating >= CASE WHEN u.level = 'warm' THEN 3 ELSE 4 END),
hp AS (SELECT query_id, product_id, round(CASE WHEN any_value(level) = 'warm' THEN CASE WHEN sum(rating) > 0 THEN sum(score * rating) / sum(rating) ELSE avg(score) END ELSE max(score) END, 6) AS score, avg(rating) AS avg_rating FROM uc GROUP BY query_id, product_id),
hb AS ({R._blend(0.8, 0.2, 'hp')}), hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM hb QUALIFY rank <= 10)"""


def _user_chunks(spark, sf):
    """Each user asks what one of ten search results answers."""
    asked = _levels(spark, sf).select("user_id", (F.col("user_id") % 10 * 50).alias("query_id"))
    return X.chunks(spark, sf).join(asked, "query_id").select(F.col("user_id").alias("query_id"), "chunk_id", "product_id", "score", "rating")


@register("hybrid_recommendations", f"WITH {_HYB} SELECT hr.query_id AS user_id, product_id, score, CAST(rank AS INT) AS rank FROM hr ANTI JOIN hi ON hi.user_id = hr.query_id AND hi.product_id = hr.product_id")
def hybrid_recommendations(spark, sf):
    return recommend.hybrid_recommend(_levels(spark, sf), _user_chunks(spark, sf), _history(spark, sf))


@register("best_evidence", f"WITH {R._ALL} SELECT query_id, product_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, product_id ORDER BY score DESC, chunk_id) AS i FROM c) WHERE i = 1")
def best_evidence(spark, sf):
    return recommend.best_evidence(X.chunks(spark, sf))


def _explainable(spark, sf):
    """The first products of each query with documents as evidence, a draft, and a retry for some."""
    top = retrieval.recommend(X.chunks(spark, sf), 3)
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select(i.alias("chunk_id"), F.concat(F.lit("review_"), i.cast("string")).alias("review_id"), "text", F.when(i % 3 != 0, F.lit(X.REFERENCE_MS) - (i % 1500) * F.lit(86400000)).alias("timestamp_ms"), (i % 2 == 0).alias("verified_purchase"))
    rows = recommend.product_rows(top, X.chunks(spark, sf), d)
    q, n = F.col("query_id"), F.col("product_id")
    texts = {
        "query": F.when(q % 100 == 0, "latest webcam").otherwise("a good lamp"),
        "draft": F.when(n % 3 == 0, "Highly recommended lamp").otherwise(F.concat(F.lit('Buyers say "bright" ['), F.coalesce(F.get("evidence", 0)["review_id"], F.lit("none")), F.lit("]"))),
        "retry": F.when(n % 2 == 0, "A plain lamp."),
    }
    return rows.withColumns(texts)


@register("explanation_sources", f"""WITH {R._ALL}, a AS ({R._products('max')}), b AS ({R._blend(0.8, 0.2, 'a')}), rt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM b QUALIFY rank <= 3),
pc AS (SELECT c.query_id, c.product_id, c.chunk_id, c.score, d.text AS text, CASE WHEN d.doc_id % 3 <> 0 THEN {X.REFERENCE_MS} - (d.doc_id % 1500) * 86400000 END AS ms, row_number() OVER (PARTITION BY c.query_id, c.product_id ORDER BY c.score DESC, c.chunk_id) AS i FROM c JOIN rt ON rt.query_id = c.query_id AND rt.product_id = c.product_id LEFT JOIN documents d ON d.doc_id = c.chunk_id),
pg AS (SELECT query_id, product_id, count(*) AS chunk_count, coalesce(sum(length(text)), 0) // 4 AS tokens, max(score) AS top, count(ms) FILTER (i <= 5) AS ta, count(*) FILTER (i <= 5 AND ({X.REFERENCE_MS} - ms) / 86400000.0 > 1095) AS vo, count(*) FILTER (i <= 5 AND ({X.REFERENCE_MS} - ms) / 86400000.0 > 365) AS ol FROM pc GROUP BY query_id, product_id)
SELECT query_id, product_id, CASE WHEN chunk_count < 2 OR tokens < 500 OR top < 0.2 THEN 'quality_gate_refusal' WHEN query_id % 100 = 0 AND (ta = 0 OR vo = ta OR ol = ta) THEN 'freshness_hedge' WHEN product_id % 3 = 0 AND product_id % 2 = 0 THEN 'retry' ELSE 'draft' END AS source,
CASE WHEN chunk_count < 2 THEN 'insufficient_chunks' WHEN tokens < 500 THEN 'insufficient_tokens' WHEN top < 0.2 THEN 'low_relevance' END AS refusal_type FROM pg""")
def explanation_sources(spark, sf):
    """P20: what each product's explanation comes from."""
    return recommend.explain(_explainable(spark, sf), X.REFERENCE_MS, 2, 500, 0.2).select("query_id", "product_id", "source", "refusal_type")


_REQS = f"""rq AS (SELECT CAST(i AS BIGINT) AS request_id, text AS query, {_CLEAN_Q} AS sq FROM en), ke AS (SELECT *, trim(regexp_replace(lower(sq), '\\s+', ' ', 'g')) || ':3:' || CASE WHEN request_id % 2 = 0 THEN 'true' ELSE 'false' END || ':4.0' AS cache_key FROM rq)"""


@register("request_paths", f"""WITH en AS {_ROWS}, {_REQS}, {_policy_of('sq', 'rq')}, pu AS (SELECT DISTINCT text, d FROM pd),
z AS (SELECT ke.*, d[1] AS action, request_id % 2 = 0 AS explain, request_id % 2 = 0 AND request_id % 4 = 0 AS hit, request_id % 5 AS n FROM ke JOIN pu ON pu.text = ke.sq), p AS (SELECT *, CASE WHEN action <> 'allow' THEN 'policy' WHEN explain AND cache_key IN (SELECT cache_key FROM z WHERE request_id % 4 = 0) THEN 'cache' WHEN n = 0 THEN 'empty' WHEN explain THEN 'explained' ELSE 'listed' END AS path FROM z)
SELECT request_id, sq AS sanitized, cache_key, path, CASE WHEN path = 'policy' THEN action ELSE 'allow' END AS behavior, CAST(CASE WHEN path IN ('explained', 'listed') THEN least(n, 3) ELSE 0 END AS BIGINT) AS returned, path = 'explained' AS put FROM p""")
def request_paths(spark, sf):
    """Requests, every fourth of which is in the cache, with none to four products."""
    rows = _rows(spark, sf).select(F.col("i").alias("request_id"), F.col("text").alias("query"))
    i = F.col("request_id")
    key = T.cache_key(T.sanitize_query(F.col("query")), F.lit(3), i % 2 == 0, F.lit(4.0))
    cached = rows.where(i % 4 == 0).select(key.alias("cache_key"))
    products = rows.where(i % 5 > 0).select("request_id", F.explode(F.sequence(F.lit(1), (i % 5).cast("int"))).alias("product_id"))
    return recommend.handle_requests(rows, cached, products, F.lit(3), i % 2 == 0, F.lit(4.0))


# --- banks and leakage -----------------------------------------------------------------


@register("candidate_rows_filtered", "SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#12' AND p_size % 3 <> 0")
def candidate_rows_filtered(spark, sf):
    flag = F.when(F.col("p_size") % 3 == 0, "No").when(F.col("p_size") % 3 == 1, " yes ").otherwise("1.0")
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("locale"), flag.alias("large_version"))
    return querybank.candidate_rows(rows, "BRAND#12", need_large=True).select("p_partkey")


_BUCK = """jr AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_orderkey % 3 = 0 THEN 'test' ELSE 'train' END AS split, l_orderkey % 400 AS sq, 'find part number ' || (l_orderkey % 400) || ' of ' || (l_orderkey % 7) AS query, l_partkey + l_linenumber % 2 * 1000000 AS product_id, CASE l_returnflag WHEN 'A' THEN 'E' WHEN 'N' THEN 'S' ELSE 'C' END AS label FROM lineitem),
js AS (SELECT split, sq, min(row_id) AS first_row, arg_min(query, row_id) AS text FROM jr GROUP BY ALL), jg AS (SELECT split, sq, product_id, max(CASE label WHEN 'E' THEN 3.0 ELSE 2.0 END) AS grade FROM jr WHERE label IN ('E', 'S') AND product_id IN (SELECT p_partkey FROM part) GROUP BY ALL), jk AS (SELECT split, sq, count(*) AS n_relevant, sum(grade)::DOUBLE AS mass FROM jg GROUP BY ALL HAVING count(*) >= 3),
jb AS (SELECT jk.*, first_row, text FROM jk JOIN js USING (split, sq) ORDER BY first_row LIMIT 120), jn AS (SELECT *, printf('qb_%05d', row_number() OVER (ORDER BY first_row, split || ':' || sq)) AS query_id FROM jb)"""


def _bank_judgments(spark, sf):
    li = table(spark, sf, "lineitem")
    o = F.col("l_orderkey")
    label = F.when(F.col("l_returnflag") == "A", "E").when(F.col("l_returnflag") == "N", "S").otherwise("C")
    return li.select((o * 10 + F.col("l_linenumber")).alias("row_id"), F.when(o % 3 == 0, "test").otherwise("train").alias("split"), (o % 400).alias("source_query_id"), F.concat(F.lit("find part number "), (o % 400).cast("string"), F.lit(" of "), (o % 7).cast("string")).alias("query"), (F.col("l_partkey") + F.col("l_linenumber") % 2 * 1000000).alias("product_id"), label.alias("label"))


def _bank(spark, sf):
    corpus = table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"))
    return querybank.overlap_bank(_bank_judgments(spark, sf), corpus, 3, 120)


_BANK = f"""{_BUCK}, {R._pairs_sql("SELECT 'test:' || sq AS id, text FROM jn WHERE split = 'test'", "SELECT 'test:' || sq AS id, text FROM jn WHERE split = 'test'", 'a.id < b.id')}, {R._STRONG},
kl AS (SELECT component, sha256(string_agg(a.norm || chr(9) || a.id, chr(10) ORDER BY a.norm || chr(9) || a.id)) AS akey FROM k JOIN a USING (id) GROUP BY component), kf AS (SELECT k.id, ('0x' || akey2[1:16])::UBIGINT::DOUBLE / 18446744073709551615.0::DOUBLE AS f FROM k JOIN (SELECT component, sha256(akey) AS akey2 FROM kl) USING (component))"""


_SUBSET = "CASE WHEN split = 'train' THEN 'gate_calibration' WHEN f < 0.8 THEN CASE WHEN f / 0.8::DOUBLE < 0.75 THEN 'retrieval_dev_holdout' ELSE 'retrieval_final_report' END ELSE CASE WHEN (f - 0.8::DOUBLE) / (1 - 0.8::DOUBLE) < 1.0::DOUBLE / 3 THEN 'faithfulness_dev_seed' ELSE 'faithfulness_final_seed' END END"


@register("overlap_bank", f"""WITH RECURSIVE {_BANK} SELECT jn.query_id, jn.text, {_SUBSET} AS subset_tags,
n_relevant, mass, 'judgments:split=' || split || ':query_id=' || sq AS source_ref FROM jn LEFT JOIN kf ON kf.id = split || ':' || sq""")
def overlap_bank(spark, sf):
    """The first 120 queries with three products or more (K9)."""
    mass = F.aggregate(F.map_values("relevant_items"), F.lit(0.0), lambda a, x: a + x)
    return _bank(spark, sf).select("query_id", "text", F.array_join("subset_tags", ",").alias("subset_tags"), F.size(F.map_keys("relevant_items")).cast("long").alias("n_relevant"), mass.alias("mass"), "source_ref")


@register("overlap_bank_summary", f"WITH RECURSIVE {_BANK}, tg AS (SELECT {_SUBSET} AS tag FROM jn LEFT JOIN kf ON kf.id = split || ':' || sq) SELECT 'source_split' AS kind, split AS value, count(*) AS queries FROM jn GROUP BY split UNION ALL SELECT 'source_type', 'judged_overlap', count(*) FROM jn UNION ALL SELECT 'answerability', 'answerable', count(*) FROM jn UNION ALL SELECT 'has_provenance', 'true', count(*) FROM jn UNION ALL SELECT 'schema_version', '1', count(*) FROM jn UNION ALL SELECT 'origin_family', 'judged_queries', count(*) FROM jn UNION ALL SELECT 'curation_mode', 'automatic', count(*) FROM jn UNION ALL SELECT 'selection_policy', 'corpus_overlap', count(*) FROM jn UNION ALL SELECT 'subset_assignment_policy', 'component_hash', count(*) FROM jn UNION ALL SELECT 'tag', tag, count(*) FROM tg GROUP BY tag")
def overlap_bank_summary(spark, sf):
    """A34, N3."""
    return querybank.bank_summary(_bank(spark, sf))


@register("bank_relevance", f"WITH {_BUCK} SELECT count(*) AS total_queries, count(*) AS with_relevant_items, min(n_relevant) AS min_items, quantile_cont(n_relevant, 0.5) AS median_items, max(n_relevant) AS max_items FROM jn")
def bank_relevance(spark, sf):
    return querybank.relevance_summary(_bank(spark, sf))


@register("bank_eval_cases", f"WITH {_BUCK} SELECT query_id, text AS query, 'judgments' AS source_dataset, 'train' AS source_split, 'corpus_overlap' AS selection_policy, n_relevant FROM jn WHERE split = 'train'")
def bank_eval_cases(spark, sf):
    """S11, N3."""
    found = querybank.eval_cases(_bank(spark, sf), "gate_calibration")
    return found.select("query_id", "query", "source_dataset", "source_split", "selection_policy", F.size(F.map_keys("relevant_items")).cast("long").alias("n_relevant"))


@register("corpus_differences", "WITH a AS (SELECT DISTINCT CAST(CASE WHEN event_id % 9 = 0 THEN -user_id ELSE user_id END AS VARCHAR) AS id FROM events), b AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer) SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'local_only' ELSE 'remote_only' END AS side FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL")
def corpus_differences(spark, sf):
    """Which ids keep the users of the events, some of them under other ids, and the customers from being the same."""
    users = table(spark, sf, "events").select(F.when(F.col("event_id") % 9 == 0, -F.col("user_id")).otherwise(F.col("user_id")).alias("id"))
    return fingerprints.differing_ids(users, table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id")


@register("bank_manifest", f"WITH {_BUCK}, {R.merkle_sql('m', _PARTS)} SELECT (SELECT count(*) FROM jn) AS canonical_row_count, m0.n AS corpus_product_count, m0.d AS corpus_fingerprint, 'ready' AS status, 'query_bank' AS dataset_name, (SELECT min(n_relevant) FROM jn) AS min_relevant_items, (SELECT quantile_cont(n_relevant, 0.5) FROM jn) AS median_relevant_items, (SELECT max(n_relevant) FROM jn) AS max_relevant_items, true AS digest_present FROM m0")
def bank_manifest(spark, sf):
    """The manifest's fields; of the digest, which is of this engine's own form, whether it is there."""
    m = querybank.manifest(_bank(spark, sf), querybank.corpus_anchor(table(spark, sf, "lineitem"), "l_partkey"))
    j = lambda p, t="string": F.get_json_object("manifest", f"$.{p}").cast(t).alias(p)
    counts = [j(p, "long") for p in ("canonical_row_count", "corpus_product_count", "min_relevant_items", "max_relevant_items")]
    return m.select(*counts, j("corpus_fingerprint"), j("status"), j("dataset_name"), j("median_relevant_items", "double"), F.get_json_object("manifest", "$.query_bank_sha256").rlike("^[0-9a-f]{64}$").alias("digest_present"))


@register("bootstrap_bank", """WITH c AS (SELECT p_name AS text, count(*) AS record_count, list_sort(list(CAST(p_partkey AS VARCHAR))) AS ids, min(p_partkey) AS first_row FROM part GROUP BY p_name) SELECT printf('qc_%04d', row_number() OVER (ORDER BY record_count DESC, lower(text), text)) AS query_id, text, 'part.parquet:query_id=' || ids[1] || CASE WHEN len(ids) > 1 THEN '(+' || (len(ids) - 1) || ' more)' ELSE '' END AS source_ref FROM c""")
def bootstrap_bank(spark, sf):
    """P8, T24, K8."""
    rows = table(spark, sf, "part").groupBy(F.col("p_name").alias("text")).agg(F.count("*").alias("record_count"), F.array_sort(F.collect_list(F.col("p_partkey").cast("string"))).alias("query_ids"), F.min("p_partkey").alias("first_row"))
    return querybank.bootstrap_rows(rows, "part.parquet").select("query_id", "text", "source_ref")


_SURF = "sf AS (SELECT item_id AS query_id, text, 's' || (item_id % 3) AS surface FROM benchmark UNION ALL SELECT item_id, text, 's0' FROM benchmark WHERE item_id % 3 = 1 AND item_id % 2 = 0 UNION ALL SELECT 10000000 + item_id, text || ' please', 's2' FROM benchmark UNION ALL SELECT p_partkey + 20000000, p_name, 's3' FROM part)"
_SUP = R._pairs_sql("SELECT DISTINCT query_id AS id, text FROM sf", "SELECT DISTINCT query_id AS id, text FROM sf", "TRUE")
_MATRIX = f"""{_SURF}, {_SUP}, nm AS (SELECT DISTINCT surface FROM sf), sp AS (SELECT x.surface AS left_surface, y.surface AS right_surface FROM nm x JOIN nm y ON x.surface < y.surface),
sc AS (SELECT l.surface AS left_surface, r.surface AS right_surface, severity, right_id FROM v JOIN sf l ON l.query_id = left_id JOIN sf r ON r.query_id = right_id WHERE l.surface < r.surface),
sx AS (SELECT sp.left_surface, sp.right_surface, count(*) FILTER (severity = 'exact_duplicate') AS exact, count(*) FILTER (severity = 'high_confidence_near_duplicate') AS near, count(*) FILTER (severity = 'semantic_watchlist') AS watch, count(DISTINCT right_id) FILTER (severity = 'semantic_watchlist') AS watch_right FROM sp LEFT JOIN sc ON sc.left_surface = sp.left_surface AND sc.right_surface = sp.right_surface GROUP BY ALL),
sm AS (SELECT *, CASE WHEN exact > 0 OR near >= 10 THEN 'high' WHEN near > 0 OR watch_right >= 20 THEN 'moderate' ELSE 'low' END AS risk_level FROM sx)"""


def _matrix(spark, sf):
    b = table(spark, sf, "benchmark")
    i = F.col("item_id")
    tagged = b.select(i.alias("query_id"), "text", F.array_compact(F.array(F.concat(F.lit("t"), (i % 3).cast("string")), F.when((i % 3 == 1) & (i % 2 == 0), "t0"))).alias("subset_tags"))
    near = b.select((i + 10000000).alias("query_id"), F.concat("text", F.lit(" please")).alias("text"), F.array(F.lit("t2")).alias("subset_tags"))
    parts = table(spark, sf, "part").select((F.col("p_partkey") + 20000000).alias("query_id"), F.col("p_name").alias("text"), F.array(F.lit("t3"), F.lit("older")).alias("subset_tags"))
    specs = {"s0": ("t0",), "s1": ("t1",), "s2": ("t2", "t9"), "s3": ("older", "t3")}
    return leakage.surface_matrix(querybank.surfaces(tagged.unionByName(near).unionByName(parts), specs))


@register("surface_matrix", f"WITH {_MATRIX} SELECT * FROM sm")
def surface_matrix(spark, sf):
    """J9, U7, A30."""
    return _matrix(spark, sf)


@register("matrix_risk", f"""WITH {_MATRIX}, o AS (SELECT *, left_surface || '__' || right_surface AS pair, row_number() OVER (ORDER BY CASE risk_level WHEN 'high' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END DESC, exact DESC, near DESC, watch DESC, exact + near + watch DESC, left_surface || '__' || right_surface) AS i FROM sm)
SELECT count(*) AS pairs, CASE WHEN count(*) FILTER (risk_level = 'high') > 0 THEN 'high' WHEN count(*) FILTER (risk_level = 'moderate') > 0 THEN 'moderate' ELSE 'low' END AS overall_risk_level, count(*) FILTER (risk_level = 'high') AS high, count(*) FILTER (risk_level = 'moderate') AS moderate, count(*) FILTER (risk_level = 'low') AS low, CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(near) AS BIGINT) AS near, CAST(sum(watch) AS BIGINT) AS watch, string_agg(pair, ',' ORDER BY i) FILTER (i <= 5) AS worst_pairs FROM o""")
def matrix_risk(spark, sf):
    return leakage.matrix_risk(_matrix(spark, sf))


@register("review_report", "SELECT count(*) AS n, count(DISTINCT source) AS users, count(DISTINCT 'p' || (doc_id % 50)) AS items, round(avg(CAST(doc_id % 7 AS DOUBLE)), 6) AS avg_rating, round(avg(length(text)), 6) AS avg_text_length, round(avg(CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 2 = 0)::INT::DOUBLE END) * 100, 6) AS verified_percent FROM documents")
def review_report(spark, sf):
    from tidemark.operators import interactions

    flag = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 2 == 0)
    return interactions.review_report(X.reviews(spark, sf).withColumn("verified_purchase", flag), item="parent_asin")


def _index(spark, sf):
    from tidemark.operators import approximate
    from tidemark.sources.paths import new_path

    path, points = new_path(spark, "vector-index"), X.points(spark, sf).select("point_id", "vector")
    approximate.write_index(points, path, approximate.fit_model(points))
    return path


#: Of the square root of the number of vectors: these hardly cluster.
_PROBES = 16


@register("approximate_topk")
def approximate_topk(spark, sf):
    """K1: the ten best points of each query by the stored index; tests hold its recall against the exact search."""
    from tidemark.operators import approximate

    return approximate.search_index(X.queries(spark, sf), _index(spark, sf), limit=10, probes=_PROBES)


@register("approximate_recall")
def approximate_recall(spark, sf):
    """K1: how much of the exact search's result the index finds, and the share of all points that a query reads."""
    from tidemark.operators import approximate, retrieval

    path, queries = _index(spark, sf), X.queries(spark, sf)
    exact = retrieval.vector_search(queries, X.points(spark, sf).select("point_id", "vector"), 10)
    reads = approximate.files_read(queries, path, _PROBES).agg(F.round(F.avg(F.col("rows_read") / F.col("rows_total")), 6).alias("share_read"), F.max("lists_read").alias("lists_read"), F.max("lists_total").alias("lists_total"))
    return approximate.recall(approximate.search_index(queries, path, limit=10, probes=_PROBES), exact).join(reads)


@register("judged_scores", f"WITH {R._SCORED} SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 0.0::DOUBLE ELSE score END AS score, CASE WHEN doc_id % 8 = 0 THEN true ELSE score < 0.5 END AS is_hallucinated FROM sc")
def judged_scores(spark, sf):
    """E2, with a scorer that was degraded for every eighth document."""
    rows = X.scored(spark, sf).select("doc_id", "score", F.when(F.col("doc_id") % 8 == 0, True).alias("degraded"))
    return faithfulness.judged_scores(rows).select("doc_id", "score", "is_hallucinated")


@register("positive_items", "SELECT l_partkey AS product_id, count(*) AS n FROM (SELECT l_orderkey, l_partkey, max(CAST(l_quantity AS INT) % 3 - 1) AS grade FROM lineitem GROUP BY ALL) WHERE grade > 0 GROUP BY l_partkey")
def positive_items(spark, sf):
    """R2: orders as maps from part to grade, the parts that any order grades over 0."""
    graded = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max(F.col("l_quantity").cast("int") % 3 - 1).alias("grade"))
    maps = graded.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_partkey", "grade"))).alias("items"))
    return maps.select(F.explode(F.map_keys(T.positive_items(F.col("items")))).alias("product_id")).groupBy("product_id").agg(F.count("*").alias("n"))


def _side_sql(name: str) -> str:
    grams = R._GRAM.format("text")
    return f"{name}p AS (SELECT id, v, items, {R._N} AS norm, {R._TOK.format('text')} AS tokens, {grams} AS grams FROM {name})"


def _over(a: str, b: str, whole: str) -> str:
    return f"round(coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif({whole}, 0), 0), 6)"


@register("leakage_signals", f"""WITH l AS (SELECT vec_id AS id, 'point ' || vec_id || ' label ' || label AS text, CAST(embedding AS DOUBLE[]) AS v, ['a' || (vec_id // 4), 'b' || (vec_id // 8)] AS items FROM embeddings),
r AS (SELECT 10000000 + e.vec_id AS id, CASE WHEN e.vec_id % 5 = 0 THEN 'point ' ELSE 'vector ' END || e.vec_id || ' label ' || e.label AS text, CAST(CASE WHEN e.vec_id % 3 = 0 THEN e.embedding ELSE f.embedding END AS DOUBLE[]) AS v, CASE WHEN e.vec_id % 2 = 0 THEN ['a' || (e.vec_id // 4), 'c'] ELSE ['d'] END AS items
      FROM embeddings e JOIN embeddings f ON f.vec_id = (e.vec_id + 1) % (SELECT count(*) FROM embeddings)), {_side_sql('l')}, {_side_sql('r')},
x AS (SELECT lp.id AS left_id, rp.id AS right_id, CASE WHEN round(list_dot_product(lp.v, rp.v), 6) >= 0.93 THEN round(list_dot_product(lp.v, rp.v), 6) ELSE 0.0::DOUBLE END AS cosine, {_over('lp.tokens', 'rp.tokens', 'len(list_distinct(list_concat(lp.tokens, rp.tokens)))')} AS token_jaccard,
{_over('lp.grams', 'rp.grams', 'len(list_distinct(list_concat(lp.grams, rp.grams)))')} AS trigram_jaccard, {_over('lp.items', 'rp.items', 'least(len(lp.items), len(rp.items))')} AS item_coverage, lp.norm = rp.norm AS exact FROM lp, rp)
SELECT left_id, right_id, cosine, token_jaccard, trigram_jaccard, item_coverage, CASE WHEN exact THEN 'exact_duplicate' WHEN (cosine >= 0.96 AND (token_jaccard >= 0.75 OR trigram_jaccard >= 0.72 OR item_coverage >= 0.5)) OR (token_jaccard >= 0.75 AND trigram_jaccard >= 0.72) THEN 'high_confidence_near_duplicate'
WHEN cosine >= 0.93 OR token_jaccard >= 0.6 OR trigram_jaccard >= 0.68 OR item_coverage >= 0.34 THEN 'semantic_watchlist' END AS severity FROM x WHERE severity IS NOT NULL""")
def leakage_signals(spark, sf):
    """J7, M9, M10 with all four signals: texts, vectors, of which every pair counts, and shared items."""
    e = table(spark, sf, "embeddings")
    i = F.col("vec_id")
    n = e.agg(F.count("*").alias("n"))
    nxt = e.select((F.col("vec_id")).alias("nxt"), F.col("embedding").alias("other"))
    label = F.concat(F.lit(" label "), F.col("label").cast("string"))
    left = e.select(i.alias("id"), F.concat(F.lit("point "), i.cast("string"), label).alias("text"), F.col("embedding").alias("vector"), F.array(F.concat(F.lit("a"), F.floor(i / 4).cast("string")), F.concat(F.lit("b"), F.floor(i / 8).cast("string"))).alias("items"))
    both = e.join(F.broadcast(n)).withColumn("nxt", (i + 1) % F.col("n")).join(nxt, "nxt")
    right = both.select(
        (i + 10000000).alias("id"), F.concat(F.when(i % 5 == 0, "point ").otherwise("vector "), i.cast("string"), label).alias("text"), F.when(i % 3 == 0, F.col("embedding")).otherwise(F.col("other")).alias("vector"),
        F.when(i % 2 == 0, F.array(F.concat(F.lit("a"), F.floor(i / 4).cast("string")), F.lit("c"))).otherwise(F.array(F.lit("d"))).alias("items"),
    )
    return leakage.flagged_pairs(left, right, "id", "id", items="items", vector="vector", sketches=True)


@register("worst_leaks", "WITH v AS (SELECT * FROM ({pairs})) SELECT left_id, right_id, severity FROM v ORDER BY CASE severity WHEN 'exact_duplicate' THEN 0 WHEN 'high_confidence_near_duplicate' THEN 1 ELSE 2 END, cosine DESC, token_jaccard DESC, trigram_jaccard DESC, item_coverage DESC, left_id, right_id LIMIT 100".replace("{pairs}", R._SQL["leakage_signals"]))
def worst_leaks(spark, sf):
    """K7."""
    return leakage.worst_pairs(leakage_signals(spark, sf)).select("left_id", "right_id", "severity")


@register("bank_union", f"""WITH {_MAN}, u AS (SELECT 'bq_' || (item_id % 70) AS query_id, text, 'bench' AS source_type, 0 AS o FROM benchmark UNION ALL SELECT 'bq_' || i, text, 'manual_boundary', 1 FROM mq), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, text) AS k FROM u) SELECT query_id, text, source_type FROM w WHERE k = 1""")
def bank_union(spark, sf):
    """Judged rows and manual boundary rows, of which some have the id of a judged one."""
    judged = table(spark, sf, "benchmark").select(F.concat(F.lit("bq_"), (F.col("item_id") % 70).cast("string")).alias("query_id"), "text", F.lit("bench").alias("source_type"), F.array(F.lit("t")).alias("subset_tags"))
    return querybank.union_banks(judged, querybank.boundary_bank(_manual(spark, sf))).select("query_id", "text", "source_type")


@register("weighted_metric", f"WITH {R._RANKING}, {R._metrics('r')}, g AS (SELECT q.label, count(*) AS n, avg(ndcg) AS ndcg FROM m JOIN q USING (query_id) GROUP BY q.label) SELECT round(sum(ndcg * n) / sum(n), 6) AS ndcg FROM g")
def weighted_metric(spark, sf):
    """The mean over labels, weighted by their queries."""
    from tidemark.operators import evaluation

    rows = evaluation.ranking_metrics(R._ranking(spark, sf), X.shared_grades(spark, sf)).join(X.queries(spark, sf).select("query_id", "label"), "query_id")
    return evaluation.weighted_mean(rows.groupBy("label").agg(F.count("*").alias("n"), F.avg("ndcg").alias("ndcg")), "ndcg", "n")


@register("product_evidence", f"WITH {R._ALL}, e AS (SELECT *, row_number() OVER (PARTITION BY query_id, product_id ORDER BY score DESC, chunk_id) AS i FROM c) SELECT query_id, product_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY i) FILTER (i <= 5) AS chunks FROM e GROUP BY query_id, product_id")
def product_evidence(spark, sf):
    """The best chunks of each product."""
    found = X.chunks(spark, sf, limit=retrieval.candidate_limit(10))
    rows = retrieval.with_evidence(found, retrieval.product_scores(found))
    return rows.select("query_id", "product_id", F.array_join(F.transform("evidence", lambda e: e["chunk_id"].cast("string")), ",").alias("chunks"))


@register("relevance_grades", "WITH r AS (SELECT l_quantity / 10 AS rating FROM lineitem) SELECT CASE WHEN rating < 3 THEN 0.0::DOUBLE WHEN rating < 4 THEN 1.0::DOUBLE WHEN rating < 5 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS grade, count(*) AS n FROM r GROUP BY 1")
def relevance_grades(spark, sf):
    """M3."""
    from tidemark.functions.vectors import relevance_grade

    return table(spark, sf, "lineitem").groupBy(relevance_grade(F.col("l_quantity") / 10).alias("grade")).agg(F.count("*").alias("n"))


@register("text_helpers", r"""WITH z AS (SELECT p_partkey, p_name, p_type, list_filter(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), lambda t: length(t) >= 4) AS a, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS b FROM part)
SELECT p_partkey, round(coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(a), 0), 0), 6) AS overlap, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS label, p_brand_id AS brand_id, 'a|b' AS parts FROM z JOIN (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS p_brand_id FROM part) USING (p_partkey)""")
def text_helpers(spark, sf):
    """Overlap of terms, labels, lists between commas and tags by prefix."""
    tag = F.array(F.lit("x"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("size:"), F.col("p_size").cast("string"))).otherwise("y"))
    return table(spark, sf, "part").select(
        "p_partkey", F.round(T.term_overlap(F.col("p_name"), F.col("p_type")), 6).alias("overlap"), T.profile_label(F.col("p_type")).alias("label"),
        F.array_join(T.tags_with(tag, "size:"), ",").alias("brand_id"), F.array_join(T.csv_list(F.lit("a, b,, a ,")), "|").alias("parts"),
    )


@register("zipped_scores", "SELECT conv_id, turn, text, length(text) % 7 AS score FROM conversations")
def zipped_scores(spark, sf):
    """Explanations with their scores, every one with its counterpart."""
    c = table(spark, sf, "conversations")
    scores = c.select("conv_id", "turn", (F.length("text") % 7).cast("long").alias("score"))
    return cases.zip_scores(c.select("conv_id", "turn", "text"), scores, "conv_id", "turn").select("conv_id", "turn", "text", "score")


@register("distinct_roles", "SELECT conv_id, array_to_string(list_sort(list(turn::VARCHAR || ':' || role)), ',') AS turns FROM conversations GROUP BY conv_id")
def distinct_roles(spark, sf):
    """Each conversation's turns, in none of which a turn is there twice."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", F.col("turn").cast("string"), "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(querybank.unique_or_error(F.col("t"), "turn"), ",").alias("turns"))


@register("frozen_ages", "WITH m AS (SELECT epoch_us(max(ts)) // 1000 AS t FROM events WHERE event_type = 'purchase') SELECT event_id, floor((t - epoch_us(ts) // 1000) / 86400000.0)::BIGINT AS days FROM events, m")
def frozen_ages(spark, sf):
    """Ages counted back from the time at which a manifest was frozen, that of the last purchase."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    manifest = e.where("event_type = 'purchase'").agg(F.max("ms").alias("frozen_at_ms"))
    at = checks.frozen_reference(manifest)
    return e.select("event_id", F.floor((F.lit(at) - F.col("ms")) / 86_400_000).alias("days"))
