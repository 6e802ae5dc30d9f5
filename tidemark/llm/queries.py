"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, gif, html, langid, licenses, lm, minhash, mixing, quality, repair, sessions, tokens, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of three-word shingle sets at a similarity of 0.85."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "template_chars", "furniture_chars")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "position")


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document of the mix, in order; ``op6_curriculum_mix`` has a row a document, as its SQL."""
    order = mixing.training_order(mixing.plan_mix(_table(spark, sf_dir, "documents")))
    return order.select("doc_id", "copy", "words", "position")


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    response = F.col("response")
    return captures.select("page_id", response["payload_bytes"].alias("payload_bytes"), response["payload_digest"].alias("payload_digest"), response["type"].alias("record_type"), F.col("refers_page").alias("refers_to"))


def op8_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_histogram(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a GIF, read back; ``feature`` is the colour histogram of the pixels of all its frames."""
    stored = gif.store_texts(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    read = gif.read_media(stored)
    bins = F.transform(F.sequence(F.lit(0), F.lit(gif.BINS - 1)), lambda i: F.aggregate("frames", F.lit(0).cast("long"), lambda a, f: a + F.get(f["own_histogram"], i)).cast("string"))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.array_join(bins, ",").alias("feature"),
    )


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a log-bilinear model that has not seen the held-out fifth of the documents."""
    kept_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return lm.language_model_scores(_table(spark, sf_dir, "documents"), kept_out)


def op12_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of ``clicks``; values that are no finite number count 0."""
    value = F.col("value")
    cents = F.when(F.abs(value) < float("inf"), F.floor(100 * value + 0.5))
    found = sessions.sessionise(_table(spark, sf_dir, "clicks"), final=(value >= 60) & (F.col("kind") == "error"), value=cents)
    return found.withColumn("path_sha256", F.sha2("path", 256)).drop("path")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations repaired; ``repaired_sha256`` is of the rows afterwards as lines ``role:text``."""
    found = repair.repair_conversations(repair.damage(_table(spark, sf_dir, "conversations")))
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return found.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("repaired")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_near_duplicates, op2_language_id, op3_license_scan, op4_html_text, op5_decontamination, op6_curriculum_mix, op6_training_order, op7_warc_round_trip, op8_token_histogram, op9_quality, op10_media_gif, op11_language_model, op12_sessions, op13_conversation_repair, pipeline)
    return {f.__name__: f for f in own}


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = s.doc_id
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM s),
w AS (SELECT *, CAST(CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS cap FROM r),
o AS (SELECT *, source_size / weight AS ratio FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS lev
      FROM o WINDOW p AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, rank, CASE WHEN (SELECT count(*) FROM l WHERE lev * weight <= cap) = 0 THEN cap ELSE least(cap, (SELECT lev FROM l WHERE lev * weight <= cap ORDER BY ratio, rank LIMIT 1) * weight) END AS target FROM l),
b AS (SELECT d.doc_id, d.size, t.source_size, t.rank, t.target, CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(floor(target) AS BIGINT) AS wanted, CASE WHEN source_size > 0 THEN CAST(floor(CAST(floor(target) AS BIGINT) / source_size) AS BIGINT) ELSE 0 END AS whole FROM b),
k AS (SELECT *, CAST(whole * size + least(greatest(wanted - whole * source_size - before, 0), size) AS BIGINT) AS taken FROM c),
p AS (SELECT *, CASE WHEN taken > 0 THEN before / target END AS due, CASE WHEN (rank - 1) % 3 = 2 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS a, CASE WHEN (rank - 1) % 3 = 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS e FROM k)
SELECT doc_id, size, source_size, target, taken, CASE WHEN e - a = 0 THEN due ELSE abs((sqrt(a * a + (e - a) * 2.0::DOUBLE * due * ((a + e) / 2)) - a) / (e - a)) END AS position FROM p
"""

#: The same plan, a row a copy.
_OP6_ORDER = (
    _OP6[: _OP6.index("p AS (SELECT *, CASE WHEN taken > 0")].rstrip().rstrip(",")
    + """,
n AS (SELECT *, unnest(range(whole + CASE WHEN wanted - whole * source_size > before AND size > 0 THEN 1 ELSE 0 END)) AS copy, CASE WHEN (rank - 1) % 3 = 2 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS a, CASE WHEN (rank - 1) % 3 = 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS e FROM k WHERE taken > 0),
p AS (SELECT *, least((copy * source_size + before) / target, 1.0::DOUBLE) AS due FROM n)
SELECT doc_id, CAST(copy AS INTEGER) AS copy, CAST(least(size, taken - copy * size) AS BIGINT) AS words, CASE WHEN e - a = 0 THEN due ELSE abs((sqrt(a * a + (e - a) * 2.0::DOUBLE * due * ((a + e) / 2)) - a) / (e - a)) END AS position FROM p
"""
)

_OP7 = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to FROM m
"""


#: From click to click of each client.
_OP12 = """
WITH RECURSIVE d AS (SELECT DISTINCT click_id, client_id, epoch_us(ts) AS us, coalesce(epoch_us(arrived_at) - epoch_us(ts) > 21600000000, false) AS late, coalesce(value >= 60 AND kind = 'error', false) AS final,
                            CASE WHEN isfinite(value) THEN CAST(floor(100 * value + 0.5) AS BIGINT) ELSE 0 END AS cents
                     FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL),
t AS MATERIALIZED (SELECT client_id, us, click_id, cents, final, row_number() OVER w AS i, lag(final) OVER w AS p_final, lag(us) OVER w AS p_us FROM d WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)),
f(client_id, i, session_id, start_us, why) AS (
  SELECT client_id, i, click_id, us, '' FROM t WHERE i = 1
  UNION ALL
  SELECT client_id, i, CASE WHEN why = '' THEN session_id ELSE click_id END, CASE WHEN why = '' THEN start_us ELSE us END, why
  FROM (SELECT t.client_id, t.i, t.us, t.click_id, f.session_id, f.start_us, CASE WHEN t.p_final THEN 'end' WHEN t.us - t.p_us >= 600000000 THEN 'gap' WHEN t.us - f.start_us > 2400000000 THEN 'length' ELSE '' END AS why
        FROM f JOIN t ON t.client_id = f.client_id AND t.i = f.i + 1)),
s AS (SELECT f.client_id, f.session_id, f.start_us, min(f.i) AS i, max(t.us) AS end_us, count(*) AS n_clicks, sum(t.cents) AS cents, arg_max(t.final, f.i) AS final, arg_min(f.why, f.i) AS why, sha256(string_agg(CAST(t.click_id AS VARCHAR), ',' ORDER BY f.i)) AS path
      FROM f JOIN t ON t.client_id = f.client_id AND t.i = f.i GROUP BY f.client_id, f.session_id, f.start_us),
n AS (SELECT *, lead(why) OVER w AS next_why, lead(start_us) OVER w AS next_us FROM s WINDOW w AS (PARTITION BY client_id ORDER BY i))
SELECT client_id, session_id, start_us, end_us, n_clicks, (SELECT count(*) FROM d WHERE d.late AND d.client_id = n.client_id AND d.us >= n.start_us AND (n.next_us IS NULL OR d.us < n.next_us)) AS n_late,
       CAST(cents AS BIGINT) AS value_cents, coalesce(next_why, CASE WHEN final THEN 'end' ELSE 'none' END) AS closed_by, path AS path_sha256
FROM n
"""


def _op13() -> str:
    """The least cost and audit from each state on, from a conversation's last row to its first.

    ``v0`` to ``v3`` hold the best from each state as a struct of cost, audit and lines,
    which compare in that order.
    """

    def put(letter: str, cost: str, line: str | None, rest: str) -> str:
        lines = f"list_prepend({line}, {rest}.r)" if line else f"{rest}.r"
        return f"{{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, 'r': {lines}}}"

    due, role = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
    never = "{'c': 1000000000, 'a': '', 'r': CAST([] AS VARCHAR[])}"

    def stepped(q: int) -> str:
        to = {0: "WHEN x = 's' THEN v1 WHEN x = 'u' THEN v2", 2: "WHEN x = 'a' THEN v3"}.get(q, "WHEN x = 'u' THEN v2")
        kept = f"(CASE WHEN NOT ok THEN {never} {to} ELSE {never} END)"
        again = f"(CASE WHEN ok THEN v{due[q]} ELSE {never} END)"
        return f"least({put('D', '2', None, f'v{q}')}, {put('K', 'stays', 'line', kept)}, {put('R', 'stays + 1', chr(39) + role[due[q]] + ':' + chr(39) + ' || text', again)}) AS p{q}"

    def inserted(q: int, of: str, to: str) -> str:
        line = f"'{role[due[q]]}:'"
        return f"least(p{q}, {put('I', '5', line, f'{of}{due[q]}')}) AS {to}{q}"

    states = range(4)
    crc = "xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT)), lambda c, y: list_reduce(range(8), lambda d, j: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, y)), CAST(4294967295 AS BIGINT)), 4294967295)"
    end = {0: "{'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])}", 1: "{'c': 10, 'a': 'II', 'r': ['user:', 'assistant:']}", 2: "{'c': 5, 'a': 'I', 'r': ['assistant:']}"}
    end[3] = end[0]
    return rf"""
WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, {crc} % 20 AS how FROM b),
x AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE WHEN how = 1 THEN '' WHEN how = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[ 	-
]+$', '') AS bare FROM x),
f AS MATERIALIZED (SELECT *, left(role, 1) AS x, role || ':' || text AS line,
                          CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (p IS NOT NULL AND p || x NOT IN ('su', 'ua', 'au')) AS illegal
      FROM (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM f) GROUP BY conv_id),
z(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, n + 1, {', '.join(end[q] for q in states)} FROM g
  UNION ALL
  SELECT conv_id, i, {', '.join(inserted(q, 'q', 'w') for q in states)}
  FROM (SELECT *, {', '.join(inserted(q, 'p', 'q') for q in states)}
        FROM (SELECT conv_id, i, {', '.join(stepped(q) for q in states)}
              FROM (SELECT z.conv_id, f.i, v0, v1, v2, v3, f.x, f.text, f.line, f.fault NOT IN ('b', 'd') AS ok, CASE WHEN f.fault = 't' THEN 5 ELSE 0 END AS stays
                    FROM z JOIN f ON f.conv_id IS NOT DISTINCT FROM z.conv_id AND f.i = z.i - 1))))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(z.v0.c, 0) AS BIGINT) AS cost, coalesce(z.v0.a, '') AS audit, sha256(coalesce(array_to_string(z.v0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id AND z.i = 1
"""


def _op3() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def spelled(x: str) -> str:
        x = f"trim(regexp_replace(replace({x}, '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for old, new in licenses.SPELLINGS:
            x = f"replace({x}, {quoted(old)}, {quoted(new)})"
        return x

    def owned(x: str) -> str:
        for pattern, new in licenses.OWNERS:
            x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(new)}, 'g')"
        return x

    plain = rf"regexp_replace(regexp_replace(lower(text), '\r\n?', chr(10), 'g'), {quoted(licenses.LEADER)}, '\1', 'g')"
    bare = f"regexp_replace(p, {quoted(licenses.COPYRIGHT)}, '{chr(92)}1', 'g')"
    forms = f"{owned(spelled(bare))} AS bare, {owned(spelled('p'))} AS whole"
    known = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in licenses.known_texts() + list(licenses.NOTICES))
    return f"""
WITH raw(license_id, text) AS (VALUES {known}),
kf AS (SELECT license_id, {forms} FROM (SELECT license_id, {plain} AS p FROM raw)),
k AS (SELECT md5(x) AS digest, min(license_id) AS license_id FROM (SELECT license_id, bare AS x FROM kf UNION ALL SELECT license_id, whole FROM kf) WHERE x <> '' GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {plain} AS p FROM documents),
f AS (SELECT r, doc_id, p, {forms} FROM d),
n AS (SELECT r, doc_id, list_filter(list_transform(string_split(p, chr(10)), lambda x: {spelled('x')}), lambda y: y <> '') AS l, CASE WHEN bare <> '' THEN md5(bare) END AS text_digest, CASE WHEN whole <> '' THEN md5(whole) END AS whole_digest FROM f),
e AS (SELECT r, md5(unnest(l)) AS digest FROM n),
c AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n_notices FROM e JOIN k USING (digest) GROUP BY r)
SELECT n.doc_id, n.text_digest, coalesce(a.license_id, b.license_id) AS license_id, coalesce(c.notices, '') AS notices, CAST(coalesce(c.n_notices, 0) AS BIGINT) AS n_notices
FROM n LEFT JOIN c ON c.r = n.r LEFT JOIN k a ON a.digest = n.text_digest LEFT JOIN k b ON b.digest = n.whole_digest
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": _OP1, "op3_license_scan": _op3(), "op6_curriculum_mix": _OP6, "op6_training_order": _OP6_ORDER, "op7_warc_round_trip": _OP7, "op12_sessions": _OP12, "op13_conversation_repair": _op13()}
