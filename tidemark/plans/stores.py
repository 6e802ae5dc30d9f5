"""Queries that write and read back through sources and sinks, and over streams, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import validation as V
from tidemark.plans import fixtures as X
from tidemark.plans import registry as R
from tidemark.plans.registry import register
from tidemark.session import table
from tidemark.sources import readers
from tidemark.sources.collection import Collection, get_record, put_record
from tidemark.sources.paths import new_path
from tidemark.streaming.serving import cache_settings, run_to_table, semantic_cache, stream_counters

_DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())])


@register("source_json_lines", "SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN lang END AS lang, text FROM documents")
def source_json_lines(spark, sf):
    """Documents through JSON lines, with nulls."""
    path = new_path(spark, "json-lines")
    readers.write_json_lines(table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 13 != 0, F.col("lang")).alias("lang"), "text"), path)
    return spark.read.schema(_DOC).json(path)


def _mixed_lines(spark, sf):
    """Four files, in folders, with lines that are no JSON, blank ones, and ones of another type."""
    path = new_path(spark, "mixed-lines")
    i = F.col("event_id")
    line = F.when(i % 50 == 7, "{not json").when(i % 50 == 9, "").when(i % 50 == 11, '{"doc_id": "x"}').otherwise(F.to_json(F.struct(i.alias("doc_id"), F.col("event_type").alias("lang"))))
    table(spark, sf, "events").select("event_id", line.alias("value"), (i % 4).alias("part")).repartition(4, "part").sortWithinPartitions("part", "event_id").select("value", "part").write.partitionBy("part").text(path)
    return path


@register("source_good_rows", "SELECT event_id AS doc_id, event_type AS lang FROM events WHERE event_id % 50 NOT IN (7, 9, 11)")
def source_good_rows(spark, sf):
    good, _ = readers.read_json_rows(spark, _mixed_lines(spark, sf), _DOC)
    return good.select("doc_id", "lang")


@register("source_bad_lines", "WITH n AS (SELECT event_id, event_id % 4 AS part, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS line FROM events) SELECT CAST(part AS INT) AS part, line, CASE event_id % 50 WHEN 7 THEN '{not json' ELSE '{\"doc_id\": \"x\"}' END AS value FROM n WHERE event_id % 50 IN (7, 11)")
def source_bad_lines(spark, sf):
    """Lines that don't fit, with their numbers."""
    return readers.numbered_json_rows(spark, _mixed_lines(spark, sf), _DOC)[1].select("part", "line", "value")


@register("source_stream_rows", "SELECT event_id AS doc_id, event_type AS lang, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS line FROM events QUALIFY event_id % 50 NOT IN (7, 9, 11)")
def source_stream_rows(spark, sf):
    """The same files as a stream, two a batch."""
    path = new_path(spark, "lines-of-a-stream")
    readers.stream_json_rows(spark, f"{_mixed_lines(spark, sf)}/*", _DOC, f"{path}/good", f"{path}/bad", f"{path}/progress", 2)
    return spark.read.parquet(f"{path}/good").select("doc_id", "lang", "line")


@register("source_reviews", "SELECT 'text ' || event_id AS text, CASE WHEN event_id % 9 <> 0 THEN CAST(1 + event_id % 5 AS DOUBLE) END AS rating, 'u' || user_id AS user_id, 'p' || (event_id % 40) AS parent_asin, epoch_us(ts) // 1000 AS timestamp, event_id % 3 = 0 AS verified_purchase FROM events WHERE event_id % 50 <> 7")
def source_reviews(spark, sf):
    """Reviews as JSON lines, some of which break off."""
    path, i = new_path(spark, "reviews"), F.col("event_id")
    row = F.struct(
        F.concat(F.lit("text "), i.cast("string")).alias("text"), F.when(i % 9 != 0, (1 + i % 5).cast("double")).alias("rating"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"), F.concat(F.lit("p"), (i % 40).cast("string")).alias("parent_asin"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), (i % 3 == 0).alias("verified_purchase"),
    )
    line = F.when(i % 50 == 7, F.substring(F.to_json(row), 1, 20)).otherwise(F.to_json(row))
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return readers.read_reviews(spark, path)


@register("source_delimited", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CAST(NULL AS VARCHAR) AS colour FROM part")
def source_delimited(spark, sf):
    """A table whose file says nothing of its delimiter, columns by other names, one that isn't there."""
    path = new_path(spark, "delimited")
    table(spark, sf, "part").select("p_partkey", "p_name").write.option("header", True).option("sep", ",").csv(path)
    return readers.read_table(spark, path, {"id": ["part_id", "P_PARTKEY"], "name": ["p_name"], "colour": ["colour"]})


@register("source_json_array", "SELECT item_id, text FROM benchmark")
def source_json_array(spark, sf):
    """Arrays over many lines, of a thousand objects at most."""
    path = new_path(spark, "array")
    rows = table(spark, sf, "benchmark").groupBy(F.floor(F.col("item_id") / 1000).alias("part")).agg(F.array_join(F.collect_list(F.to_json(F.struct("item_id", "text"))), ",\n").alias("j"))
    # a file an array
    rows.select(F.concat(F.lit("[\n"), "j", F.lit("\n]")).alias("value"), "part").write.partitionBy("part").text(path)
    return readers.read_json_array(spark, path, non_empty=True).select("item_id", "text")


@register("versioned_result", "SELECT p_partkey FROM part WHERE p_partkey % 2 = 0")
def versioned_result(spark, sf):
    """The second version is what is read."""
    root = new_path(spark, "versions")
    p = table(spark, sf, "part").select("p_partkey")
    readers.write_versioned(p, root, "parts")
    readers.write_versioned(p.where("p_partkey % 2 = 0"), root, "parts")
    return readers.read_latest(spark, root, "parts")


@register("upserted_points", "SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS label FROM embeddings UNION ALL SELECT 1000000 + vec_id, label FROM embeddings WHERE vec_id % 100 = 0")
def upserted_points(spark, sf):
    """Points written, some replaced, some added, and the collection scanned."""
    path = new_path(spark, "collection")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    new = e.where("id % 5 = 0").withColumn("label", F.lit(-1)).unionByName(e.where("id % 100 = 0").withColumn("id", F.col("id") + 1000000))
    readers.write_collection(readers.upsert_points(e, new), path, files=4, key="id")
    return readers.scroll(spark, path, ["id", "label"])


def _collection(spark, sf):
    """A collection after two upserts, a deletion and a compaction between them."""
    points = Collection(spark, new_path(spark, "points"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    points.create(e)
    points.upsert(e.where("id % 5 = 0").withColumn("label", F.lit(-1)))
    points.compact()
    points.delete(e.where("id % 7 = 0").select("id"))
    points.upsert(e.where("id % 14 = 0").withColumn("label", F.lit(-2)).unionByName(e.where("id % 100 = 0").withColumn("id", F.col("id") + 1_000_000)))
    return points


@register("collection_points", "SELECT vec_id AS id, CASE WHEN vec_id % 14 = 0 THEN -2 WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS label, len(embedding) AS dims FROM embeddings WHERE vec_id % 7 <> 0 OR vec_id % 14 = 0 UNION ALL SELECT 1000000 + vec_id, label, len(embedding) FROM embeddings WHERE vec_id % 100 = 0")
def collection_points(spark, sf):
    """The last version of a collection."""
    return _collection(spark, sf).read(columns=["id", "label", "vector"]).select("id", "label", F.size("vector").cast("long").alias("dims"))


@register("collection_snapshot", "SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS label FROM embeddings WHERE vec_id < 300")
def collection_snapshot(spark, sf):
    """An earlier version of it, of a range of ids."""
    return _collection(spark, sf).read(2, ["id", "label"], F.col("id") < 300)


@register("collection_info", "SELECT points_count, 5 AS version, 'yellow' AS status, true AS there, 1700000000000 AS stamped_at, points_count AS recorded FROM (SELECT count(*) FILTER (vec_id % 7 <> 0 OR vec_id % 14 = 0) + count(*) FILTER (vec_id % 100 = 0) AS points_count FROM embeddings)")
def collection_info(spark, sf):
    """What is known of a collection, and the record about it."""
    points = _collection(spark, sf)
    info = points.info()
    records = Collection(spark, new_path(spark, "records"), "key")
    put_record(records, "anchor:points", info, 1)
    put_record(records, "anchor:points", info, 1_700_000_000_000)
    record = get_record(records, "anchor:points", "points_count long").select(F.col("points_count").alias("recorded"), "stamped_at")
    return info.join(record).select("points_count", "version", "status", F.lit(points.exists()).alias("there"), "stamped_at", "recorded")


@register("split_read", f"WITH {R._SPLIT} SELECT event_id FROM s WHERE split = 'val'")
def split_read(spark, sf):
    """One split of three, read by its folder."""
    from tidemark.operators import interactions

    path = new_path(spark, "splits")
    rows = table(spark, sf, "events").select(F.when(F.col("event_id") % 97 != 0, F.col("ts")).alias("ts"), "event_id")
    readers.write_splits(interactions.temporal_split(rows, "ts"), path)
    return spark.read.parquet(path).where("split = 'val'").select("event_id")


@register("reused_vectors", "SELECT item_id, item_id % 2 = 0 AS known FROM benchmark")
def reused_vectors(spark, sf):
    """Texts of which every other one has a vector already; a text that repeats counts by its fingerprint."""
    b = table(spark, sf, "benchmark")
    texts = b.select("item_id", F.concat("text", F.lit("|"), F.col("item_id").cast("string")).alias("text"))
    cache = texts.where("item_id % 2 = 0").select(F.sha2("text", 256).alias("fingerprint"), F.array(F.lit(1.0)).alias("vector"))
    known, new = readers.reuse_vectors(texts, cache)
    return known.select("item_id", F.lit(True).alias("known")).unionByName(new.select("item_id", F.lit(False).alias("known")))


@register("prepared_products", "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS product_id FROM lineitem")
def prepared_products(spark, sf):
    """Product ids made once and read from their place the second time."""
    path = readers.prepared_path(new_path(spark, "products"), None)
    li = table(spark, sf, "lineitem")
    readers.product_ids(spark, path, li, "l_partkey")
    return readers.product_ids(spark, path, li.limit(0), "l_partkey")


@register("dataset_round_trip", f"WITH {R._OBS} SELECT query_id, product_id, chunk_count, CAST(total_tokens AS BIGINT) AS total_tokens, top_score, grade FROM o")
def dataset_round_trip(spark, sf):
    """S15."""
    path = new_path(spark, "dataset")
    readers.write_dataset(X.queries(spark, sf).select("query_id"), R._observations(spark, sf), path)
    return readers.read_dataset(spark, path)[1].select("query_id", "product_id", "chunk_count", "total_tokens", "top_score", "grade")


@register("case_table_round_trip", "SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN lang END AS lang, text FROM documents ORDER BY doc_id LIMIT 25")
def case_table_round_trip(spark, sf):
    """Rows through JSON lines, the first 25 read back."""
    path = new_path(spark, "cases")
    readers.write_json_table(table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 13 != 0, F.col("lang")).alias("lang"), "text"), path)
    return readers.read_json_table(spark, path, _DOC, 25, "doc_id")


_BANK_ROWS = "bk AS (SELECT 'b' || item_id AS query_id, CASE WHEN item_id % 9 = 0 THEN ' ' WHEN item_id % 9 <> 1 THEN text END AS text, CASE WHEN item_id % 5 <> 0 THEN 'bench' END AS source_type, item_id % 4 <> 0 AS active, item_id % 2 AS tag, item_id FROM benchmark)"


def _bank_rows(spark, sf):
    i = F.col("item_id")
    return table(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), i.cast("string")).alias("query_id"), F.when(i % 9 == 0, " ").when(i % 9 != 1, F.col("text")).alias("text"), F.when(i % 5 != 0, "bench").alias("source_type"), (i % 4 != 0).alias("active"),
        F.array(F.concat(F.lit("t"), (i % 2).cast("string"))).alias("subset_tags"), F.when(i % 3 != 0, F.create_map(F.lit("p"), F.lit(1.0))).otherwise(F.create_map().cast("map<string,double>")).alias("relevant_items"),
    )


@register("bank_quarantine", f"WITH {_BANK_ROWS} SELECT query_id, concat_ws(',', CASE WHEN text IS NULL THEN 'text: missing' WHEN trim(text) = '' THEN 'text: empty' END, CASE WHEN source_type IS NULL THEN 'source_type: missing' END) AS problems FROM bk WHERE text IS NULL OR trim(text) = '' OR source_type IS NULL")
def bank_quarantine(spark, sf):
    """Rows that lack something, and what."""
    return V.quarantine(_bank_rows(spark, sf), readers.bank_checks())[1].select("query_id", F.array_join("problems", ",").alias("problems"))


@register("bank_subset", f"WITH {_BANK_ROWS} SELECT query_id FROM bk WHERE trim(text) <> '' AND source_type IS NOT NULL AND active AND tag = 1 AND item_id % 3 <> 0")
def bank_subset(spark, sf):
    """Rows that are well, active, of a subset and judged."""
    good, _ = V.quarantine(_bank_rows(spark, sf), readers.bank_checks())
    return readers.active_subset(readers.load_bank(good), "t1", need_items=True, non_empty=True).select("query_id")


@register("stream_request_counters", """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS requests, round(sum(value), 4) AS total, count(*) FILTER (value <= 50) AS le_50, count(*) FILTER (value <= 100) AS le_100, count(*) FILTER (value <= 250) AS le_250, count(*) FILTER (value <= 500) AS le_500 FROM events GROUP BY ALL)
SELECT * FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_request_counters(spark, sf):
    """Events as a stream of files, into a table; windows that the watermark has passed are in it."""
    path = new_path(spark, "stream")
    events = table(spark, sf, "events")
    events.repartitionByRange(4, "ts").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    counters = run_to_table(stream_counters(stream), f"{path}/out")
    return counters.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("semantic_cache_levels")
def semantic_cache_levels(spark, sf):
    """A vector with each event, through the cache as a stream that is started anew for each quarter of the events' time."""
    path = new_path(spark, "cache")
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = vectors.count()
    requests = table(spark, sf, "events").select(
        F.concat(F.lit("s"), F.pmod("user_id", F.lit(8))).alias("shard"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(":", "event_type", F.pmod("user_id", F.lit(20))).alias("key"), F.pmod(F.col("event_id") * 7, F.lit(n)).alias("vec_id")
    ).join(vectors, "vec_id", "left").drop("vec_id")
    low, high = requests.agg(F.min("ts"), F.max("ts")).first()
    quarter = F.least(F.lit(3), F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(low))) * 4 / F.greatest(F.lit(1), F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)))))
    found = None
    with cache_settings(spark):
        for q in range(4):
            requests.where(quarter == q).write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(requests.schema).parquet(f"{path}/in")
            found = run_to_table(semantic_cache(stream, ttl_s=86_400, capacity=40), f"{path}/out")
    return found
