"""Serving analytics: latency, cache simulation, corpus statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import percentiles


def latency_summary(samples: DataFrame, by: tuple[str, ...] = (), value: str = "client_ms") -> DataFrame:
    """Range, mean, exact linear percentiles and sample deviation."""
    sums = samples.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std"))
    cuts = percentiles(samples, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, list(by))
    cuts = cuts.select(*[F.col(c).alias(f"__{c}") for c in by], *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return sums.join(cuts, on, "left").select(*by, "n", "min", "max", "mean", "p50", "p95", "p99", "std")  # a row a group on either side


def phase_summary(samples: DataFrame, phase: str = "phase") -> DataFrame:
    """Each phase's requests, successes and errors, headers that came, cache results that are known, and how many answers are grounded or rightly refused.

    Rates are over successful requests that tell: a cache rate over known results, quality
    rates over requests that were judged; null without any.
    """
    good = F.col("status") == 200
    known = good & F.col("cache_result").isNotNull() & (F.col("cache_result") != "unknown")
    hit = known & F.col("cache_result").isin("exact", "semantic")
    judged = good & F.col("grounded_success").isNotNull()
    rate = lambda a, b: F.round(F.try_divide(F.count_if(a).cast("double"), F.count_if(b)), 4)
    return samples.groupBy(phase).agg(
        F.count("*").alias("total_requests"), F.count_if(good).alias("successful"), F.count_if(~F.coalesce(good, F.lit(False))).alias("errors"),
        F.count_if(good & F.col("server_timing_header_present")).alias("timing_headers"), F.count_if(good & F.col("cache_result_header_present")).alias("cache_headers"),
        F.count_if(hit).alias("cache_hits"), rate(hit, known).alias("cache_hit_rate"), F.count_if(judged).alias("judged"), rate(judged & F.col("grounded_success"), judged).alias("grounded_rate"),
        rate(judged & F.col("refusal_aware_success"), judged).alias("refusal_aware_rate"), F.count_distinct("query").alias("queries"),
    )


def status_counts(samples: DataFrame, phase: str = "phase") -> DataFrame:
    """Requests of each phase by status."""
    return samples.groupBy(phase, F.col("status").cast("string").alias("status")).agg(F.count("*").alias("requests"))


def headline(summary: DataFrame, target_ms: float = 500.0) -> DataFrame:
    """The server's 95th percentile, else the client's, where it is from, and whether it meets the target (null without either)."""
    value = F.coalesce("server_p95", "client_p95")
    return summary.select(value.alias("headline_ms"), F.when(F.col("server_p95").isNotNull(), "server").otherwise("client_fallback").alias("source"), (value <= target_ms).alias("pass"))


def exact_cache(requests: DataFrame, key: str = "key", ts: str = "ts", ttl_s: int = 3600) -> DataFrame:
    """Each request as a hit if the same key was put within the time to live.

    A miss puts the result, which then lives for ``ttl_s``; a hit doesn't prolong it.  Rows
    are dealt by key and sorted by time within their part; each part is then read once from
    front to back, and what is kept meanwhile is one key and the time of its last miss.
    From a miss on, the next is found by a search in the sorted times.
    """
    types = dict(requests.dtypes)
    rows = requests.select(F.col(key).alias("key"), F.col("request_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    ttl = ttl_s * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, put = None, None
        for batch in batches:
            keys, times = batch["key"].to_numpy(), batch["t"].to_numpy()
            hit = np.ones(len(batch), bool)
            # the first row of each run of one key
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(batch) else np.empty(0, int)
            for begin, end in zip(edges, np.append(edges[1:], len(batch)), strict=True):
                if keys[begin] != last:
                    last, put = keys[begin], None
                own = times[begin:end]
                at = 0 if put is None else int(np.searchsorted(own, put + ttl, "right"))
                while at < len(own):
                    put = own[at]
                    hit[begin + at] = False
                    at = int(np.searchsorted(own, put + ttl, "right"))
            yield pd.DataFrame({"key": keys, "request_id": batch["request_id"], "hit": hit})

    known = rows.where("key is not null and t is not null").repartition("key").sortWithinPartitions("key", "t", "request_id")
    out = known.mapInPandas(run, f"key {types[key]}, request_id {types['request_id']}, hit boolean")
    # a request without a key or a time is never a hit
    out = out.unionByName(rows.where("key is null or t is null").select("key", "request_id", F.lit(False).alias("hit")))
    return out.select(F.col("key").alias(key), "request_id", "hit")


def cache_stats(results: DataFrame, similarity: str | None = None) -> DataFrame:
    """Requests, hits and hit rate, and the mean similarity of hits that have one."""
    mean = F.round(F.avg(F.when(F.col("hit"), F.col(similarity))), 6) if similarity else F.lit(None).cast("double")
    return results.agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), mean.alias("avg_similarity"))


def request_counters(events: DataFrame, ts: str = "ts", width: str = "1 hour", endpoint: str = "event_type", value: str = "value") -> DataFrame:
    """Requests, errors and a latency histogram by window and endpoint; works on a stream too."""
    edges = ((50, "le_50"), (100, "le_100"), (250, "le_250"), (500, "le_500"))
    sums = events.groupBy(F.window(ts, width).alias("__w"), endpoint).agg(F.count("*").alias("requests"), F.round(F.sum(value), 4).alias("total"), *[F.count_if(F.col(value) <= e).alias(n) for e, n in edges])
    return sums.select(F.col("__w.start").alias("window_start"), endpoint, "requests", "total", *[n for _, n in edges])


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """Chunks, reviews, products, lengths."""
    n = F.length("text")
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct("review_id").alias("reviews"), F.count_distinct("product_id").alias("products"), F.percentile(n, 0.5).alias("median_chars"), F.round(F.avg(n), 6).alias("mean_chars"), F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"))


def chunks_per_review(chunks: DataFrame) -> DataFrame:
    """How many reviews have how many chunks."""
    return chunks.groupBy("review_id").agg(F.count("*").alias("n_chunks")).groupBy("n_chunks").agg(F.count("*").alias("reviews"))


def month_histogram(rows: DataFrame, ts: str, last: int = 24) -> DataFrame:
    """Rows by month, the last ``last`` months."""
    return rows.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count("*").alias("n")).orderBy(F.desc("month")).limit(last)


def first_ratings(rows: DataFrame, review: str, rating: str, ordinal: str) -> DataFrame:
    """The distribution of each review's first rating."""
    return rows.groupBy(review).agg(F.min_by(rating, ordinal).alias("rating")).groupBy("rating").agg(F.count("*").alias("n"))


def embedding_validation(points: DataFrame, vector: str, size: int, tolerance: float = 0.01) -> DataFrame:
    """Vectors of a wrong size, with a value that is no number, or not of length 1."""
    from tidemark.functions.vectors import norm

    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return points.agg(F.count("*").alias("n"), F.count_if(F.size(v) != size).alias("wrong_size"), F.count_if(odd).alias("not_finite"), F.count_if(F.abs(norm(v) - 1) > tolerance).alias("not_unit"))


def chars_per_token(rows: DataFrame, chars: str, tokens: str) -> DataFrame:
    """Mean and sample deviation of characters a token."""
    ratio = F.try_divide(F.col(chars).cast("double"), F.col(tokens))
    return rows.agg(F.count(ratio).alias("n"), F.round(F.avg(ratio), 6).alias("mean"), F.round(F.stddev_samp(ratio), 6).alias("std"))


def lag_hits(requests: DataFrame, key: str, ts: str, ttl_s: int) -> DataFrame:
    """X1 in windows: whether the same key was asked for within ``ttl_s`` before (a sliding life)."""
    w = Window.partitionBy(key).orderBy(ts, "request_id")
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)
    return requests.withColumn("hit", F.coalesce(gap <= ttl_s * 1_000_000, F.lit(False)))
