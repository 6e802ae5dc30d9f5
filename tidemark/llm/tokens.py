"""Exact token-length histograms.

Texts are encoded with a public byte-pair vocabulary and only their lengths are kept.
Documents are counted by encoded length; suffix sums over the lengths then answer, for
every context limit at once, how many documents and tokens there are beyond it, and how
many tokens remain if texts are cut at it.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the usual pattern that cuts text into pieces before byte-pair merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
GROUP = 256


def load_ranks(spark: SparkSession, path: str = VOCABULARY) -> bytes:
    """The vocabulary file, a few MB at most for any tokenizer, read on the driver.

    ``path`` may be of any store that Spark's file systems reach; without a scheme it is
    one of the driver's own files.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def _encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def _count(encoder, text: str | None) -> int:
    return len(encoder.encode_ordinary(text)) if text else 0


def token_lengths(docs: DataFrame, ranks: bytes, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text; null and empty texts have none."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(shared.value)
        for texts in batches:
            yield pd.Series([_count(encoder, t) for t in texts], dtype="int64")

    return docs.withColumn(name, count(F.col(text_col).cast("string")))


def length_histogram(lengths: DataFrame, name: str = "n_tokens") -> DataFrame:
    """One row for each length that occurs, with what suffix sums say about a context limit of that length.

    ``n_tokens, docs, tokens``: documents of that length and their tokens;
    ``docs_over, tokens_over``: of longer documents; ``truncated_total``: tokens left
    when every text is cut at this length; ``rank_from, rank_to``: the places, from 1, of
    these documents in order of length, from which any quantile can be read.

    Rows with a null length are ignored.  Sums run in two levels, over groups of 256
    lengths and within each, so that no task sees all lengths.
    """
    counts = lengths.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("n_tokens")).agg(F.count("*").alias("docs")).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    # written, a row a length: it is used twice below, and texts are to be encoded once
    counts = materialize(counts.withColumn("__group", F.floor(F.col("n_tokens") / GROUP)), "lengths")
    groups = counts.groupBy("__group").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    # one row for 256 lengths: few, whatever the number of documents
    after = Window.orderBy(F.desc("__group")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("__group", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for c, w, n in (("d", after, "d_after"), ("t", after, "t_after"), ("d", before, "d_before"), ("t", before, "t_before"))])
    within = Window.partitionBy("__group").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("__group").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    out = counts.join(groups, "__group").withColumns(
        {
            "docs_over": F.coalesce(F.sum("docs").over(within), F.lit(0)) + F.col("d_after"),
            "tokens_over": F.coalesce(F.sum("tokens").over(within), F.lit(0)) + F.col("t_after"),
            "docs_under": F.coalesce(F.sum("docs").over(below), F.lit(0)) + F.col("d_before"),
            "tokens_under": F.coalesce(F.sum("tokens").over(below), F.lit(0)) + F.col("t_before"),
        }
    )
    return out.select(
        "n_tokens", "docs", "tokens", "docs_over", "tokens_over", (F.col("tokens_under") + F.col("tokens") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_total"),
        (F.col("docs_under") + 1).alias("rank_from"), (F.col("docs_under") + F.col("docs")).alias("rank_to"),
    )


def context_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, docs_over, total, truncated_total``: exact answers for any limits, from the histogram.

    A document of just the limit's length is not over it.  A limit that is named twice has
    two rows; an empty histogram gives zeros, no limits no rows.  Null lengths, which
    ``length_histogram`` has none of, are over no limit.
    """
    spark: SparkSession = histogram.sparkSession
    asked = spark.createDataFrame([(int(v),) for v in limits], "limit long")
    over = F.col("n_tokens") > F.col("limit")
    # the limits are a stated list; the histogram is combined into one row a limit
    joined = histogram.select("n_tokens", "docs", "tokens", F.explode(F.array(*[F.lit(v).cast("long") for v in sorted({int(v) for v in limits})])).alias("limit")) if limits else histogram.limit(0).withColumn("limit", F.lit(0).cast("long"))
    sums = joined.groupBy("limit").agg(F.sum(F.when(over, F.col("docs")).otherwise(0)).alias("docs_over"), F.sum("tokens").alias("total"), F.sum(F.when(over, F.col("limit") * F.col("docs")).otherwise(F.col("tokens"))).alias("truncated_total"))
    return asked.join(sums, "limit", "left").na.fill(0)


def quantile_lengths(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the length of the document at place ``ceil(share * documents)``, at least the first.

    Documents of equal length share their places.  A share that is named twice has two
    rows, one over 1 none; an empty histogram gives no rows.
    """
    total = histogram.agg(F.max("rank_to").alias("all"))
    asked = histogram.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    places = asked.join(F.broadcast(total), F.lit(True)).withColumn("place", F.greatest(F.ceil(F.col("share") * F.col("all")), F.lit(1)))
    # the places are a stated list, a few rows
    return places.join(histogram, (F.col("place") >= F.col("rank_from")) & (F.col("place") <= F.col("rank_to"))).select("share", "n_tokens")


def token_histogram(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """``length_histogram`` of ``docs``: one row a length, of every whole text, however long.

    Null and empty texts are documents of length 0.  Rows that repeat are counted as often
    as they are there.  Other columns are ignored.  An empty table gives no rows.
    """
    return length_histogram(token_lengths(docs.select(F.col(text_col).alias("text")), load_ranks(docs.sparkSession, vocabulary)))
