"""Review interactions: quality masks, statistics, k-core and temporal splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import missing_identifier, normalize_text
from tidemark.operators.ordering import ensure_checkpoint_dir, placed


def quality_masks(text: str = "text", rating: str = "rating", user: str = "user_id", product: str = "parent_asin", least_chars: int = 10) -> dict[str, Column]:
    """what can be wrong with a review; a null rating, or one that is no number, is invalid."""
    t = F.trim(F.col(text))
    return {
        "missing_text": F.col(text).isNull(),
        "empty_text": F.coalesce(t == "", F.lit(False)),
        "very_short_text": F.coalesce((t != "") & (F.length(t) < least_chars), F.lit(False)),
        "invalid_rating": ~F.coalesce(F.col(rating).between(1, 5) & ~F.isnan(F.col(rating).cast("double")), F.lit(False)),
        "missing_user": missing_identifier(F.col(user).cast("string")).isNull(),
        "missing_product": missing_identifier(F.col(product).cast("string")).isNull(),
    }


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """reviews with nothing wrong."""
    bad = F.lit(False)
    for mask in quality_masks().values():
        bad = bad | mask
    return reviews.where(~bad)


def review_issues(reviews: DataFrame) -> DataFrame:
    """``issue, reviews`` for each issue that occurs, with duplicate texts and the number that is clean.

    One pass counts the issues; distinct texts are counted by a hash of their normal form.
    """
    masks = quality_masks()
    bad = F.lit(False)
    for mask in masks.values():
        bad = bad | mask
    norm = normalize_text("text")
    sums = reviews.agg(
        *[F.count_if(m).alias(k) for k, m in masks.items()],
        (F.count(norm) - F.count_distinct(F.md5(norm.cast("binary")))).alias("duplicate_text"),
        F.count_if(~bad).alias("clean_rows"),
    )
    names = [*masks, "duplicate_text", "clean_rows"]
    pairs = F.array(*[F.struct(F.lit(n).alias("issue"), F.col(n).alias("reviews")) for n in names])
    return sums.select(F.explode(pairs).alias("p")).select("p.*").where("reviews > 0 or issue = 'clean_rows'")


def review_stats(interactions: DataFrame, user: str = "user_id", item: str = "item_id", rating: str = "rating") -> DataFrame:
    """A2, A3: counts, average rating and sparsity (1 without users or items)."""
    sums = interactions.agg(F.count("*").alias("n"), F.count_distinct(user).alias("users"), F.count_distinct(item).alias("items"), F.avg(rating).alias("avg_rating"))
    filled = F.try_divide(F.col("n").cast("double"), F.col("users").cast("double") * F.col("items"))
    return sums.withColumn("sparsity", F.coalesce(1 - filled, F.lit(1.0)))


def review_report(reviews: DataFrame, user: str = "user_id", item: str = "item_id", rating: str = "rating", text: str = "text", verified: str = "verified_purchase") -> DataFrame:
    """A2: counts, distinct users and items, average rating and text length, and the share of verified purchases in per cent (null without any flag)."""
    flag = F.col(verified).cast("boolean")
    return reviews.agg(
        F.count("*").alias("n"), F.count_distinct(user).alias("users"), F.count_distinct(item).alias("items"), F.round(F.avg(rating), 6).alias("avg_rating"),
        F.round(F.avg(F.length(text)), 6).alias("avg_text_length"), F.round(F.avg(flag.cast("double")) * 100, 6).alias("verified_percent"),
    )


def rating_distribution(interactions: DataFrame, rating: str = "rating") -> DataFrame:
    return interactions.groupBy(rating).agg(F.count("*").alias("n"))


def item_popularity(interactions: DataFrame, item: str = "item_id") -> DataFrame:
    """A5: each item's share of interactions."""
    counts = interactions.where(F.col(item).isNotNull()).groupBy(item).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select(item, "n", (F.col("n") / F.col("total")).alias("share"))


def popular_items(interactions: DataFrame, k: int = 10, item: str = "item_id") -> DataFrame:
    """K3: the k items with most interactions; ties by id."""
    return interactions.groupBy(item).agg(F.count("*").alias("n")).orderBy(F.desc("n"), item).limit(k)


def k_core(interactions: DataFrame, k: int = 5, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Drop users, then items, with fewer than k interactions, until nothing changes.

    Works on (user, item, n), the counts of repeated pairs combined; each round is two
    grouped sums with semi-joins and is checkpointed, so that plans don't grow.  Only a
    count goes to the driver.
    """
    ensure_checkpoint_dir(interactions.sparkSession)
    now = interactions.where(F.col(user).isNotNull() & F.col(item).isNotNull()).groupBy(user, item).agg(F.count("*").alias("__n")).checkpoint()
    size = now.agg(F.sum("__n")).first()[0]
    while True:  # every round but the last takes rows away
        for key in (user, item):
            enough = now.groupBy(key).agg(F.sum("__n").alias("__s")).where(F.col("__s") >= k).select(key)
            now = now.join(enough, key, "left_semi")
        now = now.checkpoint()
        left = now.agg(F.sum("__n")).first()[0]
        if left == size:
            break
        size = left
    return interactions.join(now.select(user, item), [user, item], "left_semi")


def temporal_split(rows: DataFrame, ts: str = "timestamp", train: float = 0.7, val: float = 0.1) -> DataFrame:
    """``split`` by place in time: train up to round(n * train), validation up to round(n * (train + val)), then test.

    Rows without a time come last, rows of one instant in the order of their other columns.
    """
    total = rows.agg(F.count("*").alias("__total"))  # one row
    cut = [F.bround(F.col("__total") * F.lit(x)).cast("long") for x in (train, train + val)]
    out = placed(rows, [F.col(ts).asc_nulls_last()], "__place").join(F.broadcast(total))
    return out.withColumn("split", F.when(F.col("__place") <= cut[0], "train").when(F.col("__place") <= cut[1], "val").otherwise("test")).drop("__place", "__total")


def split_bounds(splits: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Each split's size and first and last time, and whether it ends before the next begins."""
    bounds = splits.groupBy("split").agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    nxt = F.lead("first_ts").over(Window.orderBy(order))  # three rows
    return bounds.withColumn("ordered", F.coalesce(F.col("last_ts") < nxt, F.lit(True)))
