"""Vector functions as column expressions, and hash-based fractions (M1-M9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """M2: sum of products, in double precision."""
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def fused(a: Column, b: Column, c: Column) -> Column:
    """a times b plus c in double precision, rounded once: the product's and the sum's errors are carried along."""
    split = lambda x: x * 134217729.0 - (x * 134217729.0 - x)  # noqa: E731 - the upper half of the digits
    high_a, high_b, p = split(a), split(b), a * b
    low_a, low_b = a - high_a, b - high_b
    lost = ((high_a * high_b - p) + high_a * low_b + low_a * high_b) + low_a * low_b
    s = p + c
    back = s - p
    return s + (((p - (s - back)) + (c - back)) + lost)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """M1: to length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_doubles(v), lambda x: x / n)).otherwise(as_doubles(v))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def hash_fraction(key: Column) -> Column:
    """M4: the first 16 hex digits of SHA-256 as a share of the largest such number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("double") / F.lit(18446744073709551615.0)


def subset_tag(fraction: Column, retrieval: float = 0.8, dev: float = 0.75, faithfulness_dev: float = 1 / 3) -> Column:
    """M5: one of four subsets, from nested shares of a fraction."""
    inner = fraction / retrieval
    rest = (fraction - retrieval) / (1 - retrieval)
    return F.when(fraction < retrieval, F.when(inner < dev, "retrieval_dev_holdout").otherwise("retrieval_final_report")).otherwise(F.when(rest < faithfulness_dev, "faithfulness_dev_seed").otherwise("faithfulness_final_seed"))


def point_id(review_id: Column, index: Column) -> Column:
    """M6: MD5 of review id and chunk index."""
    return F.md5(F.concat_ws("_", review_id, index.cast("string")).cast("binary"))


def relevance_grade(rating: Column) -> Column:
    """M3: 0 under 3 stars, 1 under 4, 2 under 5, else 3."""
    return F.when(rating < 3, 0.0).when(rating < 4, 1.0).when(rating < 5, 2.0).otherwise(3.0)


def item_coverage(a: Column, b: Column) -> Column:
    """M9: shared items over the smaller set; 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b))), F.lit(0.0))


def hash_cells(key: Column, dimensions: int = 8) -> Column:
    """Coordinates between -1 and 1 that depend on the key alone: each from a hash of key and place."""
    cell = lambda i: F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967295.0 * 2 - 1
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), cell)


def hash_vector(key: Column, dimensions: int = 8) -> Column:
    """M7: a vector of length 1 that depends on the key alone."""
    return F.transform(F.array(hash_cells(key, dimensions)), l2_normalize)[0]
