"""Mixing sources to target weights along a time-varying curriculum.

Every source has a share of the mix's words, its target, and a schedule of its weight
over training time from 0 to 1.  The integral of the schedule says how many of the
source's words are due by any time; inverting it at a document's place in its source
gives the training position of each time that a document is taken.  Those are then
range-sorted by position.

All of it is DataFrame operations: running sums are taken in two levels, over hash
buckets of a source and within each, so that a source with most of the rows is spread
over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import spare

WEIGHTS = (5, 2, 1)
#: Weight at the start and the end of training, in turn by source; linear between.
SCHEDULES = ((1.0, 3.0), (1.0, 1.0), (3.0, 1.0))
WORD = r"[^\x20\x09-\x0D]+"
EPOCHS = 2


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _running(value: str, *order: Column) -> Column:
    """Sum of ``value`` over the rows before, in order."""
    return F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size, rank, weight, target``: one row a source, from its size in words.

    Sources in order of code points, null last, take ``weights`` in turn.  They share
    ``share`` times all words by weight; a target stops at ``cap`` times its source's
    size, and what is above is shared again by weight until none is above.  That is one
    level ``l`` with ``target = min(cap * size, l * weight)``, found from running sums of
    the sources in order of ``size / weight``.  Sources without a word have target 0.
    All sources are ordered in one task, a row each: some millions of them at most.
    """
    # a row a source: the windows below are over those, not over documents
    by_name = Window.partitionBy("__part").orderBy(F.col("source").isNull(), F.col("source"))
    rows = sizes.withColumn("__part", F.lit(0)).withColumn("rank", F.row_number().over(by_name))
    turn = (F.col("rank") - 1) % len(weights)
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("double"))
    rows = rows.withColumns({"__cap": F.col("source_size") * F.lit(float(cap)), "__ratio": F.col("source_size") / F.col("weight")})
    # the level if the sources before this one, the most easily filled, are at their caps
    order = (F.col("__ratio"), F.col("source").isNull(), F.col("source"))
    everywhere = Window.partitionBy("__part")
    rows = rows.withColumns({"__full": _running("__cap", *order), "__taken": _running("weight", *order)})
    left = F.sum("weight").over(everywhere) - F.col("__taken")
    rows = rows.withColumn("__level", (F.sum("source_size").over(everywhere) * F.lit(float(share)) - F.col("__full")) / left)
    # the first source that its level does not fill sets the level for it and those after
    rows = rows.withColumn("__level", F.min(F.when(F.col("__level") * F.col("weight") <= F.col("__cap"), F.struct("__ratio", "rank", "__level"))).over(everywhere)["__level"])
    target = F.when(F.col("__level").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__level") * F.col("weight")))
    return rows.select("source", "source_size", "rank", "weight", target.alias("target"))


def _position(due: Column, start: Column, end: Column) -> Column:
    """The time by which a share ``due`` of a source's words is due: its linear schedule's integral, inverted.

    With ``w(t) = start + (end - start) t``, the share due by ``t`` is
    ``(start t + (end - start) t^2 / 2) / ((start + end) / 2)``.
    """
    slope = end - start
    whole = (start + end) / 2
    root = F.sqrt(start * start + slope * 2.0 * due * whole)
    return F.when(slope == 0, due).otherwise(F.abs((root - start) / slope))  # never minus zero


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, schedules: tuple[tuple[float, float], ...] = SCHEDULES, buckets: int = 4096) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken, position, positions``: what the mix takes, and when.

    A source's documents are in order of a hash of their ids.  With ``target`` words
    wanted of ``source_size``, every document is taken ``floor(target / source_size)``
    times, and those first in order, up to the wanted number of words, once more; of the
    document at that limit only the words still wanted are taken the last time, so that
    a source's words are its target less a fraction.  ``position``, from 0 to 1, is the
    training time of the first time a document is taken; null if it never is.
    ``positions`` has the training time of every time it is taken, in order: of copy
    ``k``, counted from 0, that by which ``k`` times the source and the words before the
    document in it are due.

    Null texts have size 0 and are taken with 0 words, documents without an id come first
    in their source's order, a null source is a source of its own, repeated rows are
    documents of their own, those with one id in the order of their sizes and a hash of
    their texts.  Columns of the new names are replaced.  Reruns agree.
    """
    new = ("size", "source_size", "target", "taken", "position", "positions")
    kept = [c for c in docs.columns if c not in new]
    own = [c for c in kept if c.startswith("__")]  # names as those used below
    away = dict(zip(own, spare(docs.columns, *[f"kept{c}" for c in own]), strict=True))
    docs = docs.withColumnsRenamed(away)
    kept, names = [away.get(c, c) for c in kept], kept
    id_col, text_col, source_col = (away.get(c, c) for c in (id_col, text_col, source_col))
    rows = docs.select(*kept, word_count(F.col(text_col).cast("string")).alias("size")).withColumns({"__source": F.col(source_col).cast("string"), "__hash": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))})
    width = max(1, len(hex(buckets - 1)) - 2)
    rows = rows.withColumn("__bucket", F.substring("__hash", 1, width))
    sums = rows.groupBy("__source", "__bucket").agg(F.sum("size").alias("__in_bucket"))
    sizes = sums.groupBy(F.col("__source").alias("source")).agg(F.sum("__in_bucket").alias("source_size"))
    targets = source_targets(sizes, weights, share).withColumnRenamed("source", "__source")
    starts = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before_bucket", F.coalesce(F.sum("__in_bucket").over(starts), F.lit(0))).drop("__in_bucket")
    plan = sums.alias("s").join(targets.alias("t"), F.col("s.__source").eqNullSafe(F.col("t.__source"))).select("s.__source", "s.__bucket", "s.__before_bucket", "t.source_size", "t.rank", "t.target")
    plan = plan.withColumnsRenamed({"__source": "__plan_source", "__bucket": "__plan_bucket"})
    placed = rows.join(plan, F.col("__source").eqNullSafe(F.col("__plan_source")) & (F.col("__bucket") == F.col("__plan_bucket")))
    within = Window.partitionBy("__source", "__bucket").orderBy("__hash", F.col(id_col), F.desc("size"), F.xxhash64(F.col(text_col).cast("string"))).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("__before", F.col("__before_bucket") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    wanted = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("long")
    rest = wanted - whole * F.col("source_size")
    last = F.least(F.greatest(rest - F.col("__before"), F.lit(0)), F.col("size"))
    placed = placed.withColumns({"__whole": whole, "taken": (whole * F.col("size") + last).cast("long")})
    due = F.when(F.col("taken") > 0, F.col("__before") / F.col("target"))
    copies = F.when(F.col("taken") > 0, F.col("__whole") + F.when(last > 0, 1).otherwise(0)).otherwise(0)
    turn = ((F.col("rank") - 1) % len(schedules) + 1).cast("int")
    start, end = (F.element_at(F.array(*[F.lit(float(s[k])) for s in schedules]), turn) for k in (0, 1))
    # the last copy is due at its target at the latest
    later = lambda k: F.least((k * F.col("source_size") + F.col("__before")) / F.col("target"), F.lit(1.0))
    placed = placed.withColumns({"__copies": copies.cast("int"), "__start": start, "__end": end})
    positions = F.transform(F.slice(F.sequence(F.lit(0), F.greatest("__copies", F.lit(1))), F.lit(1), F.col("__copies")), lambda k: _position(later(k), F.col("__start"), F.col("__end")))
    return placed.select(*[F.col(c).alias(n) for c, n in zip(kept, names, strict=True)], "size", "source_size", "target", "taken", _position(due, start, end).alias("position"), positions.alias("positions"))


def training_order(mix: DataFrame, id_col: str = "doc_id", position: str = "position") -> DataFrame:
    """A row for every time that a document of a mix is taken, range-sorted by position (ties: by id).

    ``position`` is that of the copy, ``copy`` counts from 0 and ``words`` are the words
    taken of it; they add up to ``taken``, which stays the document's.
    """
    rows = mix.where(F.col("taken") > 0).select("*", F.posexplode("positions").alias("copy", "__position")).withColumn(position, F.col("__position"))
    return rows.withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))).drop("__position", "positions").orderBy(position, id_col)
