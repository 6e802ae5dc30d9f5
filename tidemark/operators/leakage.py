"""Leakage between query surfaces: similarity joins, components and split assignment."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import jaccard, squeeze, token_set
from tidemark.functions.vectors import hash_fraction, item_coverage, subset_tag
from tidemark.operators import tiles
from tidemark.operators.ordering import ensure_checkpoint_dir

# Strong and watchlist thresholds of each signal.
COSINE, TOKEN, TRIGRAM, ITEMS = (0.96, 0.93), (0.75, 0.60), (0.72, 0.68), (0.50, 0.34)


def _trigram_codes(norm: Column) -> Column:
    """The trigrams of ``trigram_set`` as numbers, one for each three code points, from a text in lower case with single spaces."""

    @F.pandas_udf("array<long>")
    def codes(texts: pd.Series) -> pd.Series:
        def of(t: str | None) -> np.ndarray | None:
            if not t:
                return None if t is None else np.empty(0, np.int64)
            c = np.frombuffer(f"  {t}  ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])

        return pd.Series([of(t) for t in texts], dtype=object)

    return codes(norm)


def _prepared(rows: DataFrame, id_col: str, text_col: str, items: str | None, by_id: bool) -> DataFrame:
    """Sets of each row, and its class: rows of one class have equal texts and items, so that one stands for all."""
    t = F.col(text_col)
    kept = F.col(items) if items else F.lit(None).cast("array<string>")
    # 64-bit hashes of the elements: smaller to shuffle than strings, and faster to intersect
    hashed = lambda s: F.transform(s, lambda x: F.xxhash64(x))
    norm = squeeze(F.lower(t))
    out = rows.select(F.col(id_col).alias("id"), norm.alias("norm"), hashed(token_set(t)).alias("tokens"), _trigram_codes(norm).alias("grams"), F.coalesce(kept, F.array().cast("array<string>")).alias("items"))
    # vectors belong to ids, not to texts
    own = [F.col("id").cast("string").alias("i")] if by_id else []
    return out.withColumn("class", F.unhex(F.md5(F.to_json(F.struct("norm", F.array_sort("items").alias("items"), *own)).cast("binary"))))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes, a row each with the class as ``id``, and ``class, id`` of their members."""
    ensure_checkpoint_dir(rows.sparkSession)
    classes = rows.dropDuplicates(["class"]).select(F.col("class").alias("id"), "norm", "tokens", "grams", "items").checkpoint()
    return classes, rows.select("class", "id").distinct().checkpoint()


#: Words of 64 bits in the sketch of a set; the lowest bits of an element choose the word.
_SKETCH = 16


def _cells(rows: DataFrame, column: str, order: DataFrame, threshold: float) -> DataFrame:
    """The elements of each set's prefix, rarest first, with the set's size, each element's place, and a sketch of the set.

    Two sets with a Jaccard similarity of t share at least t |x| elements of either, so
    the first |x| - ceil(t |x|) + 1 in any common order hold a shared one; of the smaller
    the first |x| - ceil(2 t / (1 + t) |x|) + 1 do (``few``).  A sketch has for each of its
    bits whether an odd number of elements fall on it: as many bits differ at most as
    elements are in only one of two sets.
    """
    bit = lambda i: F.when(F.pmod("e", F.lit(_SKETCH)) == i, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright("e", 4), F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long"))
    cells = rows.select("id", F.size(column).alias("n"), F.explode(column).alias("e")).join(order, "e")
    of = Window.partitionBy("id")  # a set at a time
    place = F.row_number().over(of.orderBy("df", "e"))
    sketch = [F.bit_xor(bit(i)).over(of).alias(f"b{i}") for i in range(_SKETCH)]
    n = F.col("n")
    kept = cells.select("id", "n", "e", place.alias("place"), *sketch).where(F.col("place") <= n - F.ceil(threshold * n) + 1)
    band = F.floor(F.log(n) / -math.log(threshold) + 1e-9)
    return kept.select("id", "n", "e", "place", (F.col("place") <= n - F.ceil(2 * threshold / (1 + threshold) * n) + 1).alias("few"), band.alias("band"), *[f"b{i}" for i in range(_SKETCH)])


def _meet(larger: DataFrame, smaller: DataFrame, threshold: float, on: Column) -> DataFrame:
    """``a, b``: pairs of a set ``x`` and one ``y`` that is no larger, by the cells of either; ``on`` tells pairs of equal sizes apart.

    Prefixes meet on an element and a band of sizes: the smaller is in the same band or the
    next.  A pair leaves the join only if the elements behind the shared one are enough on
    both sides, and if no more bits of the sketches differ than elements may.
    """
    y = smaller.where("few").withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    n, m = F.col("x.n"), F.col("y.n")
    shared = F.ceil(threshold / (1 + threshold) * (n + m))  # as many elements at least
    differ = sum((F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in range(_SKETCH)), F.lit(0))
    # what is cheap to tell comes first
    cond = (F.col("x.e") == F.col("y.e")) & (F.col("x.band") == F.col("y.band")) & (m <= n) & on & (m >= threshold * n)
    cond = cond & (1 + F.least(n - F.col("x.place"), m - F.col("y.place")) >= shared) & (n + m - differ >= 2 * shared)
    return larger.alias("x").join(y.alias("y"), cond).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _candidates(left: DataFrame, right: DataFrame, column: str, threshold: float, same: bool) -> DataFrame:
    """Pairs that may reach ``threshold`` in ``column``; with ``same`` each pair of different classes once, the lesser left."""
    threshold -= 1e-6  # similarities are rounded to as much
    order = (left if same else left.select(column).unionAll(right.select(column))).select(F.explode(column).alias("e")).groupBy("e").agg(F.count("*").alias("df"))
    a = _cells(left, column, order, threshold)
    if same:
        pairs = _meet(a, a, threshold, (F.col("y.n") < F.col("x.n")) | (F.col("x.id") < F.col("y.id")))
        return pairs.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")).distinct()
    b = _cells(right, column, order, threshold)
    one = _meet(a, b, threshold, F.lit(True)).select(F.col("a").alias("left_id"), F.col("b").alias("right_id"))
    other = _meet(b, a, threshold, F.col("y.n") < F.col("x.n")).select(F.col("b").alias("left_id"), F.col("a").alias("right_id"))
    return one.unionByName(other).distinct()


#: Rows of a tile at most, rows compared at a time, tiles that even few rows are parted into, and members that a row of a tile stands for about.
_GROUP, _TILE, _GROUPS, _COPIES = 4096, 1024, 16, 500

_LIMITS = {"cosine": COSINE, "tokens": TOKEN, "grams": TRIGRAM, "items": ITEMS}


def _tiles(entries: DataFrame, rows: int, order: list[Column]) -> DataFrame:
    """``tiles.packed`` of at most ``rows`` entries, of which it depends how many tiles there are."""
    missing = {"norm": "binary", "items": "array<long>", "vector": "array<double>"}
    entries = entries.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in entries.columns})
    if "items_n" not in entries.columns:
        entries = entries.withColumn("items_n", F.lit(0))
    ensure_checkpoint_dir(entries.sparkSession)
    parts = min(256, max(1, -(-rows // (4 * _GROUP)), min(_GROUPS, -(-rows // _TILE))))
    return tiles.packed(entries, [F.size("left_ids") == 0, *order], parts, min(_GROUP, max(_TILE, -(-rows // _GROUPS))))


def _single(left: DataFrame, right: DataFrame, same: bool) -> DataFrame:
    """An entry for each row of either side."""
    sides = ((left, True, False),) if same else ((left, True, False), (right, False, True))
    of = lambda there, x: F.array("id") if there else F.array().cast(f"array<{dict(x.dtypes)['id']}>")
    parts = [x.withColumns({"key": F.lit(None).cast("binary"), "left_ids": of(a, x), "right_ids": of(b or same, x)}) for x, a, b in sides]
    return parts[0] if same else parts[0].unionByName(parts[1])


def _near(left: DataFrame, right: DataFrame, same: bool, sized: bool = True) -> DataFrame:
    """Flagged pairs of rows (``id``, sets and what else ``tiles.packed`` compares), every pair of which is compared; with ``same`` each once, the lesser left.

    For long texts over one alphabet, whose prefixes (``_candidates``) nearly all meet, and for
    vectors.  ``sized``: see ``tiles.compared``.
    """
    rows = left.count() + (0 if same else right.count())
    packed = _tiles(_single(left, right, same), rows, [F.size("grams"), F.col("id")])
    return _levels(tiles.compared(packed, _TILE, _LIMITS, sized, same, dict(left.dtypes)["id"]), same)


def _levels(pairs: DataFrame, same: bool) -> DataFrame:
    """Pairs of ``tiles.compared`` with the names of their severities."""
    names = F.array(*[F.lit(s) for s in ("exact_duplicate", "high_confidence_near_duplicate", "semantic_watchlist")])
    ends = [F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")] if same else ["left_id", "right_id"]
    return pairs.select(*ends, "cosine", "token_jaccard", "trigram_jaccard", "item_coverage", names[F.col("level").cast("int")].alias("severity"))


def _text_tiles(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_text: str, right_text: str) -> DataFrame:
    """Tiles of two surfaces' texts: rows of equal texts are an entry, on whichever side they are, so that texts of both sides are compared once.

    Texts are shuffled, their sets are worked out behind that.  An entry stands for some
    ``_COPIES`` members at most; those of a text with more are dealt to several.
    """
    sides = [x.select(F.lit(k).alias("side"), F.col(i).alias("id"), squeeze(F.lower(F.col(t))).alias("text")) for k, (x, i, t) in enumerate(((left, left_id, left_text), (right, right_id, right_text)))]
    rows = left.count() + right.count()
    both = sides[0].unionByName(sides[1]).where("text is not null and id is not null").withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    texts = both.select("key", "text").distinct()
    members = both.select("key", "side", "id").distinct()
    shares = members.groupBy("key").agg(F.ceil(F.count("*") / _COPIES).alias("shares"))
    of = lambda k: F.collect_list(F.when(F.col("side") == k, F.col("id")))
    dealt = members.join(shares, "key").groupBy("key", F.pmod(F.xxhash64("id"), "shares").alias("share")).agg(of(0).alias("left_ids"), of(1).alias("right_ids"))
    entries = dealt.join(texts, "key").withColumn("norm", F.col("key"))
    entries = entries.withColumns({"tokens": F.transform(token_set(F.col("text")), lambda x: F.xxhash64(x)), "grams": _trigram_codes(F.col("text"))})
    return _tiles(entries, rows, [F.length("text"), F.col("key"), F.col("share")])


def flagged_classes(left: DataFrame, right: DataFrame, left_id: str = "query_id", right_id: str = "query_id", left_text: str = "text", right_text: str = "text", items: str | None = None, cosines: DataFrame | None = None, same: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of classes with overlap signals, and ``class, id`` of the members on the left and on the right.

    Rows of equal texts and items are one class, compared once however many copies it
    has.  With ``same`` a pair of classes is there once, and a class meets itself.

    The reference semantics are a nested loop over all pairs; here candidates come from
    equi-joins that lose no pair that could be flagged: texts by prefixes of their token
    and trigram sets at the watchlist thresholds (``_candidates``), equal texts by hash, items by a shared
    item, and vectors from ``cosines`` (``left_id, right_id, cosine``), which a vector
    search supplies.  Every candidate is then judged on whole sets.
    """
    a, left_members = _split(_prepared(left, left_id, left_text, items, cosines is not None))
    b, right_members = (a, left_members) if same else _split(_prepared(right, right_id, right_text, items, cosines is not None))
    parts = [_candidates(a, b, "tokens", TOKEN[1], same), _candidates(a, b, "grams", TRIGRAM[1], same)]
    parts.append(a.select(F.col("id").alias("left_id"), F.md5(F.col("norm").cast("binary")).alias("h")).join(b.select(F.col("id").alias("right_id"), F.md5(F.col("norm").cast("binary")).alias("h")), "h").select("left_id", "right_id"))
    if items:
        parts.append(a.select(F.col("id").alias("left_id"), F.explode("items").alias("i")).join(b.select(F.col("id").alias("right_id"), F.explode("items").alias("i")), "i").select("left_id", "right_id"))
    if cosines is not None:
        of = [m.select(F.col("id").alias(f"{n}_id"), F.col("class").alias(f"{n}_class")) for m, n in ((left_members, "left"), (right_members, "right"))]
        cosines = cosines.join(of[0], "left_id").join(of[1], "right_id").select(F.col("left_class").alias("left_id"), F.col("right_class").alias("right_id"), "cosine")
        if same:
            cosines = cosines.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "cosine").groupBy("left_id", "right_id").agg(F.max("cosine").alias("cosine"))
        parts.append(cosines.where(F.col("cosine") >= COSINE[1]).select("left_id", "right_id"))
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    if same:
        pairs = pairs.where("left_id <= right_id")
    pairs = pairs.distinct()
    sides = [x.select(F.col("id").alias(f"{n}_id"), *[F.col(c).alias(f"{n}_{c}") for c in ("norm", "tokens", "grams", "items")]) for x, n in ((a, "left"), (b, "right"))]
    full = pairs.join(sides[0], "left_id").join(sides[1], "right_id")
    full = full.join(cosines.select("left_id", "right_id", "cosine"), ["left_id", "right_id"], "left") if cosines is not None else full.withColumn("cosine", F.lit(None).cast("double"))
    signals = F.struct(
        F.round(F.coalesce("cosine", F.lit(0.0)), 6).alias("cosine"), F.round(jaccard(F.col("left_tokens"), F.col("right_tokens")), 6).alias("token_jaccard"),
        F.round(jaccard(F.col("left_grams"), F.col("right_grams")), 6).alias("trigram_jaccard"), F.round(item_coverage(F.col("left_items"), F.col("right_items")), 6).alias("item_coverage"),
        (F.col("left_norm") == F.col("right_norm")).alias("exact"),
    )
    # generated, so that the filter below does not work the signals out again for each of its conditions
    judged = full.select(F.col("left_id").alias("left_class"), F.col("right_id").alias("right_class"), F.explode(F.array(signals)).alias("s")).withColumn("severity", severity(F.col("s")))
    judged = judged.where("severity is not null").select("left_class", "right_class", "s.cosine", "s.token_jaccard", "s.trigram_jaccard", "s.item_coverage", "severity")
    return judged, left_members, right_members


def flagged_pairs(left: DataFrame, right: DataFrame, left_id: str = "query_id", right_id: str = "query_id", left_text: str = "text", right_text: str = "text", items: str | None = None, cosines: DataFrame | None = None, same: bool = False, sketches: bool = False, vector: str | None = None) -> DataFrame:
    """Pairs across two surfaces (or, with ``same``, of one, each once) with overlap signals: ``flagged_classes`` by members.

    With ``sketches`` all pairs are compared, a tile of rows against a tile, and judged there
    (``tiles``), for texts whose prefixes nearly all meet, for results that are quadratic, and for
    cosines (dot products) of vectors, every pair of which counts that reaches the threshold.
    """
    if sketches and (items or vector or same):
        kept = F.coalesce(F.col(items), F.array().cast("array<string>")) if items else F.array().cast("array<string>")
        hashed = lambda s: F.transform(s, lambda x: F.xxhash64(x))

        def rows(x: DataFrame, id_col: str, text_col: str) -> DataFrame:
            norm = squeeze(F.lower(F.col(text_col)))
            return x.select(F.col(id_col).alias("id"), F.unhex(F.md5(norm.cast("binary"))).alias("norm"), hashed(token_set(F.col(text_col))).alias("tokens"), _trigram_codes(norm).alias("grams"), hashed(F.array_distinct(kept)).alias("items"), F.size(kept).alias("items_n"), (F.col(vector).cast("array<double>") if vector else F.lit(None).cast("array<double>")).alias("vector"))

        one = rows(left, left_id, left_text)
        return _near(one, one if same else rows(right, right_id, right_text), same, sized=not items and not vector)
    if sketches:
        packed = _text_tiles(left, right, left_id, right_id, left_text, right_text)
        return _levels(tiles.compared(packed, _TILE, _LIMITS, True, False, dict(left.dtypes)[left_id]), False)
    judged, left_members, right_members = flagged_classes(left, right, left_id, right_id, left_text, right_text, items, cosines, same)
    pairs = judged.join(left_members.select(F.col("class").alias("left_class"), F.col("id").alias("left_id")), "left_class").join(right_members.select(F.col("class").alias("right_class"), F.col("id").alias("right_id")), "right_class")
    if same:
        pairs = pairs.where("left_class <> right_class and left_id <> right_id or left_class = right_class and left_id < right_id").withColumns({"left_id": F.least("left_id", "right_id"), "right_id": F.greatest("left_id", "right_id")})
    return pairs.select("left_id", "right_id", "cosine", "token_jaccard", "trigram_jaccard", "item_coverage", "severity")


def severity(s: Column) -> Column:
    """Exact, near duplicate by several strong signals, watchlist by one moderate signal, or null."""
    strong_cos, strong_tok, strong_tri, strong_rel = (s[c] >= t[0] for c, t in (("cosine", COSINE), ("token_jaccard", TOKEN), ("trigram_jaccard", TRIGRAM), ("item_coverage", ITEMS)))
    watch = F.lit(False)
    for c, t in (("cosine", COSINE), ("token_jaccard", TOKEN), ("trigram_jaccard", TRIGRAM), ("item_coverage", ITEMS)):
        watch = watch | (s[c] >= t[1])
    near = (strong_cos & (strong_tok | strong_tri | strong_rel)) | (strong_tok & strong_tri)
    return F.when(s["exact"], "exact_duplicate").when(near, "high_confidence_near_duplicate").when(watch, "semantic_watchlist")


def leakage_risk(pairs: DataFrame) -> DataFrame:
    """One row: pairs of each severity, distinct queries on the watchlist, and the risk level."""
    of = lambda s: F.count_if(F.col("severity") == s)
    sums = pairs.agg(
        of("exact_duplicate").alias("exact"), of("high_confidence_near_duplicate").alias("near"), of("semantic_watchlist").alias("watch"),
        F.count_distinct(F.when(F.col("severity") == "semantic_watchlist", F.col("right_id"))).alias("watch_right"),
    )
    return sums.withColumn("risk_level", _risk_level())


def _risk_level() -> Column:
    return F.when((F.col("exact") > 0) | (F.col("near") >= 10), "high").when((F.col("near") > 0) | (F.col("watch_right") >= 20), "moderate").otherwise("low")


def text_risk(left: DataFrame, right: DataFrame, left_id: str = "query_id", right_id: str = "query_id", left_text: str = "text", right_text: str = "text") -> DataFrame:
    """A30 of ``flagged_pairs`` with ``sketches`` on two surfaces: the same row, counted where pairs are judged."""
    packed = _text_tiles(left, right, left_id, right_id, left_text, right_text)
    by_text = tiles.counted(packed, _TILE, _LIMITS, True).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("exact", "near", "watch")]).checkpoint()  # read twice
    sums = by_text.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("exact", "near", "watch")])
    ids = right.select(F.col(right_id).alias("id"), F.unhex(F.md5(squeeze(F.lower(F.col(right_text))).cast("binary"))).alias("key"))
    watched = ids.join(by_text.where("watch > 0").select("key"), "key").agg(F.count_distinct("id").alias("watch_right"))
    return sums.crossJoin(F.broadcast(watched)).withColumn("risk_level", _risk_level())  # one row


def class_links(judged: DataFrame, members: DataFrame) -> DataFrame:
    """``left_id, right_id``: links that join what exact and near pairs of ``flagged_classes`` (``same``) join, one a member and one a pair of classes."""
    judged = judged.checkpoint()  # read twice
    least = members.groupBy("class").agg(F.min("id").alias("least"))
    strong = judged.where((F.col("severity") != "semantic_watchlist") & (F.col("left_class") != F.col("right_class")))
    ends = [least.select(F.col("class").alias(f"{n}_class"), F.col("least").alias(f"{n}_id")) for n in ("left", "right")]
    # rows without a text are no copies of each other
    alike = judged.where("left_class = right_class and severity = 'exact_duplicate'").select(F.col("left_class").alias("class"))
    copies = members.join(alike, "class").join(least, "class").where("id <> least").select(F.col("least").alias("left_id"), F.col("id").alias("right_id"))
    return copies.unionByName(strong.join(ends[0], "left_class").join(ends[1], "right_class").select("left_id", "right_id"))


#: Counts of elements by hash, which order a set's elements, and words of a cell's sketch.
_COUNTS, _WORDS = 1 << 16, 4


def _prefixes(texts: DataFrame, threshold: float) -> DataFrame:
    """``h, n, band, words, few, prefix``: as in ``_cells``, the elements of each set's prefix, those that seem rarest first, and a sketch; ``texts``: ``h, tokens``.

    The order is by how often elements of an equal hash occur, a few counts that go along with
    the tasks, so that a set is put in order where it is; any order that all sets have in
    common loses no pair.
    """
    seen = texts.select(F.explode("tokens").alias("e")).groupBy(F.pmod("e", F.lit(_COUNTS)).cast("int").alias("c")).agg(F.count("*").alias("n")).toPandas()  # _COUNTS rows at most
    counts = np.zeros(_COUNTS, np.int64)
    counts[seen["c"].to_numpy(int)] = seen["n"].to_numpy(np.int64)
    sent = texts.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for tokens in batch.column("tokens"):
                e = np.asarray(tokens.values, np.int64)
                n = len(e)
                place = np.lexsort((e, sent.value[e % _COUNTS]))
                kept = e[place[: n - math.ceil(threshold * n) + 1]]
                at = ((e.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)
                words = np.packbits((np.bincount(at, minlength=64 * _WORDS) & 1).astype(np.uint8)).view(np.int64)
                for column, v in zip(out, (n, math.floor(math.log(n) / -math.log(threshold) + 1e-9), n - math.ceil(2 * threshold / (1 + threshold) * n) + 1, words, kept), strict=True):
                    column.append(v)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("h"), *[pa.array(c, pa.int32()) for c in out[:3]], *[pa.array(c, longs) for c in out[3:]]], names=["h", "n", "band", "few", "words", "prefix"])

    return texts.where(F.size("tokens") > 0).select("h", "tokens").mapInArrow(prefixes, "h long, n int, band int, few int, words array<long>, prefix array<long>")


def strong_links(rows: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """``left_id, right_id``: links that join what exact and near pairs of one surface's texts join: a text's copies with the least, and a near pair of texts by their least.

    A near pair has similar tokens, at the higher threshold, whatever its trigrams, so that
    prefixes of tokens find every one, and texts need not be compared by trigrams.  As in
    ``_meet``, with cells of a few numbers; candidates are judged on whole sets.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    named = rows.select(F.col(id_col).alias("id"), squeeze(F.lower(F.col(text_col))).alias("text")).where("text is not null and id is not null").withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    texts = named.groupBy("key").agg(F.min("id").alias("least"), F.first("text").alias("text")).select(F.xxhash64("key").alias("h"), "key", "least", "text").checkpoint()
    copies = named.select("key", "id").join(texts.select("key", "least"), "key").where("id <> least").select(F.col("least").alias("left_id"), F.col("id").alias("right_id"))
    sets = texts.withColumn("tokens", F.transform(token_set(F.col("text")), lambda x: F.xxhash64(x)))
    t = TOKEN[0] - 1e-6  # similarities are rounded to as much
    found = _prefixes(sets, t)
    words = [F.col("words")[i].alias(f"b{i}") for i in range(_WORDS)]
    larger = found.select("h", "n", "band", *words, F.posexplode("prefix").alias("place", "e")).alias("x")
    both = found.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    smaller = both.select("h", "n", "band", *words, F.posexplode(F.slice("prefix", F.lit(1), F.col("few"))).alias("place", "e")).alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    shared = F.ceil(t / (1 + t) * (n + m))
    differ = sum((F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in range(_WORDS)), F.lit(0))
    cond = (F.col("x.e") == F.col("y.e")) & (F.col("x.band") == F.col("y.band")) & (m <= n) & ((m < n) | (F.col("x.h") < F.col("y.h"))) & (m >= t * n)
    cond = cond & (F.least(n - F.col("x.place"), m - F.col("y.place")) >= shared) & (n + m - differ >= 2 * shared)
    pairs = larger.join(smaller, cond).select(F.col("x.h").alias("a"), F.col("y.h").alias("b")).distinct().checkpoint()
    met = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    whole = sets.join(met, "h").select("h", "least", "tokens", _trigram_codes(F.col("text")).alias("grams"))
    sides = [whole.select(F.col("h").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("least", "tokens", "grams")]) for k in "ab"]
    alike = lambda c, limit: F.round(jaccard(F.col(f"a_{c}"), F.col(f"b_{c}")), 6) >= limit[0]
    near = pairs.join(sides[0], "a").join(sides[1], "b").where(alike("tokens", TOKEN) & alike("grams", TRIGRAM))
    return copies.unionByName(near.select(F.col("a_least").alias("left_id"), F.col("b_least").alias("right_id")))


def surface_matrix(entries: DataFrame) -> DataFrame:
    """A row for each two surfaces (the lesser name left): pairs of each severity and the risk.

    ``entries``: ``surface, query_id, text``; a query may be on several surfaces.  Texts of all
    surfaces are compared once, as classes; pairs of surfaces are counted by the members of
    each class on either.  Surfaces without a flagged pair are there with zeros.
    """
    ids = entries.select("query_id", "text").distinct()
    judged, members, _ = flagged_classes(ids, ids, "query_id", "query_id", same=True)
    on = members.withColumnRenamed("id", "query_id").join(entries.select("surface", "query_id").distinct(), "query_id")
    n = on.groupBy("class", "surface").agg(F.count("*").alias("n"))
    # a pair of classes counts in both directions, a class with itself once
    turned = judged.select(F.col("right_class").alias("left_class"), F.col("left_class").alias("right_class"), "severity").where("left_class <> right_class")
    both = judged.select("left_class", "right_class", "severity").unionByName(turned)
    sides = [n.select(F.col("class").alias(f"{s}_class"), F.col("surface").alias(f"{s}_surface"), F.col("n").alias(f"{s}_n")) for s in ("left", "right")]
    met = both.join(sides[0], "left_class").join(sides[1], "right_class").where("left_surface < right_surface")
    of = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("left_n") * F.col("right_n"))), F.lit(0))
    counts = met.groupBy("left_surface", "right_surface").agg(of("exact_duplicate").alias("exact"), of("high_confidence_near_duplicate").alias("near"), of("semantic_watchlist").alias("watch"))
    # distinct queries on the right with one on the watchlist
    watched = met.where(F.col("severity") == "semantic_watchlist").select("left_surface", "right_surface", "right_class").distinct()
    own = on.select(F.col("class").alias("right_class"), F.col("surface").alias("right_surface"), "query_id")
    watch = watched.join(own, ["right_class", "right_surface"]).groupBy("left_surface", "right_surface").agg(F.count_distinct("query_id").alias("watch_right"))
    names = entries.select("surface").distinct()
    every = names.select(F.col("surface").alias("left_surface")).join(F.broadcast(names.select(F.col("surface").alias("right_surface"))), F.col("left_surface") < F.col("right_surface"))  # a row a surface
    out = every.join(counts, ["left_surface", "right_surface"], "left").join(watch, ["left_surface", "right_surface"], "left").na.fill(0)
    return out.withColumn("risk_level", _risk_level())


def matrix_risk(matrix: DataFrame, worst: int = 5) -> DataFrame:
    """One row: the worst level, pairs of surfaces at each, flagged pairs of each severity, and the ``worst`` pairs by name."""
    level = F.when(F.col("risk_level") == "high", 2).when(F.col("risk_level") == "moderate", 1).otherwise(0)
    flagged = F.col("exact") + F.col("near") + F.col("watch")
    pair = F.concat_ws("__", "left_surface", "right_surface")
    # a row for two surfaces: few
    order = F.struct((-level).alias("a"), (-F.col("exact")).alias("b"), (-F.col("near")).alias("c"), (-F.col("watch")).alias("d"), (-flagged).alias("e"), pair.alias("pair"))
    of = lambda n: F.count_if(F.col("risk_level") == n)
    sums = matrix.agg(
        F.count("*").alias("pairs"), of("high").alias("high"), of("moderate").alias("moderate"), of("low").alias("low"), F.coalesce(F.sum("exact"), F.lit(0)).alias("exact"), F.coalesce(F.sum("near"), F.lit(0)).alias("near"),
        F.coalesce(F.sum("watch"), F.lit(0)).alias("watch"), F.slice(F.array_sort(F.collect_list(order)), 1, worst).alias("__w"),
    )
    overall = F.when(F.col("high") > 0, "high").when(F.col("moderate") > 0, "moderate").otherwise("low")
    return sums.select("pairs", overall.alias("overall_risk_level"), "high", "moderate", "low", "exact", "near", "watch", F.array_join(F.transform("__w", lambda w: w["pair"]), ",").alias("worst_pairs"))


def worst_pairs(pairs: DataFrame, limit: int = 100) -> DataFrame:
    """K7: the pairs to look at first."""
    rank = F.when(F.col("severity") == "exact_duplicate", 0).when(F.col("severity") == "high_confidence_near_duplicate", 1).otherwise(2)
    return pairs.orderBy(rank, F.desc("cosine"), F.desc("token_jaccard"), F.desc("trigram_jaccard"), F.desc("item_coverage"), "left_id", "right_id").limit(limit)


#: Links of a node from which on it is a hub, and parts that the hub's links are dealt to at least.
HUB = 10_000


def _least(links: DataFrame, total: int) -> DataFrame:
    """``links`` (``u, v``) with ``m``, the least neighbour of ``u``.

    The links of a hub are dealt by salts, so that no task gets them all.  A hub has more
    than ``HUB`` links and more than one in 256 of all, so that there are 256 hubs at most.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    most = max(HUB, total // 256)
    hubs = F.broadcast(least.where(F.col("n") > most).select("u", F.ceil(F.col("n") * 64 / total).alias("salts")))
    dealt = links.join(hubs, "u", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("v"), "salts"), F.lit(0)))
    copies = least.join(hubs, "u", "left").select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("salts") - 1, F.lit(0)))).alias("salt"))
    return dealt.join(copies, ["u", "salt"]).select("u", "v", "m")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` (the least id that links reach) for each node; ``edges`` has ``left_id, right_id``.

    By star contraction: in turn, the neighbours above a node are linked with the least of
    its neighbourhood, and the neighbours below it, and itself, with the least of those.
    Links only ever come down, until all of a component hang on its least node; the rounds
    needed grow with the logarithm of a path.  Each round is checkpointed.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    links = edges.select(F.greatest("left_id", "right_id").alias("u"), F.least("left_id", "right_id").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    while (now := tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())) != before:
        before = now
        both = links.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.*")
        large = _least(both, 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct().checkpoint()
        small = _least(large, large.count()).select(F.explode(F.array(pair("v", "m"), pair("u", "m"))).alias("e")).select("e.*")
        links = small.where("u <> v").distinct().checkpoint()
    known = nodes.select("id").distinct()
    return known.join(links, F.col("id") == F.col("u"), "left").select("id", F.coalesce("v", "id").alias("component"))


def component_keys(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """M8: each component's members and an assignment key, a digest of their texts and ids in order.

    A component's lines pass through one task, in order, and are digested one by one; members
    without a text are counted only.
    """
    kind = dict(labels.dtypes)["component"]
    lines = labels.join(texts, "id").select("component", F.concat("norm", F.lit("\t"), F.col("id").cast("string")).alias("line"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha, n, first, done, of = None, None, 0, True, [], None

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], of), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done])], names=["component", "members", "key"])

        for batch in batches:
            of = batch.column("component").type
            for component, line in zip(batch.column("component").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if sha is None or component != last:
                    if sha is not None:
                        done.append((last, n, sha.hexdigest()))
                    last, sha, n, first = component, hashlib.sha256(), 0, True
                    if len(done) >= 10_000:
                        yield rows()
                        done = []
                n += 1
                if line is not None:
                    sha.update((b"" if first else b"\n") + line.encode("utf-8"))
                    first = False
        if sha is not None:
            done.append((last, n, sha.hexdigest()))
        if done:
            yield rows()

    keys = lines.repartition("component").sortWithinPartitions("component", "line").mapInArrow(digest, f"component {kind}, members long, key string")
    return keys.select("component", "members", F.concat(F.lit("qpc_"), F.substring("key", 1, 16)).alias("component_id"), F.col("key").alias("assignment_key"))


def split_assignment(rows: DataFrame, key: Column) -> DataFrame:
    """M4, M5: ``fraction`` and ``subset`` of each row, from a hash of its key."""
    return rows.withColumn("fraction", F.round(hash_fraction(key), 12)).withColumn("subset", subset_tag(hash_fraction(key)))
