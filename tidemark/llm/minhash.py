"""Near-duplicate detection: MinHash with tensored banding, verified on full sets.

Method
------
A text's set holds the hashes of its distinct word shingles.  Plain banding with
``L`` tables of ``K`` minima each computes ``L * K`` minima a text.  Here two small
collections of ``t`` tuples of ``k`` minima are computed, and the key of table
``(i, j)`` joins tuple ``i`` of the first with tuple ``j`` of the second: ``t * t``
tables of ``2 k`` minima from ``2 t k`` of them, about the square root.

Two sets of similarity ``s`` miss every table with a probability of at most
``2 (1 - s^k)^t``; ``t`` is chosen so that this is under ``miss`` at the threshold.

Candidates are confirmed on full sets, in two passes, neither of which emits the pairs
of a group:

1. each text is compared with the least id of each of its buckets;
2. of groups whose texts are still in more than one component, those outside the group's
   largest component are looked up among all of it, block by block inside Python workers,
   on full sets, by an inverted index.  A link leaves the worker only if it joins two
   components that no earlier link of the block joins, so that a block of n texts gives at
   most n - 1 links.  A large group of near copies, nearly all in one component, is read
   once; the number of blocks grows with the texts outside of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.hashing import U64, mix64, shingle_set
from tidemark.llm.storage import by_keys, materialize, scratch

TUPLE = 4
#: Texts, and hashes of shingles (8 bytes each), of one block of the second pass at most, but for a text that has more by itself.
BLOCK = 1024
BLOCK_HASHES = 250_000
CHUNK = 8192
GATHER = 1 << 20


def tuples_needed(percent: int, miss: float = 5e-5, k: int = TUPLE) -> int:
    """Tuples in each collection, so that a pair at the threshold is missed with probability ``miss``."""
    return max(2, math.ceil(math.log(miss / 2) / math.log(1 - (percent / 100) ** k)))


def minhash_tuples(shingles: np.ndarray, t: int, k: int = TUPLE) -> np.ndarray:
    """``2 t`` hashes: the tuples of the first collection, then those of the second."""
    seeds = np.arange(1, 2 * t * k + 1, dtype=np.uint64)
    add, times = mix64(seeds * U64(0x9E3779B97F4A7C15)), mix64(seeds * U64(0xD1B54A32D192ED03)) | U64(1)
    least = np.full(2 * t * k, U64(0xFFFFFFFFFFFFFFFF))
    step = max(1, CHUNK * 64 // len(add))
    for at in range(0, len(shingles), step):
        np.minimum(least, ((shingles[at : at + step, None] ^ add) * times).min(axis=0), out=least)
    out = np.zeros(2 * t, np.uint64)
    for column in least.reshape(2 * t, k).T:
        out = mix64(out * U64(31) + column)
    return out


def _signatures(size: int, t: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingle_set(text, size)
                sig = minhash_tuples(s, t).astype(np.int64) if len(s) else np.empty(0, np.int64)
                rows.append((len(s), xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None, sig[:t], sig[t:]))
            yield pd.DataFrame({"id": batch["id"]}).assign(**{c: [r[i] for r in rows] for i, c in enumerate(("n", "digest", "first", "second"))})

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "shingles": [shingle_set(t, size).astype(np.int64) for t in batch["text"]]})

    return run


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def links_within(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between texts of different components: a spanning set of those there are, each confirmed on full sets.

    Overlaps come from an inverted index over the sets, in pieces of bounded size.
    ``left`` marks the rows that are looked up among the others; without it, all rows but
    those of the largest component are looked up among all, which sees every pair.
    """
    sizes = np.array([len(s) for s in sets])
    if left is None:
        left, inside = comps != pd.Series(comps).value_counts().index[0], np.ones(len(ids), bool)
    else:
        inside = ~left
    tokens = np.concatenate([s for s, i in zip(sets, inside, strict=True) if i] or [np.empty(0, np.int64)])
    owner = np.repeat(np.flatnonzero(inside).astype(np.int32), sizes[inside])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    parent = list(range(len(ids)))
    by_comp: dict[int, int] = {}
    for i, c in enumerate(comps):
        parent[i] = by_comp.setdefault(c, i)
    found = []
    for x in np.flatnonzero(left):
        begin, end = np.searchsorted(tokens, sets[x], "left"), np.searchsorted(tokens, sets[x], "right")
        overlap = np.zeros(len(ids), np.int64)
        at = 0
        lengths = end - begin
        ends = np.cumsum(lengths)
        while at < len(begin):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GATHER, "right")))
            n = lengths[at:to]
            idx = np.arange(int(n.sum())) + np.repeat(begin[at:to] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            overlap += np.bincount(owner[idx], minlength=len(ids))
            at = to
        near = inside & (100 * overlap >= percent * (sizes + sizes[x] - overlap)) & (overlap > 0)
        for y in np.flatnonzero(near & (comps != comps[x])):
            a, b = _find(parent, int(x)), _find(parent, int(y))
            if a != b:
                parent[a] = b
                found.append((int(ids[x]), int(ids[y])))
    return found


def _block_links(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, comps, asked, sets in zip(batch["ids"], batch["comps"], batch["asked"], batch["sets"], strict=True):
                arrays = [np.asarray(s, np.int64) for s in sets]
                pairs = links_within(np.asarray(ids), np.asarray(comps), arrays, percent, np.asarray(asked, bool))
                if pairs:
                    yield pd.DataFrame(pairs, columns=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``a, b``, those whose full sets are at least ``percent`` % similar."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(one, "a").join(two, "b")
    both = joined.withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return both.where(F.expr(f"100 * common >= {percent} * (size(sa) + size(sb) - common)")).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, miss: float = 5e-5) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id, kept``.

    Texts are linked when ``100 * |A and B| >= percent * |A or B|`` over their sets of
    ``shingle_words``-word shingles; a component is what links reach.  ``component_id``
    is its smallest id and ``kept`` marks the row with that id.

    Null and empty texts, and texts of white space, have an empty set and are linked
    with nothing.  Rows that repeat an id are one document if their texts are equal;
    each such row is returned.  If the texts under one id differ, every one of them
    belongs to that id's component.  A row with a null id is in no component: its
    ``component_id`` is null and ``kept`` true.  Other columns are ignored.  An empty
    table gives an empty result.  Ids are integers.
    """
    t = tuples_needed(percent, miss)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(rows.mapInPandas(_signatures(shingle_words, t), "id long, n long, digest string, first array<long>, second array<long>"), "signatures")
    with scratch(docs.sparkSession):
        final = _components(rows, signed, shingle_words, percent)
    out = signed.select("id", "n").join(final, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))


def _components(rows: DataFrame, signed: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """``id, component_id`` of the texts that are linked with another."""
    # equal sets are one candidate, and linked
    full = signed.where("id is not null and digest is not null")
    least = full.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    same = full.select("id", "digest").join(least.where("copies > 1").select("digest", "rep"), "digest").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # copies of one text carry equal tuples, so any one of them speaks for all
    reps = full.join(least.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])

    # tuples that two sets or more share; only their products can be shared table keys
    sides = reps.select("id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("first").alias("h")), F.struct(F.lit(1).alias("side"), F.col("second").alias("h")))).alias("s"))
    cells = sides.select("id", "s.side", F.posexplode("s.h").alias("at", "h"))
    shared = cells.groupBy("side", "at", "h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("side", "at", "h")
    live = cells.join(shared, ["side", "at", "h"], "left_semi").groupBy("id").agg(
        F.collect_list(F.when(F.col("side") == 0, F.struct("at", "h"))).alias("first"), F.collect_list(F.when(F.col("side") == 1, F.struct("at", "h"))).alias("second")
    )
    live = materialize(live.where("size(first) > 0 and size(second) > 0"), "live")
    keys = live.select("id", F.explode("first").alias("x"), "second").select("id", "x", F.explode("second").alias("y")).select("id", F.xxhash64("x.at", "y.at", "x.h", "y.h").alias("key"))
    buckets = materialize(keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key", "lo"), "buckets")
    members = materialize(keys.join(buckets, "key"), "members")

    # first pass: every member against the least of its bucket
    stars = materialize(members.where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    wanted = materialize(stars.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    by_rep = by_keys(rows, wanted, "id", "left_semi").dropDuplicates(["id", "text"])
    sets = materialize(by_rep.mapInPandas(_sets(shingle_words), "id long, shingles array<long>"), "sets")
    first = materialize(_confirmed(stars, sets, percent).unionByName(same).distinct(), "links")
    comps = materialize(connected_components(first), "first-components")

    # second pass: buckets that still hold more than one component
    placed = members.select("key", "id").join(comps, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    loose = materialize(placed.join(mixed, "key", "left_semi").select("id", "comp").distinct(), "loose")
    # pairs of one bucket share a tuple of the first collection: compare by those, fewer, groups, but by buckets where many texts of such a group are to be looked up
    sized = sets.groupBy("id").agg(F.sum(F.size("shingles")).alias("n"))
    near = live.join(loose, "id").join(sized, "id")
    tuples = near.select("id", "comp", "n", "second", F.explode("first").alias("x")).withColumn("cell", F.xxhash64("x.at", "x.h"))
    cells = materialize(_groups(tuples.select("id", "comp", "n", "cell").distinct()), "cells")
    large = cells.where("asked_blocks > 1").select("cell").distinct()
    finer = tuples.join(large, "cell", "left_semi").select("id", "comp", "n", "x", F.explode("second").alias("y")).select("id", "comp", "n", F.xxhash64("x.at", "y.at", "x.h", "y.h").alias("cell")).distinct()
    placed = cells.where("asked_blocks = 1").unionByName(_groups(finer))
    # of groups with the same members one is enough
    one = placed.groupBy("cell").agg(F.bit_xor(F.xxhash64("id")).alias("xor"), F.sum(F.xxhash64("id", F.lit(1)) % 1_000_003).alias("sum"), F.count("*").alias("size")).groupBy("xor", "sum", "size").agg(F.min("cell").alias("cell"))
    placed = placed.join(one.select("cell"), "cell", "left_semi")
    # every block of texts to look up meets every block of the group
    asked = placed.where("asked").select("id", "comp", "cell", F.lit(True).alias("asked"), _block("asked_blocks").alias("lo"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("hi"))
    among = placed.select("id", "comp", "cell", F.lit(False).alias("asked"), F.explode(F.expr("sequence(0, asked_blocks - 1)")).alias("lo"), _block("blocks").alias("hi"))
    grouped = asked.unionByName(among).join(sets, "id").groupBy("cell", "lo", "hi").agg(F.collect_list(F.struct("id", "comp", "asked", "shingles")).alias("m"))
    grouped = grouped.select(F.col("m.id").alias("ids"), F.col("m.comp").alias("comps"), F.col("m.asked").alias("asked"), F.col("m.shingles").alias("sets"))
    late = grouped.mapInPandas(_block_links(percent), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = materialize(late, "late-links")

    # late links join components; a text that is in none yet is one of its own
    of = [comps.select(F.col("id").alias(c), F.col("component_id").alias(f"{c}_comp")) for c in ("a", "b")]
    ends = second.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    joined = materialize(connected_components(ends).withColumnRenamed("component_id", "root"), "joined-components")
    moved = comps.join(joined.withColumnRenamed("id", "component_id"), "component_id", "left").select("id", F.coalesce("root", "component_id").alias("component_id"))
    new = joined.join(comps.select("id"), "id", "left_anti").select("id", F.col("root").alias("component_id"))
    return materialize(moved.unionByName(new), "final-components", keep=True)


def _block(blocks: str) -> F.Column:
    return F.pmod(F.xxhash64("id", F.lit(blocks)), F.col(blocks)).cast("int")


def _groups(members: DataFrame) -> DataFrame:
    """``members`` (``id, comp, n, cell``, distinct) of cells with several components.

    ``asked`` marks those outside the cell's largest component, ``blocks`` and
    ``asked_blocks`` say into how many blocks all and those are dealt.
    """
    parts = members.groupBy("cell", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("hashes"))
    totals = parts.groupBy("cell").agg(F.max(F.struct("size", "comp", "hashes")).alias("top"), F.sum("size").alias("size"), F.sum("hashes").alias("hashes"), F.count("*").alias("comps")).where("comps > 1")
    dealt = lambda size, hashes: F.greatest(F.ceil(size / BLOCK), F.ceil(hashes / BLOCK_HASHES), F.lit(1)).cast("int")
    totals = totals.select("cell", F.col("top.comp").alias("top"), dealt(F.col("size"), F.col("hashes")).alias("blocks"), dealt(F.col("size") - F.col("top.size"), F.col("hashes") - F.col("top.hashes")).alias("asked_blocks"))
    return members.join(totals, "cell").select("id", "comp", "cell", (F.col("comp") != F.col("top")).alias("asked"), "blocks", "asked_blocks")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near duplicates.

    The row with the group's smallest id stays; of rows that repeat an id, one.
    Rows without an id, a text or a word stay.
    """
    with scratch(docs.sparkSession):
        found = near_duplicates(docs, id_col, text_col, shingle_words, percent)
        gone = materialize(found.where("not kept").select(F.col(id_col)).distinct(), "gone", keep=True)
    left = by_keys(docs, gone, id_col, "left_anti")
    known = left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    return known.unionByName(left.where(F.col(id_col).isNull()))
