"""All pairs of two surfaces, a tile of rows against a tile, judged where they are compared.

Rows are packed into tiles, which are written once; a task reads some tiles of one side and
some of the other (a Cartesian product of files, nothing is shuffled for it), finds what may be
flagged by sketches, equal texts, shared items and vectors, and judges it on whole sets.  No pair
leaves a task but one that is flagged, and no set does.  That is quadratic in comparisons; what is
written grows with the rows, and a task holds two tiles.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a row's sketches of tokens and of trigrams, bytes of a tile about, rows that sketches are compared of at a time, elements looked up and cells held at a time, and rows handed on.
BITS, TILE_BYTES, BLOCK, LOOKUPS, CELLS, HANDED = {"tokens": 512, "grams": 2048}, 32 << 20, 32, 1_000_000, 32_000_000, 200_000

#: Share of a sketch's bits that may differ at most for it to tell sets apart that are as unlike as most: texts share more trigrams than tokens.
TELLING = {"tokens": 0.4, "grams": 0.3}


def _sets(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of lists, their distinct values, and each value's place among those in as few bytes as hold it."""
    lists = column.combine_chunks()
    own, place = np.unique(pc.list_flatten(lists).to_numpy(zero_copy_only=False), return_inverse=True)
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), own, place.astype(np.min_scalar_type(max(1, len(own))))


def _sketch(n: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """For each bit of a row whether an odd number of the row's elements fall on it."""
    # multiplied, so that all of an element's bits have a say
    at = ((values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    out, ends = [], np.concatenate([[0], np.cumsum(n)])
    for i in range(0, len(n), 1024):
        rows = n[i : i + 1024]
        cells = np.repeat(np.arange(len(rows)) * bits, rows) + at[ends[i] : ends[i + len(rows)]]
        out.append(np.packbits((np.bincount(cells, minlength=len(rows) * bits) & 1).astype(np.uint8).reshape(len(rows), bits), axis=1))
    return np.concatenate(out)


def pack(rows: pa.Table) -> dict:
    """A tile of rows with what is compared of them."""
    tile: dict = {"key": rows.column("key").combine_chunks()}
    for side in ("left", "right"):
        ids = rows.column(f"{side}_ids").combine_chunks()
        tile[side] = (pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(ids))
    for column in ("tokens", "grams", "items"):
        n, own, place = _sets(rows.column(column))
        tile[column] = (n, own, place)
        if column in BITS:
            tile[f"{column}_sketch"] = _sketch(n, own[place], BITS[column])
    tile["items_n"] = rows.column("items_n").to_numpy().astype(np.int64)
    tile["norm"] = rows.column("norm").to_pylist()
    vectors = rows.column("vector").combine_chunks()
    if vectors.null_count < len(vectors):
        there = vectors.is_valid().to_numpy(zero_copy_only=False)
        cells = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).reshape(int(there.sum()), -1)
        tile["vector"] = np.zeros((len(vectors), cells.shape[1]))
        tile["vector"][there] = cells
    return tile


class Lists:
    """Lists one after the other."""

    def __init__(self, n: np.ndarray, values: np.ndarray):
        self.n, self.values = n, values
        self.starts = np.cumsum(n) - n

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each element of the lists of ``rows``: which of ``rows`` it is in, and its place in ``values``."""
        n = self.n[rows]
        return np.repeat(np.arange(len(rows)), n), np.repeat(self.starts[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())


class Tile:
    def __init__(self, number: int, data: bytes):
        tile = pickle.loads(data)
        self.number, self.key, self.norm, self.items_n, self.vector = number, tile["key"], tile["norm"], tile["items_n"], tile.get("vector")
        self.rows = len(self.norm)
        self.sets = {c: Lists(n, own[place]) for c in ("tokens", "grams", "items") for n, own, place in [tile[c]]}
        self.ids = {s: (Lists(tile[s][0], np.empty(0)), tile[s][1]) for s in ("left", "right")}
        self.whole = {c: np.ascontiguousarray(tile[f"{c}_sketch"]).view(np.uint64) for c in BITS}
        # halves of a sketch laid over each other are a sketch of half the bits
        self.words = {}
        for c, words in self.whole.items():
            while True:
                self.words[c, words.shape[1]] = np.ascontiguousarray(words.T)
                if words.shape[1] == 4:
                    break
                words = words[:, : words.shape[1] // 2] ^ words[:, words.shape[1] // 2 :]


def _close(x: Tile, y: Tile, i: slice, j: slice, column: str, t: float) -> np.ndarray:
    """Pairs (as ``p * columns + q``) whose sets may have a Jaccard similarity of ``t``.

    Two sets of n and m elements with a similarity of t differ in (1 - t) / (1 + t) (n + m)
    elements at most, and their sketches in no more bits.  Sketches of few bits, enough for the
    sizes, are compared for all, those of all bits for what is left.
    """
    n, m, share = x.sets[column].n[i], y.sets[column].n[j], (1 - t) / (1 + t)
    if n.max() < t * m.min() or m.max() < t * n.min() or not n.any() or not m.any():
        return np.empty(0, np.int64)
    width, all_words = 4, x.whole[column].shape[1]
    while width < all_words and share * (n.max() + m.max()) > TELLING[column] * 64 * width:
        width *= 2
    # sums of bits that differ are held in a byte where the bound fits into one
    kind = np.uint8 if width == 4 else np.uint16
    # the whole parts and 1 are no less than the sum's whole part; nothing differs in more than 64 bits a word
    more, less = ((np.minimum(np.floor(share * v), 64 * width) + k).astype(kind) for v, k in ((n, 1), (m, 0)))
    a, b = x.words[column, width][:, i], y.words[column, width][:, j]
    found, rows = [], len(n)
    apart, bits, total = np.empty((BLOCK, len(m)), np.uint64), np.empty((BLOCK, len(m)), np.uint8), np.empty((BLOCK, len(m)), kind)
    for at in range(0, rows, BLOCK):
        k = min(BLOCK, rows - at)
        s = total[:k]
        for w in range(width):
            np.bitwise_xor(a[w, at : at + k, None], b[w], out=apart[:k])
            np.bitwise_count(apart[:k], out=bits[:k])
            if w:
                np.add(s, bits[:k], out=s)
            else:
                s[:] = bits[:k]
        found.append(np.flatnonzero(s <= more[at : at + k, None] + less) + at * len(m))
    pairs, kept = np.concatenate(found), []
    for at in range(0, len(pairs), HANDED):
        some = pairs[at : at + HANDED]
        p, q = np.divmod(some, len(m))
        fit = (np.minimum(n[p], m[q]) >= t * np.maximum(n[p], m[q])) & (n[p] > 0)
        some, p, q = some[fit], p[fit], q[fit]
        differ = np.bitwise_count(x.whole[column][i][p] ^ y.whole[column][j][q]).sum(1, dtype=np.int64)
        kept.append(some[differ <= share * (n[p] + m[q]) + 1e-9])
    return np.concatenate(kept) if kept else np.empty(0, np.int64)


def _equal(a: np.ndarray, rows_a: np.ndarray, b: np.ndarray, rows_b: np.ndarray, columns: int) -> np.ndarray:
    """Pairs (as ``p * columns + q``) of rows with an equal value."""
    common, found = np.intersect1d(a, b), []
    if not len(common):
        return np.empty(0, np.int64)
    sides = []
    for values, rows in ((a, rows_a), (b, rows_b)):
        order = np.argsort(values, kind="stable")
        values, rows = values[order], rows[order]
        sides.append((rows, np.searchsorted(values, common), np.searchsorted(values, common, "right")))
    for k in range(len(common)):
        p, q = (rows[first[k] : last[k]] for rows, first, last in sides)
        found.append((p[:, None] * columns + q).ravel())
    return np.concatenate(found)


def _shared(x: Lists, y: Lists, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many elements the sets of ``p`` and of ``q`` share; ``p`` rises."""
    out = np.zeros(len(p), np.int64)
    size, rise = y.n[q], np.cumsum(y.n[q])
    at = 0
    while at < len(p):
        # some pairs at a time: so many lookups, and so many rows' elements
        end = max(at + 1, int(np.searchsorted(rise, rise[at] - size[at] + LOOKUPS, "right")))
        rows, of = np.unique(p[at:end], return_inverse=True)
        most = np.cumsum(x.n[rows])
        fit = max(1, int(np.searchsorted(np.arange(1, len(rows) + 1) * (most + 1), CELLS, "right")))
        if fit < len(rows):
            end = at + int(np.searchsorted(of, fit))
            rows, of = rows[:fit], of[: end - at]
        within, place = x.of(rows)
        values = x.values[place]
        own = np.unique(values)
        there = np.zeros((len(rows), len(own) + 1), bool)  # nothing is in the last column
        there[within, np.searchsorted(own, values)] = True
        asked, which = np.unique(q[at:end], return_inverse=True)
        inner, place = y.of(asked)
        values = y.values[place]
        column = np.searchsorted(own, values)
        column[(own[np.minimum(column, len(own) - 1)] != values) if len(own) else slice(None)] = len(own)
        pair, place = Lists(y.n[asked], column).of(which)
        hits = there[of[pair], column[place]]
        out[at:end] = np.bincount(pair[hits], minlength=end - at)
        at = end
    return out


def _rounded(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``part / whole`` to six digits, half up, from whole numbers; 0 over nothing."""
    whole = np.where(whole > 0, whole, 1) if len(whole) else whole
    return ((2_000_000 * part + whole) // (2 * whole)) / 1e6


def flagged(x: Tile, y: Tile, tile: int, limits: dict[str, tuple[float, float]]) -> Iterator[tuple[np.ndarray, ...]]:
    """``p, q, cosine, token_jaccard, trigram_jaccard, item_coverage, severity`` of what is flagged among the rows of two tiles, or of one, each pair once; severities from 0, worst first."""
    of = {n: i for i, n in enumerate(dict.fromkeys(v for v in [*x.norm, *y.norm] if v is not None))}
    texts = [np.array([-1 - k if v is None else of[v] for v in t.norm], np.int64) for k, t in enumerate((x, y))]
    alike = np.intersect1d(*texts)  # nulls are not equal to those of the other side
    (cos, cos2), (tok, tok2), (tri, tri2), (rel, rel2) = (limits[k] for k in ("cosine", "tokens", "grams", "items"))
    for a in range(0, x.rows, tile):
        for b in range(a if x is y else 0, y.rows, tile):
            i, j = slice(a, min(x.rows, a + tile)), slice(b, min(y.rows, b + tile))
            columns = j.stop - b
            # similarities are rounded to a millionth
            parts = [_close(x, y, i, j, c, limits[c][1] - 1e-6) for c in BITS]
            if len(alike):
                known = [np.flatnonzero(v[s] >= 0) for v, s in zip(texts, (i, j), strict=True)]
                parts.append(_equal(texts[0][i][known[0]], known[0], texts[1][j][known[1]], known[1], columns))
            items = [t.sets["items"].of(np.arange(s.start, s.stop)) for t, s in ((x, i), (y, j))]
            if len(items[0][0]) and len(items[1][0]):
                parts.append(_equal(x.sets["items"].values[items[0][1]], items[0][0], y.sets["items"].values[items[1][1]], items[1][0], columns))
            products = None
            if x.vector is not None and y.vector is not None:
                products = x.vector[i] @ y.vector[j].T
                parts.append(np.flatnonzero(products >= cos2 - 1e-6))
            pairs = np.unique(np.concatenate(parts))
            if x is y and a == b:
                pairs = pairs[pairs // columns <= pairs % columns]
            for at in range(0, len(pairs), HANDED):
                p, q = np.divmod(pairs[at : at + HANDED], columns)
                cosine = np.zeros(len(p))
                if products is not None:
                    cosine = np.round(products[p, q], 6) + 0.0
                    cosine[~(cosine >= cos2)] = 0.0
                p, q = p + a, q + b
                other, shared = (p != q) | (x is not y), {}
                for c in ("tokens", "grams", "items"):
                    shared[c] = x.sets[c].n[p]  # of a row with itself
                    shared[c][other] = _shared(x.sets[c], y.sets[c], p[other], q[other])
                jaccards = [_rounded(shared[c], x.sets[c].n[p] + y.sets[c].n[q] - shared[c]) for c in BITS]
                coverage = _rounded(shared["items"], np.minimum(x.items_n[p], y.items_n[q]))
                s = np.full(len(p), 3, np.int8)
                s[(cosine >= cos2) | (jaccards[0] >= tok2) | (jaccards[1] >= tri2) | (coverage >= rel2)] = 2
                s[(cosine >= cos) & ((jaccards[0] >= tok) | (jaccards[1] >= tri) | (coverage >= rel)) | (jaccards[0] >= tok) & (jaccards[1] >= tri)] = 1
                s[texts[0][p] == texts[1][q]] = 0
                k = s < 3
                if k.any():
                    yield p[k], q[k], cosine[k], jaccards[0][k], jaccards[1][k], coverage[k], s[k]


def _members(x: Tile, y: Tile, p: np.ndarray, q: np.ndarray, signals: list[np.ndarray], ends: tuple[str, str], own: bool) -> Iterator[pa.RecordBatch]:
    """A row for each member of ``p`` on one side and of ``q`` on the other, ``HANDED`` at a time about; with ``own`` each two members of a row once."""
    (a, a_ids), (b, b_ids) = x.ids[ends[0]], y.ids[ends[1]]
    n = a.n[p] * b.n[q]
    rise = np.cumsum(n)
    at = 0
    while at < len(p):
        end = max(at + 1, int(np.searchsorted(rise, rise[at] - n[at] + HANDED, "right")))
        pair, k = Lists(n[at:end], np.empty(0)).of(np.arange(end - at))
        width = b.n[q[at:end]][pair]
        first, second = k - (np.cumsum(n[at:end]) - n[at:end])[pair], width
        first, second = first // np.maximum(second, 1), first % np.maximum(second, 1)
        if own:
            kept = first < second
            pair, first, second = pair[kept], first[kept], second[kept]
        if len(pair):
            left, right = a.starts[p[at:end]][pair] + first, b.starts[q[at:end]][pair] + second
            if ends == ("right", "left"):
                columns = [b_ids.take(pa.array(right)), a_ids.take(pa.array(left))]
            else:
                columns = [a_ids.take(pa.array(left)), b_ids.take(pa.array(right))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(s[at:end][pair]) for s in signals]], names=["left_id", "right_id", "cosine", "token_jaccard", "trigram_jaccard", "item_coverage", "level"])
        at = end


def packed(entries: DataFrame, order: list, parts: int, rows: int) -> DataFrame:
    """Tiles of ``rows`` entries at most in an order in which sizes rise, written once.

    ``entries``: ``key``, ``left_ids, right_ids`` (of the rows that it stands for on either
    side), ``norm`` (a digest of the text), ``tokens, grams, items`` (sets of numbers),
    ``items_n`` and ``vector``.  A tile has the least and largest sizes of its sets.
    """

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, held, n
            table = pa.Table.from_batches(held)
            step = min(rows, max(1, int(TILE_BYTES * n / max(1, table.nbytes))))
            at = 0
            while n - at >= step or last and at < n:
                some = table.slice(at, step)
                tile = pack(some)
                sizes = [f(tile[c][0]) for c in BITS for f in (np.min, np.max)]
                values = [number, bool(tile["left"][0].any()), bool(tile["right"][0].any()), *map(int, sizes), pickle.dumps(tile, 5)]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["t", "l", "r", "tokens_from", "tokens_to", "grams_from", "grams_to", "data"])
                number, at = number + 1, at + step
            held, n = (table.slice(at).to_batches(), n - at) if at < n else ([], 0)

        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= rows or sum(h.nbytes for h in held) >= TILE_BYTES:
                yield from cut(False)
        if n:
            yield from cut(True)

    columns = ["key", "left_ids", "right_ids", "norm", "tokens", "grams", "items", "items_n", "vector"]
    ordered = entries.repartitionByRange(parts, *order).sortWithinPartitions(F.size("left_ids") == 0, F.size("grams"))
    return ordered.select(*columns).mapInArrow(tiles, "t long, l boolean, r boolean, tokens_from long, tokens_to long, grams_from long, grams_to long, data binary").checkpoint()


def compared(tiles: DataFrame, tile: int, limits: dict[str, tuple[float, float]], sized: bool, same: bool, kind: str) -> DataFrame:
    """Flagged pairs of members: ``left_id, right_id`` (of type ``kind``), signals, and ``level``, 0 for the worst; with ``same`` of one side, each once.  ``sized``: sets alone flag, and so need sizes alike."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in _pairs(batches):
            for p, q, *signals in flagged(x, y, tile, limits):
                self = (p == q) & (x is y)
                if same:
                    for k in (self, ~self):
                        yield from _members(x, y, p[k], q[k], [s[k] for s in signals], ("left", "left"), own=k is self)
                    continue
                yield from _members(x, y, p, q, signals, ("left", "right"), False)
                yield from _members(x, y, p[~self], q[~self], [s[~self] for s in signals], ("right", "left"), False)

    return _crossed(tiles, limits, sized).mapInArrow(meet, f"left_id {kind}, right_id {kind}, cosine double, token_jaccard double, trigram_jaccard double, item_coverage double, level byte")


def counted(tiles: DataFrame, tile: int, limits: dict[str, tuple[float, float]], sized: bool) -> DataFrame:
    """``key, exact, near, watch``: flagged pairs with each entry on the right, by severity; an entry may have several rows."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in _pairs(batches):
            sums = {id(t): np.zeros((t.rows, 3), np.int64) for t in (x, y)}
            for p, q, *_, s in flagged(x, y, tile, limits):
                np.add.at(sums[id(y)], (q, s), x.ids["left"][0].n[p] * y.ids["right"][0].n[q])
                turned = y.ids["left"][0].n[q] * x.ids["right"][0].n[p]
                turned[(p == q) & (x is y)] = 0
                np.add.at(sums[id(x)], (p, s), turned)
            for t in (x, y) if x is not y else (x,):
                rows = np.flatnonzero(sums[id(t)].any(1))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([t.key.take(pa.array(rows)), *[pa.array(sums[id(t)][rows, k]) for k in range(3)]], names=["key", "exact", "near", "watch"])

    return _crossed(tiles, limits, sized).mapInArrow(meet, "key binary, exact long, near long, watch long")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Tile, Tile]]:
    """The tiles of each row; the last one on the left is kept, since the next row mostly has it too."""
    x = None
    for batch in batches:
        for k in range(batch.num_rows):
            a, b = batch.column("x_t")[k].as_py(), batch.column("y_t")[k].as_py()
            if x is None or x.number != a:
                x = Tile(a, batch.column("x_data")[k].as_py())
            yield x, x if a == b else Tile(b, batch.column("y_data")[k].as_py())


def _crossed(tiles: DataFrame, limits: dict[str, tuple[float, float]], sized: bool) -> DataFrame:
    """Each two tiles once, and each with itself, where a row of one may be flagged with a row of the other."""
    x, y = (tiles.select(*[F.col(c).alias(f"{s}_{c}") for c in tiles.columns]) for s in "xy")
    cond = (F.col("x_t") <= F.col("y_t")) & (F.col("x_l") & F.col("y_r") | F.col("x_r") & F.col("y_l"))
    if sized:
        fits = [(F.col(f"x_{c}_to") >= (limits[c][1] - 1e-6) * F.col(f"y_{c}_from")) & (F.col(f"y_{c}_to") >= (limits[c][1] - 1e-6) * F.col(f"x_{c}_from")) for c in BITS]
        cond = cond & (fits[0] | fits[1])
    # a product of partitions that are read again, so that no tile goes to the driver or through a shuffle
    return x.join(y.hint("shuffle_replicate_nl"), cond).select("x_t", "y_t", "x_data", "y_data")
