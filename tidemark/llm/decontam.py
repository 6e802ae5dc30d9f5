"""Benchmark decontamination by template canonicalisation.

Text becomes a sequence of canonical tokens: words in lower case, with numbers, names
and units replaced by typed placeholders whose values are kept aside as slots.  Windows
of tokens of benchmark items and documents are hash-joined; of an item's windows found
in a document at one alignment, the slots must be filled consistently (equal names and
units of the item by equal ones of the document), which tells a question with new
parameters from a chance likeness.  Numbers that are equal in an item may be so by chance
and need not stay equal.  Windows of placeholders mostly are joined with their values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.hashing import U64, mix64, pieces, window_multipliers
from tidemark.llm.storage import by_keys, materialize, scratch, spare

WINDOW = 8
#: Bits of the largest filter of the benchmark's windows: 128 MB, sent along with the tasks.
FILTER_BITS = 1 << 30
#: Bits of the filter that one task sets.
SEGMENT_BITS = 1 << 22
#: Characters of a text that are read at a time, or more where they have no white space.
CHUNK = 1 << 19

# Words read as numbers, and as units after a number.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half"
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces oz pound pounds lb lbs "
    "ml l litre litres liter liters gallon gallons pint pints cup cups ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh kph percent degree degrees "
    "celsius fahrenheit dollar dollars cent cents euro euros usd eur gbp w kw watt watts v volt volts amp amps hz khz mhz ghz kb mb gb tb byte bytes bit bits"
)
# Words that are no names, even where a capital stands within a sentence.
NEVER_NAMES = (
    "a an the and or but nor so if then than as of in on at by to for from with about into over under after before during between through is are was were be been am do does did has have had can could will would "
    "shall should may might must not no he she it they we you i his her its their our your my him them us me this that these those there here what which who whom whose when where why how each every all some any "
    "both one once let find calculate suppose given assume consider ask write solve show explain compute while because since until although"
)
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: Line break and marks after which a sentence begins.
ENDS = (10, 33, 46, 58, 63, 0x3002, 0xBF, 0xA1)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in a short sorted array."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Canonical:
    """Tables for reading text as canonical tokens; one for each process."""

    #: Codes above the first 65,536, up to the end of the last plane with letters; what lies beyond is no letter.
    FIRST, ALL = 0x10000, 0x40000

    def __init__(self) -> None:
        self.kind, self.lower, self.upper = np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, bool)
        self._read(self.FIRST)
        self.power = np.cumprod(np.full(1 << 12, U64(0x9E3779B97F4A7C15)))
        self.numbers, self.units, self.plain = self._hashes(NUMBERS), self._hashes(UNITS), self._hashes(NEVER_NAMES)
        # by their last 16 bits, the words that may be in one of the lists
        self.listed = np.zeros(1 << 16, bool)
        for known in (self.numbers, self.units, self.plain):
            self.listed[(known & U64(0xFFFF)).astype(np.int64)] = True
        self.slots = mix64(np.arange(1, 5, dtype=np.uint64) * U64(0xA24BAED4963EE407))

    def _read(self, until: int) -> None:
        """Kind and case of the characters up to a code; those above ``FIRST`` are looked up when a text has one."""
        at = len(self.kind)
        chars = [chr(i) for i in range(at, until)]
        self.kind = np.append(self.kind, np.array([2 if c.isdigit() else 1 if c.isalpha() else 0 for c in chars], np.uint8))
        self.lower = np.append(self.lower, np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars, at)], np.int64))
        self.upper = np.append(self.upper, np.array([c.isupper() for c in chars]))
        self.code = mix64(np.arange(until, dtype=np.uint64) + U64(0x51ED27)) | U64(1)
        self.end = np.zeros(until, bool)
        self.end[list(ENDS)] = True

    def _hashes(self, words: str) -> np.ndarray:
        return np.sort(np.array([self._raw(w)[0][0] for w in words.split()], np.uint64))

    def _raw(self, text: str, fresh: bool = True) -> tuple:
        """Of each run of letters or digits its hash, class (1 letters, 2 digits), case and whether it opens a sentence.

        ``fresh`` says whether a run at the beginning would; last comes whether one after the end would.
        """
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(codes) and codes.max() >= len(self.kind):
            self._read(self.ALL)
            codes = np.minimum(codes, self.ALL - 1)
        kind = self.kind[codes]
        # points and commas between digits belong to the number
        inner = np.flatnonzero(((codes == 46) | (codes == 44)))
        inner = inner[(inner > 0) & (inner < len(codes) - 1)]
        inner = inner[(kind[inner - 1] == 2) & (kind[inner + 1] == 2)]
        kind[inner] = 2
        change = np.flatnonzero(np.diff(kind, prepend=255))
        first = change[kind[change] > 0]
        if not len(first):
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool), fresh or bool(self.end[codes].any())
        bounds = np.append(change, len(codes))
        last = bounds[np.searchsorted(bounds, first, "right")]
        length = last - first
        if length.max() > len(self.power):
            self.power = np.cumprod(np.full(int(length.max()), self.power[0]))
        place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        at = place + np.repeat(first, length)
        values = self.code[self.lower[codes[at]]] * self.power[place]
        h = mix64(np.add.reduceat(values, np.cumsum(length) - length) + length.astype(np.uint64))
        second = np.minimum(first + 1, len(codes) - 1)
        title = self.upper[codes[first]] & (length > 1) & ~self.upper[codes[second]]
        ends = np.cumsum(self.end[codes])
        opens = np.empty(len(first), bool)
        opens[0] = fresh or ends[first[0]] > 0
        opens[1:] = ends[first[1:]] > ends[last[:-1] - 1]
        return h, kind[first].astype(np.int64), title, opens, bool(ends[-1] > ends[last[-1] - 1])

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Canonical hash, kind and value of each token of the whole text.

        Long texts are read in pieces, with the same result as in one.
        """
        empty = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
        if not text:
            return empty
        parts, fresh = [], True
        for piece in pieces(text, CHUNK):
            *part, fresh = self._raw(piece, fresh)
            parts.append(part)
        h, cls, title, opens = (np.concatenate([p[k] for p in parts]) for k in range(4))
        if not len(h):
            return empty
        few = np.flatnonzero(self.listed[(h & U64(0xFFFF)).astype(np.int64)])

        def among(known: np.ndarray) -> np.ndarray:
            out = np.zeros(len(h), bool)
            out[few] = _among(h[few], known)
            return out

        kind = np.full(len(h), WORD)
        kind[(cls == 2) | among(self.numbers)] = NUMBER
        kind[(cls == 1) & title & ~opens & (kind == WORD) & ~among(self.plain)] = NAME
        after = np.zeros(len(h), bool)
        after[1:] = kind[:-1] == NUMBER
        kind[after & among(self.units)] = UNIT
        # a run of names is one
        goes_on = np.zeros(len(h), bool)
        goes_on[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME)
        begin = np.flatnonzero(~goes_on)
        value = np.add.reduceat(h * (U64(1) + np.where(goes_on, U64(2), U64(0))), begin)
        kind = kind[begin]
        canonical = np.where(kind == WORD, h[begin], self.slots[kind])
        return canonical, kind, value

    def windows(self, text: str | None, size: int, least_words: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]:
        """Hash and place of each window, the number of those with ``least_words`` words or more, and the tokens' kinds and values.

        Windows with fewer words are hashed with their values: they match their own copies only.
        """
        canonical, kind, value = self.tokens(text)
        n = len(canonical) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64), 0, kind, value
        h = np.full(n, U64(size))
        for k, m in enumerate(window_multipliers(size)):
            h += canonical[k : k + n] * m
        words = np.concatenate(([0], np.cumsum(kind == WORD)))
        few = np.flatnonzero(words[size:] - words[:-size] < least_words)
        if len(few):
            exact = np.full(len(few), U64(size + (1 << 32)))
            for k, m in enumerate(window_multipliers(size)):
                exact += (value[few + k] + canonical[few + k]) * m
            h[few] = exact
        return mix64(h), np.arange(n), n - len(few), kind, value


def _filter(windows: DataFrame) -> np.ndarray:
    """A Bloom filter, two bits a hash, of the distinct ``window`` values; 64 bits of room for each while the largest size allows it.

    Its segments are made by tasks, each of the bits that fall on it; the driver only puts
    them side by side, at most ``FILTER_BITS`` in all.
    """
    n = windows.count()
    room = 1 << min(FILTER_BITS.bit_length() - 1, max(20, (64 * n - 1).bit_length()))
    size = min(room, SEGMENT_BITS)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h = batch["window"].to_numpy(np.int64).astype(np.uint64)
            at = np.concatenate([h, mix64(h)]) & U64(room - 1)
            yield pd.DataFrame({"segment": (at // U64(size)).astype(np.int32), "bit": (at % U64(size)).astype(np.int32)})

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(size, bool)
        bits[rows["bit"]] = True
        return pd.DataFrame({"segment": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    made = windows.mapInPandas(places, "segment int, bit int").distinct().groupBy("segment").applyInPandas(fill, "segment int, bits binary").collect()
    bits = np.zeros(room // 8, np.uint8)
    for r in made:
        bits[r["segment"] * size // 8 : (r["segment"] + 1) * size // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def _may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold."""
    out = np.ones(len(h), bool)
    for x in (h, mix64(h)):
        at = (x & U64(8 * len(bits) - 1)).astype(np.int64)
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return out


ROWS = "id long, key binary, window long, place long, slots array<long>, kinds array<int>, at array<int>, templates long, windows long, size int, template boolean"


def _window_rows(size: int, sizes: list[int], known, items: bool):
    """Windows as rows: all of an item's, of its own length if that is shorter; a document's, if the filter may hold them.

    ``key`` is the text's digest, 128 bits: copies of a text have the same windows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Canonical()
        bits = None if known is None else known.value
        for batch in batches:
            rows = []
            for id_, text in zip(batch["id"], batch["text"], strict=True):
                key = hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
                use = sizes
                if items:
                    n = len(reader.tokens(text)[0])
                    use = [min(size, n)] if n else []
                for s in use:
                    h, place, templates, kind, value = reader.windows(text, s, (s + 1) // 2)
                    total = len(h)
                    if bits is not None and len(h):
                        maybe = _may_hold(bits, h)
                        h, place = h[maybe], place[maybe]
                    for w, p in zip(h.astype(np.int64), place, strict=True):
                        at = np.flatnonzero(kind[p : p + s] != WORD) + p
                        rows.append((id_, key, w, p, value[at].astype(np.int64), kind[at].astype(np.int32), at.astype(np.int32), templates, total, s, s - len(at) >= (s + 1) // 2))
            if rows:
                yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in ROWS.split(", ")])

    return run


def _of_texts(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, coverage: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of texts, ``text_key`` and ``key`` of an item's, with what was found; ids and keys of items; ids and keys of documents that share a window."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null and text <> ''")
    every_item = materialize(items.mapInPandas(_window_rows(window, [window], None, True), ROWS), "items")
    # items and documents are known by their texts until the end, so that copies are judged once
    named = every_item.select(F.col("id").alias(item_col), "key").distinct()
    item_rows = every_item.drop("id").dropDuplicates(["key", "place"])
    sizes = sorted(r[0] for r in item_rows.select("size").distinct().collect()) or [window]
    known = docs.sparkSession.sparkContext.broadcast(_filter(item_rows.select("window").distinct()))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null and text <> ''")
    every = materialize(rows.mapInPandas(_window_rows(window, sizes, known, False), ROWS).select("id", "key", "window", "place", "slots"), "windows")
    known.unpersist()
    holders = every.select("id", "key").distinct()
    found = materialize(every.drop("id").dropDuplicates(["key", "window", "place"]), "text-windows")

    # of an item's windows, all but the commonest, of which there are too few to be a pair
    common = found.groupBy("window").agg(F.count("*").alias("n"))
    of_item = Window.partitionBy("key").orderBy(F.coalesce("n", F.lit(0)).desc(), "place")
    needed = F.greatest(F.ceil(F.lit(coverage) * F.when(F.col("templates") > 0, F.col("templates")).otherwise(F.col("windows")) - 1e-9), F.lit(1))
    rare = item_rows.join(common, "window", "left").withColumn("r", F.row_number().over(of_item)).where(F.col("r") >= needed)
    meet = found.select(F.col("key").alias("text_key"), "window").join(rare.select("key", "window"), "window").select("text_key", "key").distinct()
    wanted = meet.join(item_rows, "key").select("text_key", "key", "window", F.col("place").alias("i_place"), F.col("slots").alias("i_slots"), "kinds", "at", "templates", "windows", "template")
    left = found.select(F.col("key").alias("text_key"), "window", F.col("place").alias("d_place"), F.col("slots").alias("d_slots"))
    pairs = wanted.join(left, ["text_key", "window"]).where(F.size("d_slots") == F.size("i_slots")).withColumn("shift", F.col("d_place") - F.col("i_place"))

    fills = F.transform(F.arrays_zip("i_slots", "d_slots", "at", "kinds"), lambda s: F.struct(s["i_slots"].alias("i"), s["d_slots"].alias("d"), s["at"].alias("at"), s["kinds"].alias("k")))
    window_found = F.struct(F.col("i_place").alias("place"), F.col("template").alias("template"), fills.alias("fills"))
    pair = ["text_key", "key", "templates", "windows"]
    aligned = pairs.groupBy(*pair, "shift").agg(F.collect_set(window_found).alias("found"))
    aligned = aligned.withColumn("slots", F.array_distinct(F.flatten("found.fills")))
    aligned = aligned.withColumn("same", F.forall("slots", lambda s: s["i"] == s["d"])).withColumn("slots", F.filter("slots", lambda s: s["k"] != NUMBER))
    aligned = aligned.withColumn("fills", F.array_distinct(F.transform("slots", lambda s: F.struct(s["i"].alias("i"), s["d"].alias("d"))))).withColumn("found", _consistent())
    seen = aligned.select(*pair, "same", F.explode("found").alias("w")).groupBy(*pair, F.col("w.place").alias("place")).agg(F.bool_or("w.template").alias("template"), F.bool_or("same").alias("same"))
    total = seen.groupBy(*pair).agg(F.count("*").alias("windows_found"), F.count_if("template").alias("templates_found"), F.bool_and("same").alias("same"))
    share = F.greatest(F.col("windows_found") / F.col("windows"), F.try_divide(F.col("templates_found"), F.col("templates")))
    total = total.withColumn("coverage", share).where(F.col("coverage") >= coverage)
    return total, named, holders


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = 0.4) -> DataFrame:
    """``id_col, item_id, windows_found, coverage, kind``: documents that hold a benchmark item, or one with other parameters.

    A pair is reported if ``coverage`` of the item's windows or more are in the document,
    in alignments whose slots are filled consistently: where a name or unit of the item has
    several values in the document, the windows with any but the commonest are not counted
    (of equally common ones the item's own, else the one that comes first, counts).
    ``kind`` is ``exact`` if every window found is in an alignment where each slot has the
    item's own value, else ``reparameterised``.  Items shorter than a window count as one
    window of their length.

    Windows with placeholders for more than half of their tokens count where their values
    are equal too.  New values leave none of them, so that the coverage of an item's other
    windows alone is enough as well; ``coverage`` is the larger one, and ``windows_found``
    the windows of either kind.

    A name is a capitalised word within a sentence that is not a function word.

    Null and empty texts and items are in no pair.  Rows that repeat an id are read
    apart, each by its own text; a pair of id and item is reported once, with the most
    windows found.  A null id is reported as null.  An empty table on either side gives
    an empty result.  Other columns are ignored.

    Documents are read once, and only windows that a filter of the benchmark's may hold
    leave the workers.  A text can hold ``coverage`` of an item only if it holds one of
    the item's rarer windows, so that texts and items meet by those; windows that many
    items or documents share are looked at for such pairs only.
    """
    with scratch(docs.sparkSession):
        total, named, holders = _of_texts(docs, benchmark, id_col, text_col, item_col, item_text_col, window, coverage)
        of_ids = total.join(named, "key").join(holders.select(F.col("id").alias("__id"), F.col("key").alias("text_key")), "text_key")
        found = of_ids.groupBy(F.col("__id").alias(id_col), item_col).agg(F.max("windows_found").alias("windows_found"), F.max("coverage").alias("coverage"), F.when(F.bool_or("same"), "exact").otherwise("reparameterised").alias("kind"))
        return materialize(found, "contamination", keep=True)


def _consistent() -> F.Column:
    """The windows ``found`` at an alignment, without those where a slot has a rarer value than elsewhere."""

    def of(p):
        return F.filter("slots", lambda s: (s["i"] == p["i"]) & (s["d"] == p["d"]))

    counted = F.transform("fills", lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d"), F.size(of(p)).alias("n"), F.array_min(F.transform(of(p), lambda s: s["at"])).alias("first")))
    wins = lambda p, q: (p["n"] > q["n"]) | ((p["n"] == q["n"]) & ((p["d"] == p["i"]) | ((q["d"] != q["i"]) & (p["first"] < q["first"]))))
    # one expression for the counts, bound once
    odd = F.flatten(F.transform(F.array(counted), lambda c: F.filter(c, lambda p: F.exists(c, lambda q: (q["i"] == p["i"]) & (q["d"] != p["d"]) & ~wins(p, q)))))
    kept = F.flatten(F.transform(F.array(odd), lambda o: F.filter("found", lambda w: ~F.exists(w["fills"], lambda f: F.exists(o, lambda b: (b["i"] == f["i"]) & (b["d"] == f["d"]))))))
    return F.when(F.size(F.array_distinct("fills.i")) == F.size("fills"), F.col("found")).otherwise(kept)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = 0.4) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item.

    Judged by text, so that rows without an id, or with one that repeats, are judged
    each by its own text.  Rows without a text stay.
    """
    (key,) = spare(docs.columns, "__key")
    keyed = docs.withColumn(key, F.unhex(F.md5(F.col(text_col).cast("string").cast("binary"))))
    with scratch(docs.sparkSession):
        texts = docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"))
        total, _, _ = _of_texts(texts, benchmark, "doc_id", "text", item_col, item_text_col, window, coverage)
        gone = materialize(total.select(F.col("text_key").alias(key)).distinct(), "contaminated", keep=True)
    return by_keys(keyed, gone, key, "left_anti").select(*docs.columns)
