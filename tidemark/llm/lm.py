"""A log-bilinear language model, trained by noise-contrastive estimation, and its scores.

Tokens are lower-cased words and one end a text.  The most frequent words are units of
the model; every other word belongs to one of some classes by its last two bytes, which
are units as well.  The model predicts a unit from the two before it: their vectors, each
through its position's weights, add up to a prediction whose product with a unit's output
vector, and a bias, is that unit's score.  A word of a class then has its share of the
class's tokens, counted over the whole corpus, with one share for words never seen.

Training goes over all texts that may be learned from, a part of them in each round:
every task starts with the same weights and goes through its own texts, and the weights'
means over all tasks start the next round.  Noise is drawn from the units' frequencies,
one sample for a whole batch, so that all products are of matrices.  As there are few
units, the scores of all pairs of units and the logarithms of all contexts' sums are worked
out once, by products of whole matrices; normalised probabilities of tokens are then
looked up.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize, new_path, scratch

#: Units that are words, units that are classes of the other words, and width of vectors.
WORDS, CLASSES, WIDTH = 511, 128, 32
#: Words, by frequency, whose counts every worker holds; those of the others are joined.
KNOWN = 100_000
#: Rounds of training, examples of a batch, noise samples of a batch, step size.
ROUNDS, BATCH, NOISE, STEP = 4, 1024, 64, 0.8
END = b""
#: Distinct words that a counting task holds at a time.
HELD = 400_000
_BUCKETS_A_LOG = 200


def class_of(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-2:]) % classes


# ---------------------------------------------------------------- the model


@dataclass
class Weights:
    """Vectors of units as context and as output, weights of the two positions, biases; of each also the squared steps so far."""

    context: np.ndarray
    output: np.ndarray
    position: np.ndarray
    bias: np.ndarray
    context_sq: np.ndarray
    output_sq: np.ndarray
    position_sq: np.ndarray
    bias_sq: np.ndarray

    @classmethod
    def start(cls, share: np.ndarray, width: int, seed: int = 1) -> Weights:
        """Biases give the units' frequencies; vectors are small and the same in every run."""
        r = np.random.default_rng(seed)
        n = len(share)
        made = [r.normal(0, 0.1, (n, width)), r.normal(0, 0.1, (n, width)), np.ones((2, width)), np.log(share)]
        return cls(*[x.astype(np.float32) for x in made], *[np.full(x.shape, 1e-2, np.float32) for x in made])

    def packed(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)]).astype(np.float32)

    @classmethod
    def unpacked(cls, flat: np.ndarray, units: int, width: int) -> Weights:
        shapes = [(units, width), (units, width), (2, width), (units,)] * 2
        edges = np.cumsum([0, *[int(np.prod(s)) for s in shapes]])
        return cls(*[flat[a:b].reshape(s).astype(np.float32) for a, b, s in zip(edges, edges[1:], shapes, strict=False)])


def _sums(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and the sum of the rows of each."""
    order = np.argsort(ids, kind="stable")
    at = ids[order]
    edge = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[edge], np.add.reduceat(rows[order], edge, axis=0)


def train(w: Weights, share: np.ndarray, units: np.ndarray, earlier: np.ndarray, before: np.ndarray, seed: int, step: float = STEP, noise: int = NOISE, batch: int = BATCH) -> None:
    """One pass of noise-contrastive estimation over examples ``earlier, before -> units``; changes ``w``."""
    r = np.random.default_rng(seed)
    order = r.permutation(len(units))
    log_noise = np.log(noise * share).astype(np.float32)
    edges = np.cumsum(share)

    def move(name: str, grad: np.ndarray, at: np.ndarray | None = None) -> None:
        value, sq = getattr(w, name), getattr(w, name + "_sq")
        if at is None:
            sq += grad * grad
            value += step * grad / np.sqrt(sq)
        else:
            sq[at] += grad * grad
            value[at] += step * grad / np.sqrt(sq[at])

    for lo in range(0, len(order), batch):
        k = order[lo : lo + batch]
        y, x1, x2 = units[k], earlier[k], before[k]
        r1, r2 = w.context[x1], w.context[x2]
        h = r1 * w.position[0] + r2 * w.position[1]
        drawn = np.minimum(np.searchsorted(edges, r.random(noise)), len(share) - 1)
        q, qn = w.output[y], w.output[drawn]
        true = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", h, q) + w.bias[y] - log_noise[y], -30, 30)))
        false = 1 / (1 + np.exp(-np.clip(h @ qn.T + w.bias[drawn] - log_noise[drawn], -30, 30)))
        gt, gn = (1 - true) / len(k), -false / len(k)
        gh = gt[:, None] * q + gn @ qn
        ids = np.concatenate([y, drawn])
        at, g = _sums(np.concatenate([np.column_stack([gt[:, None] * h, gt]), np.column_stack([gn.T @ h, gn.sum(0)])]), ids)
        move("output", g[:, :-1], at)
        move("bias", g[:, -1], at)
        move("position", np.stack([(gh * r1).sum(0), (gh * r2).sum(0)]))
        at, g = _sums(np.concatenate([gh * w.position[0], gh * w.position[1]]), np.concatenate([x1, x2]))
        move("context", g, at)


@dataclass
class Tables:
    """Scores of every unit after every unit, two places and one place back, and the logarithm of each context's sum."""

    two_back: np.ndarray
    one_back: np.ndarray
    log_sum: np.ndarray

    @classmethod
    def of(cls, w: Weights) -> Tables:
        """The bias is part of ``one_back``."""
        two = (w.context * w.position[0]) @ w.output.T
        one = (w.context * w.position[1]) @ w.output.T + w.bias
        log_sum = np.empty((len(two), len(two)), np.float32)
        for i, row in enumerate(two):
            s = row + one
            top = s.max(1)
            log_sum[i] = top + np.log(np.exp(s - top[:, None]).sum(1))
        return cls(two, one, log_sum)

    def log10(self, earlier: np.ndarray, before: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Normalised logarithms of the units' probabilities."""
        return (self.two_back[earlier, units] + self.one_back[before, units] - self.log_sum[earlier, before]).astype(np.float64) / np.log(10)


def contexts(units: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The two units before each unit; before a text's first, at ``starts``, there are ends."""
    before = np.concatenate([[end], units[:-1]]).astype(units.dtype)
    before[starts] = end
    earlier = np.concatenate([[end], before[:-1]]).astype(units.dtype)
    earlier[starts] = end
    return earlier, before


# ---------------------------------------------------------------- counts and units


def word_counts(texts: DataFrame, classes: int = CLASSES) -> DataFrame:
    """``word, class, n`` of every distinct token of ``text`` (binary), the end of each text among them.

    Every task counts its own texts and hands on sums, of ``HELD`` words at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            words = list(tally)
            for at in range(0, len(words), 50_000):
                some = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([class_of(w, classes) for w in some], pa.int32()), pa.array([tally[w] for w in some], pa.int64())], names=["word", "class", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                tally.update(text.lower().split() if text else ())
                if len(tally) > HELD:
                    yield from rows()
                    tally.clear()
            tally[END] += batch.num_rows
        yield from rows()

    return texts.select("text").mapInArrow(count, "word binary, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n")).where("n > 0")


@dataclass
class Vocabulary:
    """What workers hold: counts of the frequent words, and the units."""

    known: dict[bytes, int]
    words: dict[bytes, int]
    classes: int
    share: np.ndarray
    mass: np.ndarray
    tokens: int
    distinct: int

    @property
    def units(self) -> int:
        return len(self.words) + self.classes


def vocabulary(counts: DataFrame, words: int = WORDS, classes: int = CLASSES, known: int = KNOWN) -> Vocabulary:
    """Of counts of the whole corpus.  To the driver go sums, and ``known`` words at most: those of more than a count found in a histogram of counts."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bucket = F.floor(F.log(F.col("n")) * _BUCKETS_A_LOG)
    least, room = None, known
    for b, n in sorted(((r[0], r[1]) for r in counts.groupBy(bucket.alias("b")).count().collect()), reverse=True):
        room -= n
        if room < 0:
            break
        least = b
    frequent = {bytes(w): n for w, n in (counts.where(bucket >= least).select("word", "n").collect() if least is not None else [])}
    top = sorted((w for w in frequent if w != END), key=lambda w: (-frequent[w], w))[:words]
    unit = {w: i for i, w in enumerate([END, *top])}
    share, mass = np.zeros(len(unit) + classes), np.ones(len(unit) + classes)
    for c, n, k in counts.groupBy("class").agg(F.sum("n"), F.count("*")).collect():
        share[len(unit) + c], mass[len(unit) + c] = n, n + 0.5 * k + 0.5
    for w, i in unit.items():
        share[i] = frequent.get(w, 0)
        if w in frequent or w == END:
            c = len(unit) + class_of(w, classes)
            share[c] -= frequent.get(w, 0)
            mass[c] -= frequent.get(w, 0) + 0.5 * (w in frequent)
    if END not in frequent and total:  # the end is among the counted words, whether frequent or not
        ends = counts.where(F.col("word") == F.lit(END)).first()["n"]
        share[0], c = ends, len(unit) + class_of(END, classes)
        share[c], mass[c] = share[c] - ends, mass[c] - ends - 0.5
        frequent[END] = ends
    share += 0.5
    return Vocabulary(frequent, unit, classes, share / share.sum(), mass, int(total), int(distinct))


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Every row of ``id, text (binary), held_out`` with ``units`` (two bytes each) and what is known of its tokens.

    ``n_known`` and ``log_counts`` are of frequent words only; ``others`` has the rest with
    their numbers.  ``log_masses`` is of all words of classes, ``log_inside`` of the
    frequent ones among them.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([
        ("id", pa.int64()), ("held_out", pa.bool_()), ("units", pa.binary()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()), ("log_inside", pa.float64()), ("log_masses", pa.float64()),
        ("others", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        place = {w: i for i, w in enumerate(v.known)}
        logs = np.log10(np.fromiter(v.known.values(), np.float64, len(v.known)) + 0.5)
        first = len(v.words)
        unit = np.array([v.words.get(w, first + class_of(w, v.classes)) for w in v.known], np.uint16)
        log_mass = np.log10(v.mass)
        end = place.get(END, -1)

        def one(key: int, out: bool, text: bytes | None) -> tuple:
            words = text.lower().split() if text else []
            at = np.fromiter(map(place.get, words, repeat(-1)), np.int32, len(words))
            at = np.append(at, np.int32(end))
            units = unit[at] if len(unit) else np.zeros(len(at), np.uint16)
            rare = np.flatnonzero(at[:-1] < 0)
            others = Counter(map(words.__getitem__, rare.tolist()))
            units[rare] = [first + class_of(words[i], v.classes) for i in rare.tolist()]
            units[-1] = 0
            found = at[at >= 0]
            inside = units >= first
            return (key, out, units.tobytes(), len(at), len(found), float(logs[found].sum()), float(logs[at[inside & (at >= 0)]].sum()), float(log_mass[units[inside]].sum()), [{"word": w, "n": n} for w, n in others.items()])

        for batch in batches:
            rows, size = [], 0
            for row in zip(*[batch.column(c).to_pylist() for c in ("id", "held_out", "text")], strict=True):
                rows.append(one(*row))
                size += rows[-1][3]
                if size > 300_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("id", "held_out", "text").mapInArrow(run, "id long, held_out boolean, units binary, n_tokens long, n_known long, log_counts double, log_inside double, log_masses double, others array<struct<word:binary,n:long>>")


# ---------------------------------------------------------------- training and scoring


def _examples(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    units = np.concatenate([np.frombuffer(t, np.uint16) for t in texts])
    starts = np.cumsum([0, *[len(t) // 2 for t in texts[:-1]]])
    return (units, *contexts(units, starts, 0))


def fit(encoded: DataFrame, vocabulary: Vocabulary, width: int = WIDTH, rounds: int = ROUNDS, held: int = 400_000, **how) -> Weights:
    """Weights after ``rounds``, each over its share of the texts of ``units`` by their ``row``.

    Tasks hand on their weights times their tokens as parts of vectors, which are summed
    where they are and then over all tasks: what reaches the driver is one set of weights.
    """
    weights = Weights.start(vocabulary.share, width)
    size, part = len(weights.packed()), 2048
    spark = encoded.sparkSession
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(weights.packed())

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            w, seen, texts, n = Weights.unpacked(sent.value.copy(), vocabulary.units, width), 0, [], 0

            def step() -> None:
                train(w, vocabulary.share, *_examples(texts), seed=turn, **how)

            for batch in batches:
                for t in batch.column("units").to_pylist():
                    texts.append(t)
                    n += len(t) // 2
                    if n >= held:
                        step()
                        seen, texts, n = seen + n, [], 0
            if n:
                step()
                seen += n
            if seen:
                flat = w.packed().astype(np.float64) * seen
                for lo in range(0, size, part):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, min(lo + part, size)), pa.int32()), pa.array(flat[lo : lo + part]), pa.array(np.full(min(part, size - lo), float(seen)))], names=["at", "value", "weight"])

        chosen = encoded.where(~F.col("held_out") & (F.pmod(F.xxhash64("row"), F.lit(rounds)) == turn)).select("units")
        mean = chosen.mapInArrow(learn, "at int, value double, weight double").groupBy("at").agg((F.sum("value") / F.sum("weight")).alias("value")).collect()
        if mean:
            flat = np.empty(size, np.float32)
            flat[[r[0] for r in mean]] = [r[1] for r in mean]
            weights = Weights.unpacked(flat, vocabulary.units, width)
    return weights


def language_model_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, classes: int = CLASSES, known: int = KNOWN, width: int = WIDTH, rounds: int = ROUNDS, **how) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Learns from the rows for which ``held_out`` is not true (null counts as false).
    ``base_score`` is the logarithm, to base 10, of the text's probability by its words'
    frequencies, ``score`` by the model; ``n_known`` counts tokens that were seen in
    training.  Null and empty texts are one end.  Repeated rows are scored one by one,
    and learned from as often.  Without anything to learn from, all words are equally
    unknown.  Only the named columns and those of ``held_out`` are read.

    Whole texts are counted, learned from and scored.  Words beyond the ``known`` most
    frequent are joined with their counts; their rows are sums for a text and word.
    """
    spark = docs.sparkSession
    with scratch(spark):
        named = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").cast("binary").alias("text"))
        counts = materialize(word_counts(named.where("not held_out"), classes), "word-counts")
        v = vocabulary(counts, words, classes, known)
        encoded = materialize(encode(named.withColumn("id", F.col("id").cast("long")), v).withColumn("row", F.monotonically_increasing_id()), "encoded")
        weights = fit(encoded, v, width, rounds, **how)
        tables = spark.sparkContext.broadcast(Tables.of(weights))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = tables.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                texts = batch.column("units").to_pylist()
                units, earlier, before = _examples(texts)
                logs = t.log10(earlier, before, units)
                starts = np.cumsum([0, *[len(x) // 2 for x in texts[:-1]]])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(np.add.reduceat(logs, starts))], names=[*rest, "units_score"])

        rest = ["row", "id", "held_out", "n_tokens", "n_known", "log_counts", "log_inside", "log_masses"]
        kinds = dict(encoded.dtypes)
        scored = encoded.select(*rest, "units").mapInArrow(score, ", ".join(f"{c} {kinds[c]}" for c in rest) + ", units_score double")
        pairs = encoded.select("row", F.explode("others").alias("o")).select("row", "o.word", F.col("o.n").alias("times"))
        found = pairs.join(counts.select("word", "n"), "word", "left")
        log = F.log10(F.coalesce("n", F.lit(0)) + 0.5)
        rare = found.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * log).alias("logs"))
        joined = scored.join(rare, "row", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        per_token = float(np.log10(v.tokens + 0.5 * (v.distinct + 1)))
        result = joined.select(
            F.col("id").cast(dict(docs.dtypes)[id_col]).alias(id_col), "held_out", "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
            (F.col("log_counts") + zero("logs") - F.col("n_tokens") * per_token).alias("base_score"), (F.col("units_score") + F.col("log_inside") + zero("logs") - F.col("log_masses")).alias("score"),
        )
        return materialize(result, "scores", keep=True)
