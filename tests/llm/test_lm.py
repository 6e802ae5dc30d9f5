"""The language model: counts and base score against a plain loop, probabilities that sum to one, held-out gain."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm


def corpus(seed=1, n=300):
    r = random.Random(seed)
    follow = {k: r.sample("alpha beta gamma delta eins zwei drei vier Un deux trois".split(), 3) for k in "alpha beta gamma delta eins zwei drei vier Un deux trois".split()}
    rows = []
    for i in range(n):
        word, words = r.choice(list(follow)), []
        for _ in range(r.randrange(0, 120)):
            word = r.choice(follow[word])
            words.append(word if r.random() < 0.9 else f"rare{r.randrange(4000)}")
        rows.append((i, r.choice([" ", "\n", "\t "]).join(words)))
    return rows + [(None, "no id at all"), (7, rows[7][1]), (n, None), (n + 1, ""), (n + 2, "    x\u000by"), (n + 3, "long " * 30_000)]


def scores(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1.5, 9) for r in rows], "doc_id long, text string, word string, score double, row int").repartition(4)
    return lm.language_model_scores(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, **kw).collect()


def plain(rows):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted((i is None, i or 0, out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)


@pytest.mark.parametrize("known", [100_000, 20, 1])
def test_base_score(spark, known):
    rows = corpus()
    got = scores(spark, rows, known=known, rounds=1)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == plain(rows)


def test_held_out_gain(spark):
    got = [r for r in scores(spark, corpus(n=1500), words=40, classes=4, batch=128) if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) + 0.2 * sum(r["n_tokens"] for r in got)
    assert all(r["score"] < 0 for r in got)


def test_probabilities_sum_to_one(spark):
    """Over all words that were seen, and one unseen word a class, after any context."""
    rows = [r[1] for r in corpus(3, 200)]
    texts = spark.createDataFrame([(None if t is None else t.encode(),) for t in rows], "text binary")
    for known, classes in ((100_000, 3), (5, 3)):
        counts = lm.word_counts(texts, classes)
        v = lm.vocabulary(counts, words=6, classes=classes, known=known)
        w = lm.Weights.start(v.share, 8)
        r = np.random.default_rng(0)
        w.context[:] = r.normal(0, 1, w.context.shape)
        w.output[:] = r.normal(0, 1, w.output.shape)
        t = lm.Tables.of(w)
        within = Counter()
        for row in counts.collect():
            word = bytes(row["word"])
            if word not in v.words:
                c = len(v.words) + lm.class_of(word, classes)
                within[c] += (row["n"] + 0.5) / v.mass[c]
        for a in range(v.units):
            for b in range(v.units):
                p = 10 ** t.log10(np.full(v.units, a), np.full(v.units, b), np.arange(v.units))
                assert abs(p.sum() - 1) < 1e-4
        for c in range(len(v.words), v.units):
            assert abs(within[c] + 0.5 / v.mass[c] - 1) < 1e-9
        assert abs(v.share.sum() - 1) < 1e-9


def test_training_raises_likelihood():
    r = np.random.default_rng(2)
    units = np.zeros(60_000, np.uint16)
    for i in range(2, len(units)):
        units[i] = (units[i - 1 - i % 2] + r.integers(0, 2)) % 7  # what a sum of two vectors can tell in part
    share = np.bincount(units, minlength=7) / len(units)
    w = lm.Weights.start(share, 16)
    examples = (units, *lm.contexts(units, np.array([0]), 0))
    before = lm.Tables.of(w).log10(*examples[1:], units).mean()
    for k in range(3):
        lm.train(w, share, *examples, seed=k)
    assert lm.Tables.of(w).log10(*examples[1:], units).mean() > before + 0.15


def test_without_anything_to_learn(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = scores(spark, [(held, "a b"), (held, None)])
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [(1, 0, 0), (3, 0, 0)]
    assert all(np.isfinite([r["score"], r["base_score"]]).all() for r in got)
    assert scores(spark, []) == []
