"""Decisions of the two classifiers against naive ones made from the same weights: n-gram by n-gram, block by block."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import langid, quality


def grams(text):
    """Hashed letter n-grams of a text, one at a time."""
    words = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    if not words:
        return None
    s, out = f" {words} ", {}
    for i in range(1, len(s)):
        c = [ord(x) for x in s[max(0, i - 2) : i + 1]]
        found = [(0, c[-1])] if s[i] != " " else []
        found.append((1, c[-2] * 0x10001 + c[-1]))
        if i > 1:
            found.append((2, c[0] * 0x1000193 + c[1] * 0x10001 + c[2]))
        for size, g in found:
            at = ((g + size + 1) * 0x9E3779B97F4A7C15 % 2**64 >> 40) & (langid.DIMENSIONS - 1)
            out[at] = out.get(at, 0) + 1
    length = math.sqrt(sum(out.values()))  # of the square roots of the counts
    return {k: math.sqrt(v) / length for k, v in out.items()}


def voted(model, text):
    x = grams(text) if text else None
    if x is None or not model.families:
        return "und", 0.0

    def choose(names):
        wins, sums, sure = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for a, b in combinations(names, 2):
            w = model.machines[a, b]
            m = sum(w[k] * v for k, v in x.items()) + w[-1]
            p = 1 / (1 + math.exp(-model.sharpness * m))
            wins[a if m >= 0 else b] += 1
            sums[a], sums[b] = sums[a] + m, sums[b] - m
            sure[a], sure[b] = min(sure[a], p), min(sure[b], 1 - p)
        best = sorted(names, key=lambda n: (-wins[n], -sums[n], n))[0]
        return best, sure[best]

    family, p = choose(sorted(model.families))
    lang, q = choose(model.families[family])
    return lang, p * q


SYLLABLES = {"en": "the and ing ough sh ly", "de": "ung sch ein ich keit er", "sv": "och att ska inte för", "fr": "eau que tion est les", "es": "ción que los ado ez"}


def texts(n, seed):
    r = random.Random(seed)
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        words = ["".join(r.choices(SYLLABLES[lang].split(), k=r.randint(1, 3))) for _ in range(r.randint(1, 60))]
        yield i, " ".join(words).capitalize() + r.choice([".", " 12,5!", "\n\n", "ß"]), lang


def test_votes(spark):
    rows = list(texts(400, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs)
    assert len(model.families) == 2 and len(model.machines) == 1 + 3 + 1
    odd = [(1000, None), (1001, ""), (1002, "12 34"), (1003, "ça et là " * 40_000), (1004, "Ünïcödé"), (1005, rows[0][1])]
    every = [(i, t) for i, t, _ in texts(300, 2)] + odd
    got = langid.identify(spark.createDataFrame(every, "doc_id long, text string"), model).collect()
    for r in got:
        lang, score = voted(model, r["text"])
        assert (r["lang_pred"], r["score"]) == (lang, pytest.approx(score, abs=1e-9)), r["doc_id"]


def test_compressed_sizes(spark):
    r = random.Random(3)
    good = lambda: " ".join(r.choices("the river runs along a quiet valley and birds sing there in spring".split(), k=r.randint(1, 900)))
    bad = lambda: "".join(r.choices("$$%#! buy now click xx 999 ", k=r.randint(1, 4000)))
    rows = [(i, good() if i % 2 else bad()) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    more = [*rows, (500, None), (501, ""), (502, "é" * 3000), (503, "river " * 50_000)]
    got = {x["doc_id"]: x["score"] for x in quality.score_quality(spark.createDataFrame(more, "doc_id long, text string"), model).collect()}
    for i, text in more:
        data = (text or "").encode()
        sizes = []
        for d in (model.good, model.bad):
            z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=quality.LEVEL, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(z.compress(data[k : k + quality.BLOCK])) for k in range(0, len(data), quality.BLOCK)))
        x = (1.0, 10 * (sizes[1] - sizes[0]) / len(data), min(sizes) / len(data)) if data else (1.0, 0.0, 0.0)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.dot(x, model.weights))), abs=1e-9)
    report = quality.quality_report(docs, labels).where(F.col("held_out")).collect()
    assert np.mean([x["predicted"] == x["doc_id"] % 2 for x in report]) > 0.9
