"""Contamination against a plain reading of the definition, and cases that merge or cut must not lose."""

import random
import re

import pytest

from tidemark.llm import decontam

ITEM = "If John buys 12 kg of apples in Paris and gives half of the apples to his friend Mary, how many apples are left for him at the end"
OTHER = "If Peter buys 40 kg of apples in Rome and gives half of the apples to his friend Anna, how many apples are left for him at the end"


def read(text):
    """Tokens as (kind, canonical, value), by regular expressions over the whole text."""
    out, end, opens = [], 0, True
    words = lambda s: set(s.split())
    for m in re.finditer(r"\d+(?:[.,]\d+)*|[^\W\d_]+", text):
        opens = opens if m.start() == end and end else (not out or bool(re.search(r"[\n!.:?]", text[end : m.start()])))
        end, w, low = m.end(), m[0], m[0].lower()
        kind = "w"
        if w[0].isdigit() or low in words(decontam.NUMBERS):
            kind = "number"
        elif len(w) > 1 and w[0].isupper() and not w[1].isupper() and not opens and low not in words(decontam.NEVER_NAMES):
            kind = "name"
        out.append((kind, low))
        opens = False
    for i in range(len(out)):
        if i and out[i - 1][0] == "number" and out[i][1] in words(decontam.UNITS):
            out[i] = ("unit", out[i][1])
    merged = []
    for kind, v in out:
        if kind == "name" and merged and merged[-1][0] == "name" and merged[-1][2]:
            merged[-1] = ("name", merged[-1][1] + " " + v, True)
        else:
            merged.append((kind, v, kind == "name"))
    return [(k, v if k == "w" else k, v) for k, v, _ in merged]


def brute(docs, items, size=8, least=0.4):
    pairs = set()
    for i, it in items:
        a = read(it)
        n = min(size, len(a))
        if not n:
            continue
        wins = range(len(a) - n + 1)
        plain = {p: sum(t[0] == "w" for t in a[p : p + n]) >= (n + 1) // 2 for p in wins}
        for d, text in docs:
            b, seen = read(text or ""), {}
            for shift in {q - p for p in wins for q in range(len(b) - n + 1)}:
                got = []
                for p in wins:
                    if 0 <= p + shift <= len(b) - n:
                        x, y = a[p : p + n], b[p + shift : p + shift + n]
                        if [t[1] for t in x] == [t[1] for t in y] and (plain[p] or [t[2] for t in x] == [t[2] for t in y]):
                            got.append(p)
                fills = {}
                for k in sorted({p + j for p in got for j in range(n)}):
                    if a[k][0] in ("name", "unit"):
                        fills.setdefault(a[k][1:], {}).setdefault(b[k + shift][2], []).append(k)
                bad = set()
                for (_, own), by in fills.items():
                    best = min(by, key=lambda v: (-len(by[v]), v != own, by[v][0]))
                    bad |= {k for v, ks in by.items() if v != best for k in ks}
                for p in got:
                    if not bad & set(range(p, p + n)):
                        seen[p] = True
            templates = sum(plain.values())
            if seen and max(len(seen) / len(plain), sum(plain[p] for p in seen) / templates if templates else 0) >= least:
                pairs.add((d, i))
    return pairs


@pytest.mark.parametrize("seed", [3, 11])
def test_like_brute_force(spark, seed):
    rng = random.Random(seed)
    words = "river stone bridge watch boats summer bring apples count shop road bread soup field garden letter music small green quick".split()

    def sentence(n):
        out = [rng.choice(words) for _ in range(n)]
        for _ in range(n // 6):
            out[rng.randrange(1, n)] = rng.choice(["Anna", "Maria", "12", "40", "7 kg", "3 miles", "Paris"])
        return " ".join(out)

    items = [(i, sentence(rng.randint(4, 30))) for i in range(40)] + [(50, "12 * 7 - 3 = 81"), (51, "7 5 3 + 2 9 8 = ?"), (None, sentence(20)), (53, sentence(12) + ". " + sentence(9))]
    docs = []
    for k in range(160):
        text = sentence(rng.randint(0, 25) + 6)
        for _ in range(rng.randint(0, 2)):
            it = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 3)):
                it[rng.randrange(len(it))] = rng.choice(words + ["Anna", "Oslo", "99", "5"])
            text += " and " + " ".join(it[rng.randint(0, 2) :]) + rng.choice([" ", ". "]) + sentence(8)
        docs.append((k, text))
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 40


def test_repeated_ids_are_read_apart(spark):
    bench = spark.createDataFrame([(1, ITEM, 5)], "item_id long, question string, doc_id int")
    rows = spark.createDataFrame([(2, "first " + ITEM, 1), (2, "second " + OTHER, 1), (3, "x", 1), (2, "second " + OTHER, 1)], "doc_id long, text string, item_id int")
    got = decontam.contaminated(rows, bench, item_text_col="question").collect()
    assert [(r["doc_id"], r["item_id"], r["kind"]) for r in got] == [(2, 1, "exact")]
    kept = decontam.drop_contaminated(rows, bench, item_text_col="question")
    assert kept.columns == rows.columns and [r["doc_id"] for r in kept.collect()] == [3]


def test_equal_numbers_may_part(spark):
    item = "A farmer has 12 apples and 12 pears in his cart on the way to the market and sells half of the fruit there"
    got = decontam.contaminated(spark.createDataFrame([(1, item.replace("12 apples", "40 apples").replace("12 pears", "33 pears"))], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [r["kind"] for r in got.collect()] == ["reparameterised"]


@pytest.mark.parametrize("chunk", [1, 7, 64, 1000])
def test_pieces_change_nothing(chunk, monkeypatch):
    reader = decontam.Canonical()
    text = "One more thing about 3.5 km and 1,000 Words of Anna Maria. Then Paris!  (7 kg) " * 30 + "x" * 3000 + "9" * 500 + "\n\nRome is. 。 Oslo Bergen" + "\t" * 50 + "end 12 miles"
    whole = reader.tokens(text)
    monkeypatch.setattr(decontam, "CHUNK", chunk)
    parts = reader.tokens(text)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, parts, strict=True))


def test_filter_holds_every_hash(spark, monkeypatch):
    import numpy as np

    values = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 5000)
    df = spark.createDataFrame([(int(v),) for v in values], "window long")
    monkeypatch.setattr(decontam, "SEGMENT_BITS", 1 << 16)
    bits = decontam._filter(df)
    assert decontam._may_hold(bits, values.astype(np.uint64)).all()
    other = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 100_000).astype(np.uint64)
    assert decontam._may_hold(bits, other).mean() < 0.05
