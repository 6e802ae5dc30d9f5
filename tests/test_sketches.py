"""Candidates by sketches of all pairs, over several groups, lose no pair that reaches a threshold."""

import random

from tidemark.operators import leakage


def test_near(spark, monkeypatch):
    monkeypatch.setattr(leakage, "_GROUP", 40)
    monkeypatch.setattr(leakage, "_TILE", 16)
    rng = random.Random(8)
    rows = []
    for i in range(150):
        base = rows[rng.randrange(i)] if i and i % 3 else None
        sets = [set(rng.sample(range(2000), rng.randint(1, 120))) if base is None else set(rng.sample(sorted(base[k]), max(1, len(base[k]) - rng.randint(0, 12)))) | set(rng.sample(range(2000), rng.randint(0, 12))) for k in (1, 2)]
        rows.append((i.to_bytes(2), *sets))
    rows.append((b"none", set(), set()))
    data = spark.createDataFrame([(i, sorted(a), sorted(b)) for i, a, b in rows], "id binary, tokens array<long>, grams array<long>")
    like = lambda a, b: len(a & b) / max(1, len(a | b))
    want = {(x[0], y[0]) for x in rows for y in rows if like(x[1], y[1]) >= leakage.TOKEN[1] or like(x[2], y[2]) >= leakage.TRIGRAM[1]}
    pairs = lambda d: {(bytes(r[0]), bytes(r[1])) for r in d.collect()}
    once, both = pairs(leakage._near(data, data, True)), pairs(leakage._near(data, data, False))
    assert len(want) > 250 and want <= both and {p for p in want if p[0] < p[1]} <= once
    assert all(x < y for x, y in once) and len(both) < len(rows) ** 2 / 4
