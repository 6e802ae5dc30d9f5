"""Near duplicates against brute force."""

import numpy as np
import pytest

from tidemark.llm import minhash
from tidemark.llm.components import connected_components
from tidemark.llm.hashing import shingle_set


def brute(rows, size, percent):
    """Components by comparing all pairs of plain string shingles."""
    sets = {}
    for i, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in w).split(" ") if x]
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if i and rng.random() < 0.6:
            base = rows[rng.integers(len(rows))][1].split()
            for _ in range(rng.integers(0, 4)):
                base[rng.integers(len(base))] = words[rng.integers(400)]
            rows.append((i, " ".join(base)))
        else:
            rows.append((i, " ".join(rng.choice(words, rng.integers(20, 120)))))
    return rows


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_like_brute_force(spark, size, percent):
    rows = corpus(size) + [(900, None), (901, ""), (902, " \n"), (903, "Hello World"), (904, "hello\tworld"), (905, "É hello"), (906, "é hello")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=size, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, size, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_rows(spark, docs):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = docs([(5, long, None, None), (3, long + " end", "en", "s"), (3, long + " end", "en", "s"), (None, "a b c d e f", None, None), (8, None, None, None)])
    got = minhash.near_duplicates(rows).collect()
    assert len(got) == 5
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["component_id"], r["kept"]))
    assert by == {5: [(3, False)], 3: [(3, True)] * 2, None: [(None, True)], 8: [(8, True)]}
    kept = minhash.drop_near_duplicates(rows)
    assert kept.columns == rows.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "8", "None"]
    assert minhash.near_duplicates(rows.limit(0)).count() == 0


def test_links_within_blocks():
    """The block comparison finds what connects, however pieces fall."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**32, 300, dtype=np.uint32)
    sets = [np.unique(np.concatenate([base[i : i + 250], rng.integers(0, 2**32, 5, dtype=np.uint32)])) for i in range(0, 50, 2)]
    ids, comps = np.arange(25), np.arange(25)
    want = {(i, j) for i in range(25) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    keep, minhash.GATHER = minhash.GATHER, 1000
    got = {(max(p), min(p)) for p in minhash.links_within(ids, comps, sets, 85)}
    minhash.GATHER = keep
    # spanning links: each is one of the pairs, and together they connect what the pairs connect
    assert got <= want and reach(got) == reach(want) and len(got) < 25


def reach(pairs):
    of = {i: i for p in pairs for i in p}
    for _ in of:
        for a, b in pairs:
            of[a] = of[b] = min(of[a], of[b])
    return of


def test_tensor_product_of_tuples():
    t = minhash.tuples_needed(85)
    assert 2 * (1 - 0.85**minhash.TUPLE) ** t <= 5e-5
    a = shingle_set(" ".join(f"w{i}" for i in range(200)), 3)
    assert (minhash.minhash_tuples(a, t) == minhash.minhash_tuples(a[::-1].copy(), t)).all()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 101), (None, 4)]
    got = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}
