"""Candidates of similar sets, components with hubs, fingerprints, phrases and windows against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import chunking, fingerprints, leakage, querybank


def family(r, n):
    """Sets of which many are copies of others with some elements changed, of sizes from 0 to 300."""
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            base = set(r.choice(out))
            for x in r.sample(sorted(base), int(len(base) * r.random() * 0.35)):
                base.discard(x)
                if r.random() < 0.7:
                    base.add(r.randrange(3000))
            out.append(base)
        else:
            out.append({int(3000 * r.random() ** 2) for _ in range(r.choice([0, 1, 3, 20, 120, 300]))})
    return out


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.6), (2, 0.68)])
def test_no_similar_pair_is_lost(spark, seed, threshold):
    r = random.Random(seed)
    salt = [r.getrandbits(63) - (1 << 62) for _ in range(3000)]
    sides = [family(r, 120), family(r, 90)]
    sides[1] += [set(x) for x in sides[0][:30]] + [set(list(x)[1:]) for x in sides[0][30:60]]
    frames = [spark.createDataFrame([(f"{k}{i}".encode(), [salt[e] for e in s]) for i, s in enumerate(side)], "id binary, s array<long>") for k, side in enumerate(sides)]
    alike = lambda a, b: bool(a | b) and len(a & b) / len(a | b) >= threshold
    want = {(i, j) for i, a in enumerate(sides[0]) for j, b in enumerate(sides[1]) if alike(a, b)}
    got = {(int(bytes(x["left_id"])[1:]), int(bytes(x["right_id"])[1:])) for x in leakage._candidates(*frames, "s", threshold, False).collect()}
    assert len(want) > 60 and want <= got and len(got) < len(want) + 0.02 * len(sides[0]) * len(sides[1])
    own = {tuple(sorted((f"0{i}".encode(), f"0{j}".encode()))) for i, a in enumerate(sides[0]) for j, b in enumerate(sides[0]) if i < j and alike(a, b)}
    found = [(bytes(x["left_id"]), bytes(x["right_id"])) for x in leakage._candidates(frames[0], frames[0], "s", threshold, True).collect()]
    assert own <= set(found) and len(found) == len(set(found)) and all(a < b for a, b in found)


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(leakage, "HUB", 20)
    r = random.Random(4)
    links = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1200)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(120)] + [(7, 7), (399, 1000), (None, 3)]
    nodes = [*range(400), *range(1000, 1202), *range(2000, 2300), 9999]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = leakage.components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(links, "left_id long, right_id long"))
    assert {x["id"]: x["component"] for x in found.collect()} == {n: find(n) for n in nodes}
    # a hub's links are dealt to many parts, and each still meets the hub's least neighbour
    star = spark.createDataFrame([(0, i) for i in range(1, 5000)], "u long, v long")
    assert leakage._least(star, 4999).agg(F.count("*"), F.min("m"), F.max("m")).first() == (4999, 1, 1)


def test_fingerprints_tell_what_differs(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string").repartition(3)
    a, b = [f"p{i}" for i in range(3000)], [f"p{i}" for i in range(5, 3003)]
    tree = fingerprints.merkle_tree(ids([*a, *a[:10], None, " "]), "id")
    assert fingerprints.root(tree).first() == querybank.corpus_anchor(ids(reversed(a)), "id").select(F.col("products").alias("n"), "fingerprint").first()
    other = fingerprints.merkle_tree(ids(b), "id")
    assert fingerprints.root(other).first()["fingerprint"] != fingerprints.root(tree).first()["fingerprint"]
    assert sorted(map(tuple, fingerprints.differing_ids(ids(a), ids(b), "id").collect())) == sorted([(f"p{i}", "local_only") for i in range(5)] + [(f"p{i}", "remote_only") for i in range(3000, 3003)])
    assert fingerprints.differing_leaves(tree, other).count() <= 8 and fingerprints.differing_leaves(tree, tree).count() == 0
    assert fingerprints.root(fingerprints.merkle_tree(ids([]), "id")).first()["n"] == 0
    assert sorted(r["side"] for r in fingerprints.differing_ids(ids([]), ids(["x", "y"]), "id").collect()) == ["remote_only"] * 2


def test_a_thousand_phrases(spark):
    r = random.Random(1)
    phrases = tuple(dict.fromkeys("".join(r.choices("abc ", k=r.randint(2, 6))) for _ in range(1000)))
    texts = ["".join(r.choices("abc ", k=200)) for _ in range(50)] + ["", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.phrases_in(F.col("t"), phrases).alias("p")).collect()
    for row in got:
        assert row["p"] == (None if row["t"] is None else [p for p in phrases if p in row["t"]])


def windows(text, step, keep):
    """Windows by looking at every place of each last fifth."""
    out, at = [], 0
    while at < (len(text) - keep if out else len(text)):
        end = at + step
        if end < len(text):
            low = end - step // 5
            for mark in (". ", "! ", "? ", "\n"):
                places = [i for i in range(low, end - len(mark) + 1) if text[i : i + len(mark)] == mark]
                if places and places[-1] > low:
                    end = places[-1] + 1
                    break
        out.append((at, end))
        at = len(text) if end >= len(text) else end - keep
    return out


def test_windows(spark):
    r = random.Random(3)
    texts = ["".join(r.choices(["ab", " ", ". ", "! ", "?", "? ", "\n", "é", "\U0001f600"], [9, 4, 1, 1, 1, 1, 1, 1, 1], k=r.randint(0, 3000))) for _ in range(60)] + [""]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", chunking.window_spans(F.col("t"), 30, 5).alias("s")).collect()
    for row in got:
        assert (row["s"] is None) if row["t"] is None else [tuple(x) for x in row["s"]] == windows(row["t"], 120, 20)
    took = []
    for n in (1_000_000, 10_000_000):
        text, began = "word. " * (n // 6), time.process_time()
        chunking._spans(text, 600, 120)
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.01)
