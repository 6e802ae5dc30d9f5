"""The second pass: spanning links, blocks, and ids with several texts."""

import numpy as np
import pytest

from tests.llm.test_dedup import brute, corpus
from tidemark.llm import minhash, storage


def test_equal_sets_give_spanning_links():
    sets = [np.arange(50, dtype=np.int64)] * 600
    ids = np.arange(600)
    assert len(minhash.links_within(ids, ids, sets, 85)) == 599
    assert len(minhash.links_within(ids, ids % 2, sets, 85)) == 1
    across = minhash.links_within(ids, ids, sets, 85, left=np.arange(600) < 300)
    assert len(across) == 599 and all((a < 300) != (b < 300) for a, b in across)


def test_links_are_exact():
    base = np.arange(100, dtype=np.int64)
    sets = [base, base[:85], base[:84], np.concatenate([base[:92], np.arange(1000, 1008)])]
    got = {frozenset(p) for p in minhash.links_within(np.arange(4), np.arange(4), sets, 85)}
    near = {frozenset((i, j)) for i in range(4) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert got <= near and len(got) == 3


def chain(n):
    """Texts each near the next and far from the others: one component that no star finds."""
    return [(i, " ".join(f"w{k}" for k in range(3 * i, 3 * i + 60))) for i in range(n)]


@pytest.mark.parametrize("block,hashes", [(1024, 250_000), (4, 250_000), (1024, 300)])
def test_blocks_and_chains(spark, monkeypatch, block, hashes):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_HASHES", hashes)
    rows = chain(60) + [(1000 + i, t) for i, t in corpus(9, 60)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=3, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 3, 85)


def test_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(80)) for c in "ab")
    rows = [(9, a), (9, b), (4, a + " more"), (2, b + " more"), (7, "other words here and nothing else at all"), (9, a)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=3, percent=85).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(2, 2, True), (4, 2, False), (7, 7, True), (9, 2, False), (9, 2, False), (9, 2, False)]


def test_scratch_goes(spark):
    import os

    df = spark.range(3)
    with storage.scratch(spark):
        gone = storage.materialize(df, "a").inputFiles()
        with storage.scratch(spark):
            inner = storage.materialize(df, "b").inputFiles()
            outer = storage.materialize(df, "c", keep=True)
        assert not any(os.path.exists(f.removeprefix("file://")) for f in inner) and outer.count() == 3
        kept = storage.materialize(df, "d", keep=True)
    assert kept.count() == 3 and not any(os.path.exists(f.removeprefix("file://")) for f in gone + outer.inputFiles())
