"""The pipeline against plain loops over the documents, stage by stage, and over odd tables."""

import hashlib
import math
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_decontam_brute import read
from tests.llm.test_dedup import brute as near_groups
from tidemark.llm import langid, quality

LANGS = {
    "en": "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son mais comme ou si leur y dont aux même nous été cette elle sans ses bien où entre fait deux".split(),
}
BENCH = [(1, "If John buys 12 kg of apples in Paris and gives half of the apples to his friend Mary, how many apples are left for him at the end"), (2, "Compute 12 + 30 * 7 - 4"), (3, None)]


def corpus():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        lang = list(LANGS)[i % 3]
        words = rng.choice(LANGS[lang], rng.integers(30, 90)).tolist()
        if i % 11 == 5:
            words = [w + "$%&#"[k % 4] * 3 for k, w in enumerate(words)]
        rows.append([i, " ".join(words), lang if i % 7 else None, f"s{i % 4}"])
    for i in (30, 31, 32):
        rows[i][1] = rows[12][1]
    rows[60][1] = rows[15][1] + " one word more"
    rows[33][1] = rows[33][1] + " " + BENCH[0][1] + " " + rows[34][1]
    rows[36][1] = rows[36][1] + ". " + BENCH[0][1].replace("12", "40").replace("John", "Peter").replace("Paris", "Rome")
    rows[39][1] = rows[39][1] + " " + BENCH[1][1]
    rows += [[300, None, "en", "s0"], [301, "", "en", "s1"], [302, "12 34 !!", None, None]]
    return [tuple(r) for r in rows]


def holds(text, item, size=8, least=0.4):
    """Whether the text holds the item, by all alignments of equal windows."""
    a, b = read(item), read(text)
    n = min(size, len(a))
    at = {}
    for q in range(len(b) - n + 1):
        at.setdefault(tuple(t[1] for t in b[q : q + n]), []).append(q)
    plain = {p: sum(t[0] == "w" for t in a[p : p + n]) >= (n + 1) // 2 for p in range(len(a) - n + 1)}
    by_shift = {}
    for p in plain:
        for q in at.get(tuple(t[1] for t in a[p : p + n]), []):
            if plain[p] or [t[2] for t in a[p : p + n]] == [t[2] for t in b[q : q + n]]:
                by_shift.setdefault(q - p, set()).add(p)
    seen = set()
    for shift, got in by_shift.items():
        fills = {}
        for k in sorted({p + j for p in got for j in range(n)}):
            if a[k][0] in ("name", "unit"):
                fills.setdefault(a[k][1:], {}).setdefault(b[k + shift][2], []).append(k)
        bad = set()
        for (_, own), by in fills.items():
            best = min(by, key=lambda v: (-len(by[v]), v != own, by[v][0]))
            bad |= {k for v, ks in by.items() if v != best for k in ks}
        seen |= {p for p in got if not bad & set(range(p, p + n))}
    templates = sum(plain.values())
    return bool(seen) and max(len(seen) / len(plain), sum(plain[p] for p in seen) / templates if templates else 0) >= least


def mix(rows):
    """Ids of which the mix takes words, and how many, by the definition of targets and order."""
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    of = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(of.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * of[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * of[s] for s in full}
        left -= sum(2 * of[s] for s in full)
        open_ -= full
    taken = {}
    for s in sources:
        want = math.floor(target[s] + 1e-9)
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
        whole = want // of[s] if of[s] else 0
        rest, before = want - whole * of[s], 0
        for r in own:
            taken[r[0]] = whole * size[r[0]] + min(max(rest - before, 0), size[r[0]])
            before += size[r[0]]
    return {i: n for i, n in taken.items() if n > 0}


def test_like_plain_loops(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 11 != 5)) for i in range(240) if i % 5], "doc_id long, quality int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame(BENCH, "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    kept = rows
    model = langid.fit_languages(docs)
    found = {r[0]: model.predict(r[1]) for r in kept}
    kept = [r for r in kept if found[r[0]][0] != langid.UNKNOWN and found[r[0]][1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    assert 200 < len(kept) < len(rows)
    scorer = quality.fit_quality(spark.createDataFrame(kept, docs.schema), labels).scorer()
    good = [r for r in kept if scorer.score(r[1]) >= corpus_pipeline.LEAST_QUALITY]
    assert len(good) < len(kept)
    comps = near_groups([(r[0], r[1]) for r in good], 5, 80)
    single = [r for r in good if comps[r[0]][1] == r[0]]
    assert len(good) - len(single) >= 3
    clean = [r for r in single if not any(t and holds(r[1], t) for _, t in BENCH)]
    assert len(single) - len(clean) == 3
    want = mix(clean)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == want
    assert [r["position"] for r in sorted(got, key=lambda r: (r["position"], r["doc_id"]))] == sorted(r["position"] for r in got)


@pytest.mark.parametrize("empty", ["labels", "benchmark", "both"])
def test_odd_tables(spark, tmp_path, empty):
    """Null and repeated ids, columns with the names of results, and empty tables beside documents."""
    rows = [(i if i % 9 else None, " ".join(LANGS["en"][(i * 7 + k) % 50] for k in range(25)) + f" number {i}", "en", "s", 1, 2.0, 3, "c") for i in range(60)]
    rows += [(7, rows[7][1], "en", "s", 1, 2.0, 3, "c"), (7, "other words under one id " * 5, "en", None, 1, 2.0, 3, "c"), (None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, position double, score int, kept string")
    labels = spark.createDataFrame([] if empty in ("labels", "both") else [(i, 1) for i in range(40)], "doc_id long, quality int")
    bench = spark.createDataFrame([] if empty in ("benchmark", "both") else [(1, rows[3][1])], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert {"doc_id", "text", "lang", "source", "score", "kept", "taken", "position"} <= set(out.columns)
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 7 in ids and (3 in ids) == (empty in ("benchmark", "both"))
    assert out.where(F.col("text").isNull()).count() == 0
