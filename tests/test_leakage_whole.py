"""Leakage queries over every row of long texts, against brute force."""

import itertools
import random

from tidemark.plans import registry


def sets(t):
    n = " ".join(t.lower().split())
    p = f"  {n}  "
    return n, set("".join(c if c.isalnum() else " " for c in n).split()), {p[i : i + 3] for i in range(len(p) - 2)}


def severity(s, t):
    (n1, a, x), (n2, b, y) = sets(s), sets(t)
    tok, tri = (round(len(p & q) / len(p | q), 6) for p, q in ((a, b), (x, y)))
    return "exact_duplicate" if n1 == n2 else "high_confidence_near_duplicate" if tok >= 0.75 and tri >= 0.72 else "semantic_watchlist" if tok >= 0.6 or tri >= 0.68 else None


def test_whole_conversations(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=70)) for _ in range(25)]
    texts += [texts[0]] * 3 + [texts[1].upper(), texts[2] + " more"]  # copies, and one that is nearly a copy
    half = texts[3].split()
    texts += [" ".join(half[:60] + rng.choices(words, k=12))]
    rows = [(i, 0, t) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, (90, 1, None), (91, 1, None)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(0, texts[4]), (1, "other words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {i * 100: t for i, t in enumerate(texts)}
    right = left | {-1: texts[4], -2: "other words"}
    want = {(i, j): v for i in left for j in right if (v := severity(left[i], right[j]))}
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    got = run("conversation_leakage_pairs")
    assert len(got) == len(want) and {(r["left_id"], r["right_id"]): r["severity"] for r in got} == want
    assert {want[0, j] for j in (2500, 2600, 2700)} == {"exact_duplicate"}
    risk = run("conversation_leakage_risk")[0]
    counts = [sum(v == s for v in want.values()) for s in ("exact_duplicate", "high_confidence_near_duplicate", "semantic_watchlist")]
    assert [risk["exact"], risk["near"], risk["watch"]] == counts and risk["watch_right"] == len({j for (_, j), v in want.items() if v == "semantic_watchlist"})
    of = {i: i for i in left}
    for _ in left:
        for i, j in itertools.combinations(left, 2):
            if want.get((i, j), "semantic_watchlist") != "semantic_watchlist":
                of[i] = of[j] = min(of[i], of[j])
    components = {r["id"]: r["component"] for r in run("conversation_components")}
    assert components == of | {9001: 9001, 9101: 9101}
    members = {r["component"]: r["members"] for r in run("conversation_component_keys")}
    assert members[0] == 4 and sum(members.values()) == len(texts) + 2
