"""Every copy of a document has a training position."""

from tidemark.llm import mixing


def test_every_copy_is_placed(spark, docs):
    rows = docs([(i, "w " * (i % 5), None, "a" if i < 30 else "b") for i in range(200)])
    plan = {r["doc_id"]: r for r in mixing.plan_mix(rows).collect()}
    order = mixing.training_order(mixing.plan_mix(rows)).collect()
    words, places = {}, {}
    for r in order:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["words"]
        places.setdefault(r["doc_id"], []).append(r["position"])
        assert 0 < r["words"] <= r["size"] and 0 <= r["position"] <= 1
    assert words == {i: r["taken"] for i, r in plan.items() if r["taken"]}
    assert all(p == sorted(p) == plan[i]["positions"] and p[0] == plan[i]["position"] for i, p in places.items())
    assert all(plan[i]["positions"] == [] for i in plan if not plan[i]["taken"])
    # source a is taken twice: at any time as many of its words are placed as its schedule wants
    a = [r for r in order if r["doc_id"] < 30]
    target = plan[1]["target"]
    assert target == 2 * plan[1]["source_size"]
    for t in (0.25, 0.5, 0.75, 1.0):
        assert abs(sum(r["words"] for r in a if r["position"] < t) / target - (t + t * t) / 2) < 0.06
