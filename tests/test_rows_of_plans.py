"""No step of an evaluation or calibration query has a row for each query and product of its label."""

import pytest

from tidemark.operators import calibration
from tidemark.plans import fixtures, registry

POINTS, QUERIES = 4000, 80


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """One label for all points, so that every product is judged for every query; texts too short for the gate."""
    path = tmp_path_factory.mktemp("one_label")
    points = [(i, [float(i * 37 % 101), float(i * 53 % 97), 1.0], 1) for i in range(POINTS)]
    spark.createDataFrame(points, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(path / "embeddings.parquet"))
    spark.createDataFrame([(i, "short") for i in range(POINTS)], "doc_id long, text string").coalesce(1).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, i % 50, 1.0, "2024-01-01") for i in range(200)], "l_orderkey long, l_partkey long, l_quantity double, l_shipdate string").coalesce(1).write.parquet(str(path / "lineitem.parquet"))
    return str(path)


def nodes(plan):
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        yield from nodes(plan.executedPlan())
        return
    if "QueryStage" in name:
        yield from nodes(plan.plan())
        return
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def counts(df, metric: str) -> dict[str, int]:
    out = {}
    for i, p in enumerate(nodes(df._jdf.queryExecution().executedPlan())):
        m = p.metrics().get(metric)
        if m.isDefined():
            out[f"{i} {p.nodeName()}"] = m.get().value()
    return out


@pytest.mark.parametrize("name", [
    "observations", "calibration_dataset_rows", "gate_holdout_comparison", "gate_threshold_grid", "weight_sweep", "retrieval_report", "bootstrap_ci", "hit_list", "retrieval_config_comparison",
    "gate_threshold_comparison", "calibration_dataset_summary", "gate_recommended_threshold", "gate_bootstrap", "full_report",
])
def test_rows(spark, sf, name):
    """``observations`` is what ``dataset_round_trip`` writes."""
    df = registry._observations(spark, sf) if name == "observations" else registry.queries()[name](spark, sf)
    assert df.collect()
    rows = counts(df, "numOutputRows")
    assert max(rows.values()) < QUERIES * POINTS / 4, rows


def test_missed_items_are_not_shuffled(spark, sf):
    df = registry.queries()["missed_relevant_items"](spark, sf)
    got = {(r["query_id"], r["product_id"]): r["grade"] for r in df.collect()}
    long = {(r["query_id"], r["product_id"]): r["grade"] for r in fixtures.judgments(spark, sf).collect()}
    shown = {(r["query_id"], r["product_id"]) for r in registry._ranking(spark, sf).collect()}
    assert got == {k: g for k, g in long.items() if k not in shown} and len(got) > 70_000
    assert sum(counts(df, "shuffleRecordsWritten").values()) < len(got)


def test_rows_of_dataset_queries(spark, sf):
    """A dataset's row of each query, too, is worked out without a row for each of its products."""
    retrieved, attempted = registry._ranking(spark, sf, 20), registry._attempted(spark, sf)
    df, _ = calibration.dataset_rows(fixtures.shared_grades(spark, sf), retrieved, attempted)
    long, _ = calibration.dataset_rows(fixtures.judgments(spark, sf), retrieved, attempted)
    assert sorted(df.collect()) == sorted(long.collect())
    rows = counts(df, "numOutputRows")
    assert max(rows.values()) < QUERIES * POINTS / 8, rows
