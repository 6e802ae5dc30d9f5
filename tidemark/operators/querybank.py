"""Query banks: judged queries, candidates and boundary queries, their summaries and manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import boolish, canonical_json, json_field, query_slices, source_ref, squeeze
from tidemark.functions.vectors import hash_fraction, subset_tag
from tidemark.operators import leakage
from tidemark.operators.fingerprints import merkle_tree, root
from tidemark.operators.ordering import ensure_checkpoint_dir, placed

LABEL_WEIGHTS = {"E": 3.0, "S": 2.0}


def label_weight(label: Column, weights: dict[str, float] | None = None) -> Column:
    """A label's grade; null for a label without one."""
    out = F.lit(None).cast("double")
    for name, w in (weights or LABEL_WEIGHTS).items():
        out = F.when(label == name, F.lit(float(w))).otherwise(out)
    return out


def judged_queries(judgments: DataFrame, corpus: DataFrame, least_items: int = 1) -> DataFrame:
    """For each split and query, its graded products in the corpus, as a map, and the labels seen.

    ``judgments``: ``split, query, product_id, label``; products judged twice keep the
    higher grade.  Queries with fewer than ``least_items`` products go.
    """
    rows = judgments.withColumn("grade", label_weight(F.col("label"))).where("grade is not null").join(corpus.select("product_id").distinct(), "product_id", "left_semi")
    graded = rows.groupBy("split", "query", "product_id").agg(F.max("grade").alias("grade"), F.collect_set("label").alias("labels"))
    out = graded.groupBy("split", "query").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("product_id", "grade")))).alias("relevant_items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"), F.count("*").alias("n_relevant"), F.sum("grade").alias("grade_mass"))
    return out.where(F.col("n_relevant") >= least_items)


def candidate_rows(rows: DataFrame, locale: str | None = None, need_large: bool = False, need_small: bool = False) -> DataFrame:
    """rows of a locale (in any case), and in the large or small version where that is asked for.

    Flags may be booleans, numbers or words for them; a column that is not there asks for nothing.
    """
    if locale is not None:
        rows = rows.where(F.lower(F.trim(F.coalesce("locale", F.lit("")))) == locale.lower())
    for need, column in ((need_large, "large_version"), (need_small, "small_version")):
        if need and column in rows.columns:
            rows = rows.where(F.coalesce(boolish(F.col(column)), F.lit(False)))
    return rows


def retained_buckets(judgments: DataFrame, corpus: DataFrame, least_items: int = 1, max_queries: int | None = None) -> DataFrame:
    """``split, source_query_id, text, relevant_items, labels, n_relevant, first_row`` of the queries that keep enough products.

    ``judgments``: ``row_id`` (the place in the source), ``split, source_query_id, query,
    product_id, label``.  With ``max_queries``, the first in the order of the source.
    """
    rows = judgments.withColumn("grade", label_weight(F.col("label")))
    seen = rows.groupBy("split", "source_query_id").agg(F.min("row_id").alias("first_row"), F.min_by("query", "row_id").alias("text"))
    kept = rows.where("grade is not null").join(corpus.select("product_id").distinct(), "product_id", "left_semi")
    graded = kept.groupBy("split", "source_query_id", "product_id").agg(F.max("grade").alias("grade"), F.collect_set("label").alias("labels"))
    out = graded.groupBy("split", "source_query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("product_id", "grade")))).alias("relevant_items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"), F.count("*").alias("n_relevant"))
    out = out.where(F.col("n_relevant") >= least_items).join(seen, ["split", "source_query_id"])
    return out if max_queries is None else out.orderBy("first_row").limit(max_queries)


def overlap_bank(judgments: DataFrame, corpus: DataFrame, least_items: int = 1, max_queries: int | None = None, train_tags: tuple[str, ...] = ("gate_calibration",), source: str = "judgments") -> DataFrame:
    """The query bank of judged queries that a corpus can answer.

    Filter and grade (J2, A32), keep the first in source order (K9), join test queries that
    paraphrase each other into components (P6), give each component a subset by a hash of its
    texts (M8, M4, M5) and number the rows in source order (W9).  Queries of other splits get
    ``train_tags``.  Provenance is a JSON object beside each row.
    """
    buckets = retained_buckets(judgments, corpus, least_items, max_queries).withColumn("id", F.concat_ws(":", "split", "source_query_id"))
    ensure_checkpoint_dir(judgments.sparkSession)
    buckets = buckets.checkpoint()  # used for pairs, components and rows
    test = buckets.where("split = 'test'").select("id", "text")
    judged, members, _ = leakage.flagged_classes(test, test, "id", "id", same=True)
    labels = leakage.components(test, leakage.class_links(judged, members))
    keys = leakage.component_keys(labels, test.select("id", squeeze(F.lower("text")).alias("norm")))
    assigned = labels.join(keys, "component").select("id", F.col("component").alias("anchor"), F.col("members").alias("component_size"), "component_id", "assignment_key")
    rows = buckets.join(assigned, "id", "left")
    fraction = hash_fraction(F.col("assignment_key"))
    tags = F.when(F.col("split") == "test", F.array(subset_tag(fraction))).otherwise(F.array(*[F.lit(t) for t in train_tags]))
    rows = numbered(rows.drop("relevant_items"), "qb", ["first_row", "id"]).join(buckets.select("id", "relevant_items"), "id")
    provenance = canonical_json(
        schema_version=F.lit("1"), origin_family=F.lit("judged_queries"), curation_mode=F.lit("automatic"),
        upstream_source=F.struct(F.lit(source).alias("dataset_name"), F.col("split").alias("source_split")), selection=F.struct(F.lit(least_items).alias("min_relevant_items"), F.lit("corpus_overlap").alias("policy")),
        subset_assignment=F.struct("assignment_key", "component_id", "component_size", F.lit("component_hash").alias("policy")), labels_observed=F.col("labels"),
    )
    return rows.select(
        "query_id", "text", F.lit("judged_overlap").alias("source_type"), F.lit(True).alias("active"), F.concat_ws(":", F.lit(source), F.concat(F.lit("split="), "split"), F.concat(F.lit("query_id="), F.col("source_query_id").cast("string"))).alias("source_ref"),
        F.lit("answerable").alias("answerability"), tags.alias("subset_tags"), "relevant_items", provenance.alias("provenance"),
    )


def bootstrap_rows(ranked_candidates: DataFrame, file: str, subset_tags: tuple[str, ...] = (), active: bool = False) -> DataFrame:
    """Candidates (``text, record_count, query_ids, first_row``) as bank rows, most records first, with where they come from."""
    rows = numbered(ranked_candidates, "qc", [F.desc("record_count"), F.lower("text"), "text"], digits=4)
    lineage = F.to_json(F.struct("record_count", "query_ids", "first_row"))
    return rows.select(
        "query_id", "text", F.lit("candidate").alias("source_type"), F.lit(active).alias("active"), source_ref(F.lit(file), F.col("first_row"), F.col("query_ids")).alias("source_ref"),
        F.array(*[F.lit(t) for t in subset_tags]).cast("array<string>").alias("subset_tags"), lineage.alias("candidate_lineage"),
    )


def surfaces(bank: DataFrame, specs: dict[str, tuple[str, ...]]) -> DataFrame:
    """``surface, query_id, text``: the rows with any of a surface's tags, an id once (the least text) for each surface."""
    names = F.array_compact(F.array(*[F.when(F.arrays_overlap("subset_tags", F.array(*[F.lit(t) for t in tags])), F.lit(name)) for name, tags in specs.items()]))
    return bank.select(F.explode(names).alias("surface"), "query_id", "text").groupBy("surface", "query_id").agg(F.min("text").alias("text"))


def unique_or_error(values: Column, what: str = "value") -> Column:
    """The array if nothing in it repeats, else an error when it is read; ``F.array_distinct`` is the silent form."""
    return F.when(F.size(F.array_distinct(values)) == F.size(values), values).otherwise(F.raise_error(F.lit(f"repeated {what}")).cast("array<string>"))


def eval_cases(bank: DataFrame, tag: str) -> DataFrame:
    """Bank rows of a subset as evaluation cases, with the slices of their text and the compact provenance."""
    rows = bank.where(F.coalesce("active", F.lit(True)) & F.array_contains("subset_tags", tag) & (F.size(F.map_keys("relevant_items")) > 0))
    paths = {
        "origin_family": ("origin_family",), "curation_mode": ("curation_mode",), "source_dataset": ("source_dataset", "upstream_source.dataset_name"), "source_split": ("source_split", "upstream_source.source_split"),
        "selection_policy": ("selection_policy", "selection.policy"), "subset_assignment_policy": ("subset_assignment_policy", "subset_assignment.policy"),
    }
    return rows.select("query_id", F.col("text").alias("query"), "relevant_items", "source_type", "subset_tags", query_slices(F.col("text")).alias("query_slice_tags"), *[json_field(F.col("provenance"), *p).alias(n) for n, p in paths.items()])


def numbered(rows: DataFrame, prefix: str, order: list[Column | str], name: str = "query_id", digits: int = 5) -> DataFrame:
    """Ids ``prefix_00001`` on, in the given order; every row gets one, rows with null keys too."""
    return placed(rows, order, "__i").withColumn(name, F.format_string(f"{prefix}_%0{digits}d", F.col("__i").cast("long"))).drop("__i")


def candidates(rows: DataFrame, max_queries: int | None = None) -> DataFrame:
    """One row a query text with its number of records and sorted labels and locales; most records first."""
    out = rows.where(F.trim("text") != "").groupBy("text").agg(F.count("*").alias("record_count"), F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_set("locale")).alias("locales"), F.min("row_id").alias("first_row"))
    return out if max_queries is None else out.orderBy(F.desc("record_count"), F.lower("text"), "text").limit(max_queries)


def boundary_bank(manual: DataFrame) -> DataFrame:
    """Manual boundary queries as bank rows, with a tag for each thing that is known of them."""
    known = [F.concat(F.lit("boundary_type:"), "boundary_type"), F.concat(F.lit("evaluation_surface:"), "evaluation_surface"), F.concat(F.lit("behavior:"), "expected_behavior")]
    if "challenge_family" in manual.columns:
        known.append(F.concat(F.lit("challenge_family:"), "challenge_family"))
    tags = F.array_compact(F.array(F.lit("boundary_eval"), *known))
    if "challenge_tags" in manual.columns:
        tags = F.concat(tags, F.transform(F.coalesce("challenge_tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("challenge_tag:"), t)))
    return manual.select(F.col("manual_id").alias("query_id"), "text", F.lit("manual_boundary").alias("source_type"), tags.alias("subset_tags"))


def union_banks(judged: DataFrame, boundary: DataFrame) -> DataFrame:
    """All rows of both, one row an id, the judged one first."""
    both = judged.withColumn("__o", F.lit(0)).unionByName(boundary.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("query_id").orderBy("__o", "text")
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__o", "__r")


#: Prefixes of tags that are counted by what follows them.
TAG_PREFIXES = {"boundary_type": "boundary_type:", "behavior": "behavior:", "evaluation_surface": "evaluation_surface:", "challenge_family": "challenge_family:", "challenge_tag": "challenge_tag:"}


def bank_summary(bank: DataFrame) -> DataFrame:
    """``kind, value, queries``: rows by source type, answerability, tag, what follows a tag's prefix, and what their provenance says.

    Columns that the bank lacks are counted as null, that is, not at all.
    """
    there = set(bank.columns)
    col = lambda c, t="string": F.col(c) if c in there else F.lit(None).cast(t)
    one = lambda kind, value: F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    tags = F.coalesce(col("subset_tags", "array<string>"), F.array().cast("array<string>"))
    said = col("provenance")
    ref = col("source_ref")
    split = F.coalesce(F.lower(json_field(said, "upstream_source.source_split")), F.when(F.contains(ref, F.lit(":split=train:")), "train").when(F.contains(ref, F.lit(":split=test:")), "test"))
    single = [one("source_type", col("source_type")), one("answerability", col("answerability")), one("source_split", split), one("has_provenance", F.when(said.isNotNull(), F.lit("true")))]
    single += [one(k, json_field(said, p)) for k, p in (("schema_version", "schema_version"), ("origin_family", "origin_family"), ("curation_mode", "curation_mode"), ("selection_policy", "selection.policy"), ("subset_assignment_policy", "subset_assignment.policy"))]
    lists = [F.transform(F.array_distinct(tags), lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("value")))]

    def prefixed(kind: str, prefix: str) -> Column:
        own = F.filter(F.array_distinct(tags), lambda t: F.startswith(t, F.lit(prefix)))
        return F.transform(own, lambda t: F.struct(F.lit(kind).alias("kind"), F.substring(t, F.lit(len(prefix) + 1), F.length(t)).alias("value")))

    lists += [prefixed(k, p) for k, p in TAG_PREFIXES.items()]
    pairs = F.concat(F.array_compact(F.array(*single)), *lists)
    return bank.select("query_id", F.explode(pairs).alias("p")).groupBy(F.col("p.kind").alias("kind"), F.col("p.value").alias("value")).agg(F.count_distinct("query_id").alias("queries"))


def relevance_summary(bank: DataFrame) -> DataFrame:
    """One row: queries, those with relevant items, and the least, median and greatest number of those."""
    n = F.when(F.col("relevant_items").isNotNull(), F.size(F.map_keys("relevant_items")))
    zero = F.lit(0)
    return bank.agg(F.count("*").alias("total_queries"), F.count(n).alias("with_relevant_items"), F.coalesce(F.min(n), zero).cast("long").alias("min_items"), F.coalesce(F.percentile(n, 0.5), F.lit(0.0)).alias("median_items"), F.coalesce(F.max(n), zero).cast("long").alias("max_items"))


def bank_digest(bank: DataFrame) -> DataFrame:
    """One row: ``rows, sha256`` of the bank's ids, texts and tags, in order of ids, by buckets, so that no task sees all."""
    line = F.sha2(canonical_json(query_id=F.col("query_id"), text=F.col("text"), subset_tags=F.col("subset_tags")), 256)
    rows = bank.select(line.alias("h")).groupBy(F.substring("h", 1, 3).alias("b")).agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary")).alias("d"))
    return rows.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("sha256"))


def manifest(bank: DataFrame, anchor: DataFrame, risk: DataFrame | None = None) -> DataFrame:
    """One row, ``manifest``, a JSON object: the bank's digest and counters, the corpus it was built against, and what a leakage audit said.

    ``anchor``: the row of ``corpus_anchor``; ``risk``: the row of ``leakage.matrix_risk``.
    """
    counts = bank_summary(bank).groupBy().agg(F.array_sort(F.collect_list(F.struct("kind", "value", "queries"))).alias("counters"))  # a row a counter
    row = bank_digest(bank).join(F.broadcast(counts)).join(F.broadcast(relevance_summary(bank))).join(F.broadcast(anchor))
    fields = {
        "dataset_name": F.lit("query_bank"), "status": F.lit("ready"), "query_bank_sha256": F.col("sha256"), "canonical_row_count": F.col("rows"), "counters": F.col("counters"),
        "min_relevant_items": F.col("min_items"), "median_relevant_items": F.col("median_items"), "max_relevant_items": F.col("max_items"), "corpus_fingerprint": F.col("fingerprint"), "corpus_product_count": F.col("products"),
    }
    if risk is not None:
        row = row.join(F.broadcast(risk))
        fields["overall_risk_level"] = F.col("overall_risk_level")
    return row.select(canonical_json(**fields).alias("manifest"))


def corpus_anchor(rows: DataFrame, product: str = "product_id") -> DataFrame:
    """Number of products, null for none, and a fingerprint of the trimmed, distinct ids: the root of their Merkle tree."""
    return root(merkle_tree(rows, product)).select(F.nullif(F.col("n"), F.lit(0)).alias("products"), "fingerprint")


def duplicate_ids(bank: DataFrame, key: str = "query_id") -> DataFrame:
    """Ids that are there more than once; an empty result passes."""
    return bank.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
