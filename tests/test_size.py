"""What queries leave on disk and how they join, where no table is small enough for Spark to broadcast by itself."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import graph
from corpusgraph.plans import catalog
from corpusgraph.plans.registry import Tables
from corpusgraph.sources import scratch


@pytest.fixture
def nothing_small(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def size(path):
    at = Path(path)
    return sum(x.stat().st_size for x in ([at] if at.is_file() else at.rglob("*.parquet")))


def left(spark, name, folder):
    """Bytes of the working tables that a query wrote, and its plan."""
    scratch.new_path(spark, "start")
    before = set(scratch._made[spark.sparkContext.applicationId])
    df = catalog.QUERIES[name](spark, folder)
    df.collect()
    made = set(scratch._made[spark.sparkContext.applicationId]) - before
    return sum(size(x.removeprefix("file:")) for x in made), df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ret2_bm25_search", "ret5_rrf_fuse", "ret6_rerank", "evl1_hit_precision_recall", "evl2_mrr", "evl3_ndcg", "evl5_evaluate", "evl6_compare_runs"])
def test_a_search_stores_less_than_its_texts(spark, sf, nothing_small, name):
    assert left(spark, name, sf)[0] < size(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", ["ret6_rerank", "evl4_keyword_coverage"])
def test_texts_stay_where_they_lie(spark, sf, nothing_small, name):
    assert "SortMergeJoin" not in left(spark, name, sf)[1]


def test_gold_moves_no_text(spark, sf, nothing_small):
    gold = Tables(spark, sf).q_gold
    stored = [x for x in scratch._made[spark.sparkContext.applicationId] if "/gold-" in x]
    assert gold.count() and stored and "SortMergeJoin" not in gold._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, most", [("g_relations", 5), ("g_chunks", 4)])
def test_views_are_dealt_once_by_order(spark, sf, nothing_small, name, most):
    assert getattr(Tables(spark, sf), name)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= most


def test_names_of_many_terms_meet_as_equal_pieces(spark):
    # the first three characters are in every name: candidates by them would be all pairs
    names = spark.range(3000).select(F.lit(1).cast("long").alias("user_id"), F.format_string("aaa%05dB", "id").alias("name"), F.lit("T").alias("type"))
    terms = names.select("user_id", F.expr("explode(array(name, substring(name, 1, 8), upper(substring(name, 3, 4)), 'aAa', concat(name, 'c'), ''))").alias("term"))
    got = {(r.term, r.name, r.rank) for r in graph.search_entities(names, terms, 3).collect()}
    held = [f"aaa{i:05d}B" for i in range(3000)]
    want = set()
    for term in {x for n in held for x in (n, n[:8], n[2:6].upper(), "aAa", n + "c", "")}:
        want |= {(term, n, k) for k, n in enumerate([n for n in held if term.lower() in n.lower()][:3], 1)}
    assert got == want


@pytest.mark.parametrize("name", ["grf3_related_entities", "ret9_enrich"])
def test_paths_of_two_hops_are_not_stored(spark, sf, name):
    scratch.new_path(spark, "start")
    before = len(scratch._made[spark.sparkContext.applicationId])
    catalog.QUERIES[name](spark, sf)
    made = [x.rsplit("/", 1)[1].split("-")[0] for x in scratch._made[spark.sparkContext.applicationId][before:]]
    assert "adjacency" in made and "hop" not in made
