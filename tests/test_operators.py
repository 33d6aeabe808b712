"""Joins, graph edits, reports and streams on small tables, and queries against DuckDB."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusgraph.operators import ann, chat, graph, lifecycle, reports, search, vectors
from corpusgraph.plans import catalog
from corpusgraph.streaming import jobs

SF = "/root/testdata/sf0.001"
COMPARED = [
    "chk2_sections", "chk4_split_text", "chk5_add_overlap", "chk6_chunk_documents", "cht1_history", "cht2_citation_context", "cht5_graph_facts", "emb2_vector_search", "emb4_chunk_context", "evl3_ndcg", "evl5_evaluate", "ext2_parse_extraction",
    "grf3_related_entities", "grf7_related_documents", "grf10_entity_categories", "grf13_merge_entities", "grf14_delete_documents", "rep3_entity_timeline", "rep4_visible_curve", "rep6_recent_activity", "rep9_monthly_growth", "rep11_document_detail",
    "ret2_bm25_search", "ret5_rrf_fuse", "ret9_enrich", "ret10_retrieve", "ret11_graph_query", "ret7_section_siblings", "snk2_rebuild_vectors", "str1_fold_status", "str1_fold_status_stream", "str2_reconcile", "str2_reconcile_stream", "str3_progress", "str4_throttle", "str5_ingest_stream", "txt6_clip",
]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    return None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    found = duck.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == sorted(df.columns)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=str)


def test_entry_and_names(spark):
    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_bm25_small(spark):
    chunks = spark.createDataFrame([(1, "c1", "知识图谱 系统"), (1, "c2", "另一个 文档"), (1, "c3", "机器学习 研究"), (2, "c1", "知识图谱 系统")], "user_id long, chunk_id string, content string")
    asked = spark.createDataFrame([(1, 1, "知识"), (1, 2, ""), (3, 3, "知识")], "user_id long, query_id long, query_text string")
    assert rows(search.bm25_search(asked, search.bm25_index(chunks)), "user_id", "query_id", "chunk_id", "rank") == [(1, 1, "c1", 1)]


def test_fusion(spark):
    hits = [(1, 1, 0, "v", 1.0, 1, "a"), (1, 1, 0, "v", 1.0, 2, "b"), (1, 1, 1, "k", 2.0, 1, "b"), (1, 1, 1, "k", 2.0, 2, "b"), (1, 1, 1, "k", 2.0, 3, None)]
    got = search.rrf_fuse(spark.createDataFrame(hits, "user_id long, query_id long, list_no int, label string, weight double, rank long, chunk_id string")).orderBy("rank").collect()
    assert [(r.chunk_id, list(r.sources), r["rank"]) for r in got] == [("b", ["v", "k"], 1), ("a", ["v"], 2)]
    assert got[0].score == pytest.approx(1 / 62 + 2 / 61 + 2 / 62, abs=1e-8)


def test_vector_search_keeps_users_apart(spark):
    held = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0]), (2, "c", [1.0, 0.0]), (1, "n", None)], "user_id long, chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, 7, [1.0, 0.1])], "user_id long, query_id long, embedding array<double>")
    assert rows(vectors.vector_search(asked, held, 5), "chunk_id", "rank") == [("a", 1), ("b", 2)]
    near = ann.approximate_search(asked, ann.build_index(held, cells=2, groups=2), 1, probes=2)
    assert rows(near, "user_id", "chunk_id") == [(1, "a")]


def test_embedding_cache(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, "x y"), (3, "  "), (4, None), (5, "z")], "id int, content string")
    cache = spark.createDataFrame([("wrong", [1.0], "m")], "text_hash string, embedding array<float>, model string").unionByName(docs.where("id = 5").select(F.md5("content").alias("text_hash"), F.array(*[F.lit(9.0).cast("float")] * 4).alias("embedding"), F.lit("m").alias("model")))
    found, fresh = vectors.embed(docs, "content", cache, "m", 4)
    got = {r.id: r.embedding for r in found.collect()}
    assert got[1] == got[2] and got[3] == got[4] == [0.0] * 4 and got[5] == [9.0] * 4 and fresh.count() == 1


def test_map_has_no_point_for_one(spark):
    one = spark.createDataFrame([(1, "a", [1.0, 2.0])], "user_id long, document_id string, centroid array<double>")
    assert vectors.cluster_map(one).count() == 0
    many = spark.createDataFrame([(1, "a", [1.0, 0.0, 0.0]), (1, "b", [0.0, 1.0, 0.0]), (1, "c", [3.0, 3.0, 0.0])], one.schema)
    got = {r.document_id: (r.x, r.y) for r in vectors.cluster_map(many).collect()}
    assert len(set(got.values())) == 3 and abs(sum(x for x, _ in got.values())) < 1e-9


def graph_tables(spark):
    entities = spark.createDataFrame([(1, n, "X", None) for n in "ABCD"] + [(2, "A", "X", None)], "user_id long, name string, type string, description string")
    mentions = spark.createDataFrame([(1, "c1", "A"), (1, "c2", "A"), (1, "c2", "B"), (1, "c3", "C"), (2, "d1", "A")], "user_id long, chunk_id string, entity_name string")
    relations = spark.createDataFrame([(1, "A", "B", "USES"), (1, "A", "C", "USES"), (1, "C", "A", "OWNS"), (1, "B", "C", "USES"), (1, "D", "D", "USES")], "user_id long, source string, target string, relation_type string")
    return entities, mentions, relations


def test_merge(spark):
    entities, mentions, relations = graph_tables(spark)
    pairs = spark.createDataFrame([(1, "A", "B"), (1, "B", "C"), (1, "Q", "C"), (1, "D", "D")], "user_id long, source string, target string")
    out = graph.merge_entities(pairs, entities, mentions, relations)
    assert rows(out["entities"], "user_id", "name") == [(1, "C"), (1, "D"), (2, "A")]
    assert rows(out["mentions"], "user_id", "chunk_id", "entity_name") == [(1, "c1", "C"), (1, "c2", "C"), (1, "c3", "C"), (2, "d1", "A")]
    assert rows(out["relations"], "source", "target") == [("D", "D")]
    cycle = spark.createDataFrame([(1, "A", "B"), (1, "B", "A")], pairs.schema)
    assert graph.merge_entities(cycle, entities, mentions, relations)["entities"].count() == 5


def test_delete_documents_keeps_shared_entities(spark):
    entities, mentions, relations = graph_tables(spark)
    documents = spark.createDataFrame([(1, "x"), (1, "y")], "user_id long, id string")
    chunks = spark.createDataFrame([(1, "x", "c2"), (1, "y", "c1"), (1, "y", "c3")], "user_id long, document_id string, chunk_id string")
    ids = spark.createDataFrame([(1, "x"), (1, "nowhere")], "user_id long, document_id string")
    out = graph.delete_documents(ids, documents, chunks, mentions, entities, relations)
    assert rows(out["orphans"], "name") == [("B",)] and rows(out["entities"], "user_id", "name") == [(1, "A"), (1, "C"), (1, "D"), (2, "A")]
    assert rows(out["relations"], "source", "target") == [("A", "C"), ("C", "A"), ("D", "D")]


def brute_paths(edges, centre, depth):
    found = set()

    def walk(at, used, types):
        if types:
            found.add((len(types), at, tuple(types)))
        if len(types) < depth:
            for e in edges:
                if e not in used:
                    for a, b in {(e[0], e[1]), (e[1], e[0])}:
                        if a == at:
                            walk(b, used | {e}, [*types, e[2]])

    walk(centre, frozenset(), [])
    return found


@pytest.mark.parametrize("depth", [1, 2, 3, 9])
def test_paths_equal_brute_force(spark, depth):
    entities, _, relations = graph_tables(spark)
    edges = [(r.source, r.target, r.relation_type) for r in relations.collect()]
    got, _ = graph.related_entities(entities.where("user_id = 1").select("user_id", F.col("name").alias("centre")), relations, depth, limit=1000)
    for c in "ABCD":
        assert {(r.hops, r.end, tuple(r.types)) for r in got.where(F.col("centre") == c).collect()} == brute_paths(edges, c, depth if depth < 4 else 2)


def test_paths_stop_where_a_centre_has_its_rows(spark):
    edges = [("H", f"n{i:02}", "USES") for i in range(12)] + [(f"n{i:02}", f"m{i:02}", "OWNS") for i in range(12)] + [("m00", "z", "USES")]
    relations = spark.createDataFrame([(1, *e) for e in edges], "user_id long, source string, target string, relation_type string")
    centres = spark.createDataFrame([(1, c) for c in ("H", "m00", "alone")], "user_id long, centre string")
    for limit in (1, 5, 12, 13, 20):
        got, _ = graph.related_entities(centres, relations, 3, limit)
        for c in ("H", "m00"):
            assert sorted((r.hops, r.end, tuple(r.types)) for r in got.where(F.col("centre") == c).collect()) == sorted(brute_paths(edges, c, 3))[:limit]
        assert [r.end for r in got.where("centre = 'alone'").collect()] == [None]


def test_names_containing_equals_brute_force(spark):
    names = [(1, "Anna Bell"), (1, "annabel"), (1, "Ünal"), (1, "ab"), (1, ""), (1, None), (2, "Anna Bell"), (1, "知识图谱")]
    terms = [(1, "ANNA"), (1, "ANNA"), (1, "b"), (1, "ab"), (1, ""), (1, None), (1, "bel"), (1, "zzz"), (2, "nna b"), (3, "a"), (1, "ü"), (1, "图谱"), (1, "annabella")]
    got = graph.names_containing(spark.createDataFrame(names, "user_id long, name string"), spark.createDataFrame(terms, "user_id long, term string"))
    want = [(u, n, t) for u, n in names for v, t in set(terms) if u == v and n is not None and t is not None and t.lower() in n.lower()]
    assert rows(got, "user_id", "name", "term") == sorted(want)


def test_status_fold_carries_its_state(spark):
    rng = random.Random(2)
    kinds = ["document_created", "indexed", "graphed", "ready", "failed", "pending", "unknown"]
    events = [(rng.choice([None, 1, 2, 3]), i, rng.randrange(40), rng.choice(kinds), "e") for i in range(500)]
    frame = spark.createDataFrame(events, "doc_id long, id long, ts long, status string, error_message string").repartition(5)
    small = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.doc_id: tuple(r)[1:] for r in lifecycle.fold_status(frame).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)
    for doc in (None, 1, 2, 3):
        own = sorted((x for x in events if x[0] == doc), key=lambda x: (x[2], x[1]))
        assert got[doc] == lifecycle.fold([(x[3], x[4]) for x in own])
    assert lifecycle.fold_status(frame.limit(0)).count() == 0


def test_build_graph(spark):
    stamped = spark.createDataFrame([(1, "c1", "A", "X", "old", 1), (1, "c2", "A", "Y", None, 2), (1, "c2", "a", None, None, 2)], "user_id long, chunk_id string, name string, type string, description string, updated_at int")
    chunks = spark.createDataFrame([(1, "d", "c1", None, "c2"), (1, "d", "c2", "c1", None)], "user_id long, document_id string, chunk_id string, prev_chunk_id string, next_chunk_id string")
    docs = spark.createDataFrame([(1, "d")], "user_id long, id string")
    relations = spark.createDataFrame([(1, "A", "a", "USES", {"k": "1", "j": "0"}, 1), (1, "A", "a", "USES", {"k": "2"}, 2), (1, "A", "Z", "USES", {}, 1)], "user_id long, source string, target string, relation_type string, properties map<string,string>, updated_at int")
    g = graph.build_graph(docs, chunks, stamped, relations)
    assert {(r.name, r.type, r.description) for r in g["entities"].collect()} == {("A", "Y", "old"), ("a", None, None)}
    assert [(r.target, r.properties) for r in g["relations"].collect()] == [("a", {"k": "2", "j": "0"})] and g["next"].count() == 1


def test_timeline_without_live_document(spark):
    entities = spark.createDataFrame([(1, n, "X") for n in "ABC"], "user_id long, name string, type string")
    mentions = spark.createDataFrame([(1, "A", "d1")] * 3 + [(1, "B", "gone")] * 7, "user_id long, entity_name string, document_id string")
    docs = spark.createDataFrame([(1, "d1", "T", "2025-10-15 00:00:00")], "user_id long, id string, title string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = {r.name: r for r in reports.entity_timeline(entities, mentions, docs).collect()}
    assert (got["B"].first_seen, got["B"].doc_count, got["B"].mention_count) == (None, 0, 7)
    assert (str(got["A"].first_seen.date()), got["A"].doc_count, got["A"]["rank"], got["C"].mention_count) == ("2025-10-15", 1, 1, 0)


def test_citations(spark):
    hits = spark.createDataFrame([(1, 1, 1, "c1", "d1", " body ", "A,B", 0.85), (1, 1, 2, "c2", "d2", "x" * 3000, "", None)], "user_id long, query_id long, rank long, chunk_id string, document_id string, content string, hierarchy_path string, relevance_score double")
    docs = spark.createDataFrame([(1, "d1", "My\n doc", "f.md")], "user_id long, id string, title string, original_filename string")
    sources, context = chat.citations(hits, docs)
    got = sources.orderBy("number").collect()
    assert (got[0].quality, got[0].path, got[1].title, got[1].truncated, len(got[1].content)) == ("high", ["A", "B"], "Untitled", True, 2001)
    assert context.first().context == "[Context 1] (from: My doc) (relevance: high)\nbody\n\n[Context 2] (from: Untitled)\n" + "x" * 600 + "…"


def test_users_alone_and_together(spark):
    t = catalog.QUERIES
    together = {tuple(r) for r in t["grf6_doc_entities"](spark, SF).collect()}
    from corpusgraph.plans.views import view

    mentions, entities = view(spark, SF, "g_mentions"), view(spark, SF, "g_entities")
    alone = graph.doc_entities(entities.where("user_id = 3"), mentions.where("user_id = 3")).select("user_id", "document_id", "name", "type", "mentions", "rank")
    cols = t["grf6_doc_entities"](spark, SF).columns
    assert {tuple(r[c] for c in cols) for r in alone.collect()} == {x for x in together if x[cols.index("user_id")] == 3}


def brute_throttle(requests, most, window):
    out, held = {}, {}
    for key, i, t in sorted(requests, key=lambda r: (r[2], r[1])):
        live = [x for x in held.get(key, []) if x > t - window]
        out[i] = len(live) < most
        held[key] = [*live, t] if out[i] else live
    return out


def test_throttle(spark):
    rng = random.Random(1)
    requests = [(rng.randrange(3), i, float(rng.randrange(200))) for i in range(300)]
    frame = spark.createDataFrame(requests, "key long, id long, t double").repartition(7)
    got = lifecycle.throttle(frame, 4, 30).collect()
    assert {r.id: r.allowed for r in got} == brute_throttle(requests, 4, 30) and all((r.retry_after == 0) == r.allowed for r in got)


def test_streams_equal_batch(spark):
    q = catalog.QUERIES
    assert rows(q["str4_throttle_stream"](spark, SF), "id", "allowed", "retry_after") == rows(q["str4_throttle"](spark, SF), "id", "allowed", "retry_after")
    assert rows(q["str3_latest_progress_stream"](spark, SF), "doc_id") == rows(q["str3_progress"](spark, SF), "doc_id")
    assert rows(q["str6_upload_volume_stream"](spark, SF), "user_id", "day", "documents") == rows(q["str6_upload_volume"](spark, SF), "user_id", "day", "documents")


def test_stream_over_several_batches(spark, tmp_path):
    schema = "doc_id long, id long, ts timestamp, status string, error_message string"
    steps = ["document_created", "indexed", "failed", "pending", "graphed", "ready", "indexed"]
    for i, s in enumerate(steps):
        spark.createDataFrame([(1, i, None, s, "e" if s == "failed" else None)], schema).withColumn("ts", F.timestamp_seconds(F.lit(i))).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = jobs.run_once(jobs.fold_status_stream(stream), str(tmp_path / "work"), "update", "doc_id").collect()
    assert [(r.status, r.error_message, r.applied, r.rejected) for r in got] == [("ready", None, 6, 1)]


def test_embedding_query_equals_plain_hashing(spark):
    from corpusgraph.plans.views import view

    texts = {r.id: r.content for r in view(spark, SF, "t_documents").collect()}
    got = {r.id: (r.dim, r.norm) for r in catalog.QUERIES["emb1_cached_embedding"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, x in texts.items():
        vector = vectors.feature_hashing([x], 64)[0].astype("float32") if x and x.strip() else [0.0] * 64
        assert got[i][0] == 64 and got[i][1] == pytest.approx(sum(float(v) ** 2 for v in vector), abs=2e-4)


def test_map_equals_a_full_decomposition(spark):
    import numpy as np

    from corpusgraph.plans.views import view

    held = view(spark, SF, "v_vectors").collect()
    got = {(r.user_id, r.document_id): (r.x, r.y) for r in catalog.QUERIES["emb6_cluster_map"](spark, SF).collect()}
    for user in {r.user_id for r in held}:
        own = [r for r in held if r.user_id == user]
        m = np.array([r.embedding for r in own], dtype=float)
        m -= m.mean(axis=0)
        axes = np.linalg.svd(m, full_matrices=False)[2][:2]
        axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(axis=1)])[:, None]
        points = np.array([got[(user, r.chunk_id)] for r in own])
        assert np.allclose(points, m @ axes.T, atol=1e-6) and abs(points[:, 0] @ points[:, 1]) < 1e-6


def test_gold_of_short_passages(spark):
    from corpusgraph.plans.views import view
    from corpusgraph.sources import scratch

    folder = scratch.new_path(spark, "gold")
    texts = ["one", "two words", "three short words", "a passage of four", "the five words of it", "this one has six words", "and this passage has a few more words"]
    docs = [(i, f"before{x}after {'filler ' * i}", "en", "src1", 1) for i, x in enumerate(texts)] + [(90, "nothing", "en", "src1", 1), (91, None, "en", "src1", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {(r.case_id, int(r.chunk_id)) for r in view(spark, folder, "q_gold").collect()}
    assert got == {(i, d[0]) for i, x in enumerate(texts) for d in docs if d[1] and x in d[1]}


def test_private_columns_and_clearing(spark):
    from corpusgraph.sources import scratch, tables

    old = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "x")], "chunk_id string, side int, updated_at int, rank string")
    new = spark.createDataFrame([("a", 2, 0, "y")], old.schema)
    assert rows(tables.upsert_chunks(new, old), "chunk_id", "side", "rank") == [("a", 2, "y"), ("b", 1, "x")]
    assert rows(tables.upsert_chunks(new, old, keep="old"), "chunk_id", "side") == [("a", 1), ("b", 1)]
    kept = dict(scratch._made)
    scratch._made.clear()
    path = scratch.new_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert scratch.clear(spark) == 1 and scratch.clear(spark) == 0
    scratch._made.update(kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
