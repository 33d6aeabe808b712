"""Search and graph operators where one key holds most rows, and approximate search against exact."""

from __future__ import annotations

import collections
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import segment
from corpusgraph.operators import ann, graph, search, vectors
from corpusgraph.sources import scratch


def tuples(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# --- keyword search by blocks


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    words = [f"w{k}x" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    rows = [(1, f"c{i:05d}", " ".join(["the", *rng.choices(words, weights, k=rng.choice([3, 20, 120]))])) for i in range(4000)]
    rows += [(2, f"d{i}", "the only words") for i in range(50)] + [(2, "empty", ""), (3, "x", None)]
    chunks = spark.createDataFrame(rows, "user_id long, chunk_id string, content string")
    asked = [(1, q, " ".join(["the", *rng.choices(words, k=3)])) for q in range(40)] + [(2, 1, "the words"), (2, 2, "nothing"), (3, 1, "the"), (1, 99, "the the w0x")]
    return scratch.written(chunks, "chunks"), spark.createDataFrame(asked, "user_id long, query_id long, query_text string")


def test_blocks_give_the_rows_of_all_postings(spark, corpus):
    chunks, asked = corpus
    plain = search.bm25_index(chunks)
    index = plain.written(scratch.new_path(spark, "index"), bucket=64)
    cols = ("user_id", "query_id", "chunk_id", "score", "rank")
    for k in (1, 10, 25):
        assert tuples(search.bm25_search(asked, index, k), *cols) == tuples(search.bm25_search(asked, plain, k), *cols)
    assert index.postings.groupBy("user_id", "term", "bucket").count().agg(F.max("count")).first()[0] <= 2 * 64  # the heaviest term is split
    assert tuples(index.terms, "user_id", "term", "df") == tuples(plain.terms, "user_id", "term", "df")


def test_fewer_postings_are_scored(spark, corpus):
    chunks, asked = corpus
    index = search.bm25_index(chunks).written(scratch.new_path(spark, "index"), bucket=64)
    tokens = asked.where("user_id = 1").select("user_id", "query_id", F.explode(F.split("query_text", " ")).alias("term")).groupBy("user_id", "query_id", "term").agg(F.count("*").alias("repeats"))
    weighed = scratch.written(tokens.join(index.terms, ["user_id", "term"]).select("user_id", "query_id", "term", (F.col("repeats") * F.col("idf")).alias("weight")), "asked")
    own = ["user_id", "query_id"]
    bounds = search._bounds(weighed, index, own)
    first = scratch.written(search._hits(weighed.withColumn("essential", F.lit(True)), bounds.where("rank <= 2"), index, own), "first")
    rest, needed = search._remaining(weighed, bounds, search._scored(first, index, own), index, 10, own, 2)
    every = bounds.agg(F.sum("postings")).first()[0]
    assert first.count() + search._hits(needed, rest, index, own).count() < 0.5 * every


# --- related documents


def brute_related(docs, mentions, limit):
    held = collections.defaultdict(set)
    for user, doc, name in mentions:
        held[(user, doc)].add(name)
    titles = {(u, i): t or i for u, i, t in docs}
    out = set()
    for (u, a), own in held.items():
        found = [(-len(own & other), titles[(v, b)], b) for (v, b), other in held.items() if u == v and a != b and own & other and (v, b) in titles]
        out |= {(u, a, b, -n, k) for k, (n, _, b) in enumerate(sorted(found)[:limit], 1)}
    return sorted(out)


@pytest.mark.parametrize("heavy", [1, 4, 12, 1000])
def test_related_documents_with_heavy_entities(spark, heavy):
    rng = random.Random(heavy)
    docs = [(u, f"d{i:03d}", rng.choice([None, "", "same", f"t{rng.randint(0, 9)}"])) for u in (1, 2) for i in range(70)]
    mentions = [(u, i, rng.choice(["all", *"abcdef", f"r{rng.randint(0, 60)}"])) for u, i, _ in docs for _ in range(rng.randint(0, 6))]
    mentions += [(1, f"d{i:03d}", "all") for i in range(60)] + [(1, "untitled", "all"), (1, "untitled", "a")]
    got = graph.related_documents(spark.createDataFrame(docs, "user_id long, id string, title string"), spark.createDataFrame(mentions, "user_id long, document_id string, entity_name string"), 5, heavy=heavy)
    want = [x for x in brute_related(docs, mentions, 5)]
    assert tuples(got, "user_id", "document_id", "other_id", "shared", "rank") == sorted(want, key=str)


def test_an_entity_in_100_000_documents(spark):
    docs = scratch.written(spark.range(100_000).select(F.lit(1).cast("long").alias("user_id"), F.format_string("d%06d", "id").alias("id"), F.lit(None).cast("string").alias("title")), "docs")
    number = F.substring("id", 2, 6).cast("int")
    every = docs.select("user_id", F.col("id").alias("document_id"), F.lit("everywhere").alias("entity_name"))
    half = docs.where(number % 2 == 0).select("user_id", F.col("id").alias("document_id"), F.lit("half").alias("entity_name"))
    pairs = docs.select("user_id", F.col("id").alias("document_id"), F.concat(F.lit("p"), (number / 2).cast("int").cast("string")).alias("entity_name"))
    start = time.monotonic()
    found = graph.related_documents(docs, every.unionByName(half).unionByName(pairs)).where(F.col("document_id").isin("d000000", "d000001", "d090000", "d090001")).collect()
    assert time.monotonic() - start < 240
    got = {(r.document_id, r["rank"]): (r.other_id, r.shared) for r in found}
    assert [got[("d090000", k)] for k in range(1, 6)] == [(f"d{i:06d}", 2) for i in (0, 2, 4, 6, 8)]
    assert [got[("d090001", k)] for k in range(1, 6)] == [("d090000", 2), *((f"d{i:06d}", 1) for i in range(4))]
    assert [got[("d000000", k)] for k in range(1, 6)] == [("d000001", 2), *((f"d{i:06d}", 2) for i in (2, 4, 6, 8))]


# --- paths through hubs


def test_paths_through_a_hub(spark):
    leaves = spark.range(200_000).select(F.lit(1).cast("long").alias("user_id"), F.lit("hub").alias("source"), F.format_string("n%06d", "id").alias("target"), F.lit("USES").alias("relation_type"))
    few = spark.createDataFrame([(1, f"c{i:03d}", "hub", "USES") for i in range(300)], leaves.schema)
    centres = few.select("user_id", F.col("source").alias("centre"))
    start = time.monotonic()
    rows, edges = graph.related_entities(centres, leaves.unionByName(few), 2, 100)
    got = collections.defaultdict(list)
    for r in rows.collect():
        got[r.centre].append((r.hops, r.end))
    assert time.monotonic() - start < 120
    first = [f"c{i:03d}" for i in range(101)]
    assert len(got) == 300
    for c in ("c000", "c050", "c299"):
        assert sorted(got[c]) == [(1, "hub"), *((2, x) for x in [x for x in first if x != c][:99])]


# --- approximate search


def recall(found, exact):
    want = collections.defaultdict(set)
    for r in exact.collect():
        want[(r.user_id, r.query_id)].add(r.chunk_id)
    got = collections.defaultdict(set)
    for r in found.collect():
        got[(r.user_id, r.query_id)].add(r.chunk_id)
    return sum(len(v & got[q]) for q, v in want.items()) / sum(map(len, want.values()))


def test_recall_of_the_inverted_file(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(60, 32))
    points = middles[rng.integers(0, 60, 6000)] + 0.3 * rng.normal(size=(6000, 32))
    held = spark.createDataFrame([(i % 2, f"v{i:05d}", [float(x) for x in p]) for i, p in enumerate(points)], "user_id long, chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(i % 2, i, [float(x) for x in points[i] + 0.1 * rng.normal(size=32)]) for i in range(0, 6000, 60)], "user_id long, query_id long, embedding array<double>")
    index = ann.build_index(held, cells=60, groups=8)
    exact = scratch.written(vectors.vector_search(asked, held, 10), "exact")
    assert recall(ann.approximate_search(asked, index, 10, probes=6), exact) >= 0.9
    assert recall(ann.approximate_search(asked, index, 10, probes=1), exact) < recall(ann.approximate_search(asked, index, 10, probes=20), exact)
    every = ann.approximate_search(asked, index, 10, probes=60, refine=0)
    assert recall(every, exact) > 0.999 and every.count() == exact.count()


def test_recall_on_the_table(spark, sf):
    from corpusgraph.plans.views import view

    held, asked = view(spark, "/root/testdata/sf0.01", "v_vectors"), view(spark, "/root/testdata/sf0.01", "v_queries")
    exact = scratch.written(vectors.vector_search(asked, held, 10), "exact")
    index = ann.build_index(held)
    assert recall(ann.approximate_search(asked, index, 10, probes=40, refine=20), exact) >= 0.9
    odd = held.unionByName(spark.createDataFrame([("null", 0, 0, "x", None), ("zero", 0, 0, "x", [0.0] * 64)], held.schema))
    assert ann.build_index(odd).entries.count() == held.count()


# --- words without spaces


def brute_cut(words, run):
    total = sum(words.values())
    best = None
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        parts, last = [], 0
        for k, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(run[last:k])
                last = k
        if all(p in words or len(p) == 1 for p in parts):
            score = sum(np.log(words.get(p, 1) / total) for p in parts)
            if best is None or score > best[0] + 1e-9:
                best = (score, parts)
    return best[0]


def test_the_most_probable_path():
    rng = random.Random(4)
    words = {"".join(rng.choices("abcd", k=rng.randint(1, 4))): rng.randint(1, 50) for _ in range(40)}
    held, total = segment.Dictionary(words), sum(words.values())
    runs = ["".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(200)]
    for run, cut in zip(runs, held.cut(runs), strict=True):
        assert "".join(cut) == run
        assert abs(sum(np.log(words.get(p, 1) / total) for p in cut) - brute_cut(words, run)) < 1e-9
    assert held.cut([]) == [] and held.cut(["zz"]) == [["z", "z"]]


def test_segmented_tokens_and_search(spark):
    words = {"知识": 50, "图谱": 40, "系统": 60, "支持": 30, "问答": 20, "知": 2, "机器": 30, "学习": 40, "机器学习": 10, "文档": 30, "我": 90, "的": 100}
    tokens = segment.word_tokens(words)
    frame = spark.createDataFrame([(1, 1, "知识图谱系统支持RAG问答"), (1, 2, "，。！？"), (1, 3, "我的文档"), (1, 4, None), (1, 5, "机器学习 and 学习")], "user_id long, chunk_id long, content string")
    got = {r.chunk_id: sorted(r.t) for r in frame.select("chunk_id", tokens(F.col("content")).alias("t")).collect()}
    assert got == {1: sorted(["rag", "知识", "图谱", "系统", "支持", "问答"]), 2: [], 3: ["文档"], 4: [], 5: sorted(["and", "机器学习", "学习"])}
    asked = spark.createDataFrame([(1, 1, "知识问答")], "user_id long, query_id long, query_text string")
    assert tuples(search.bm25_search(asked, search.bm25_index(frame, tokens), tokenizer=tokens), "chunk_id") == [(1,)]


def test_passages_are_cut_into_their_words(spark, sf):
    from corpusgraph.plans import catalog

    texts = {r.item_id: (r.text or "").lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    words = {w for x in texts.values() for w in re.findall("[a-z]+", x)}
    got = {r.item_id: r.words for r in catalog.QUERIES["txt1_word_tokens"](spark, sf).collect()}
    assert set(got) == set(texts)
    same = 0
    for i, x in texts.items():
        assert got[i].replace(" ", "") == "".join(re.findall("[a-z]+", x)) and all(w in words or len(w) == 1 for w in got[i].split())
        same += got[i].split() == re.findall("[a-z]+", x)
    assert same >= 0.5 * len(texts)
