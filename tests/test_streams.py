"""Streams over several shuffled batches against their batch forms, and incremental ingestion."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import chunking, lifecycle
from corpusgraph.sources.store import Store
from corpusgraph.streaming import ingest, jobs

KINDS = ["document_created", "indexed", "graphed", "ready", "failed", "pending", "unknown"]
EVENTS = "doc_id long, id long, s double, status string, error_message string"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


def stamped(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")


def streamed(spark, path, parts, schema, stamp=stamped):
    for n, rows in enumerate(parts):
        out = stamp(spark, rows, schema)
        out.coalesce(1).write.parquet(f"{path}/in/n={n:03d}")
    return spark.readStream.schema(out.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_status_fold_of_shuffled_batches(spark, tmp_path):
    rng = random.Random(9)
    events = [(rng.choice([None, 1, 2, 3]), i, float(rng.randrange(3000)), rng.choice(KINDS), "e") for i in range(240)]
    want = tuples(lifecycle.fold_status(stamped(spark, events, EVENTS)))
    rng.shuffle(events)
    stream = streamed(spark, tmp_path, [events[k::4] for k in range(4)], EVENTS)
    assert tuples(jobs.run_once(jobs.fold_status_stream(stream, "1 hour"), f"{tmp_path}/w", "update", "doc_id")) == want


def test_what_the_watermark_has_passed_is_final(spark, tmp_path):
    at = lambda i, s, what: (1, i, float(s), what, None)
    parts = [[at(1, 100, "indexed")], [at(2, 50, "document_created"), at(3, 9000, "graphed")], [at(5, 8990, "failed")], [at(4, 60, "failed")]]
    stream = streamed(spark, tmp_path, parts, EVENTS)
    got = jobs.run_once(jobs.fold_status_stream(stream, "10 minutes"), f"{tmp_path}/w", "update", "doc_id").collect()
    # the event of second 60 comes a batch after the watermark has reached 8400: too late; that of 8990 is before the one of 9000
    assert [(r.status, r.applied, r.rejected) for r in got] == [("failed", 3, 1)]


def test_old_documents_leave_the_state(spark, tmp_path):
    parts = [[(1, 1, 10.0, "indexed", None)], [(2, 2, 500_000.0, "indexed", None)], [(3, 3, 600_000.0, "indexed", None)]]
    stream = jobs.fold_status_stream(streamed(spark, tmp_path, parts, EVENTS), "1 minute", keep_days=1)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    rows = []
    run = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda b, n: rows.extend(b.collect())).start()
    run.awaitTermination()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3]
    left = sum(x["numRowsTotal"] for x in run.recentProgress[-1]["stateOperators"]) if run.recentProgress else 0
    held = [sum(x["numRowsTotal"] for x in p["stateOperators"]) for p in run.recentProgress]
    assert left <= max(held)


def test_throttle_of_shuffled_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(3), i, float(rng.randrange(400))) for i in range(200)]
    want = tuples(lifecycle.throttle(spark.createDataFrame(rows, "key long, id long, t double"), 4, 30))
    rng.shuffle(rows)
    stream = streamed(spark, tmp_path, [rows[k::3] for k in range(3)], "key long, id long, t double", lambda s, r, k: s.createDataFrame(r, k))
    assert tuples(jobs.run_once(jobs.throttle_stream(stream, 4, 30, "1 hour"), f"{tmp_path}/w", "update", ["key", "id"])) == want


def test_silent_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None), (2, "indexed", None), (3, "ready", None), (4, "graphed", None), (5, "failed", "x"), (6, "pending", None)], "id long, status string, error_message string")
    minute = 60.0
    parts = [
        [(1, 0.0), (2, 0.0), (3, 0.0), (9, 1.0)],
        [(1, 20 * minute), (None, 100 * minute)],
        [(None, 101 * minute)],  # the watermark is at 80 minutes: 1, 2, 4 and 6 have failed
        [(2, 95 * minute), (6, 96 * minute), (None, 110 * minute)],  # 2 and 6 are alive after all
        [(2, 96 * minute), (None, 146 * minute + 0.000001)],
    ]
    stream = streamed(spark, tmp_path, parts, "doc_id long, s double")
    got = jobs.run_once(jobs.reconcile_stream(docs, stream, 30, "20 minutes"), f"{tmp_path}/w", "update", "id")
    now = F.timestamp_micros(F.lit(int((126 * minute) * 1_000_000)))
    progress = stamped(spark, [x for part in parts for x in part if x[0]], "doc_id long, s double")
    want = lifecycle.reconcile(docs, progress, now)
    swept = {r.id: tuple(r)[1:] for r in got.collect()}
    final = {r.id: tuple(r)[1:] for r in want.collect()}
    # 2 and 6 were last heard of at 96 minutes: at 126 that isn't older than half an hour
    assert {i: swept.get(i, x) for i, x in final.items()} == final and {i for i, x in final.items() if x[2]} == {1, 4}


DOCS = "user_id long, document_id string, version long, original_filename string, content string"


def embedder(texts, dim):
    from corpusgraph.operators.vectors import feature_hashing

    return feature_hashing(texts, dim)


def table(store, name):
    return tuples(store.read(name))


def everything(store):
    return {name: table(store, name) for name in ingest.SCHEMAS} | {f"graph {k}": tuples(v) for k, v in ingest.graph_of(store).items() if k in ("next", "mentions", "entities", "owns")}


@pytest.fixture(scope="module")
def versions():
    long = "\n\n".join(f"Paragraph {k} of Acme Corp on 2024-01-{k % 28 + 1:02d}. " + "word " * 40 for k in range(12))
    first = [(1, "a", 1, "a.md", "# Old\n\nold text"), (1, "b", 1, "b.md", long), (2, "a", 1, "a.md", "other user"), (1, "c", 1, "c.md", "good once"), (1, "d", 1, "d.md", None), (None, "x", 1, "x.md", "no user")]
    second = [(1, "a", 2, "a.md", "# New\n\nnew text of Acme Corp"), (1, "b", 1, "b.md", long), (1, "c", 2, "c.md", " \n "), (3, "e", 1, "e.md", "late"), (3, "e", 1, "e.md", "late"), (2, "a", 0, "a.md", "older")]
    return first, second


def test_batches_give_the_rows_of_one(spark, tmp_path, versions):
    first, second = versions
    frame = lambda rows: spark.createDataFrame(rows, DOCS)
    one = ingest.target(spark, f"{tmp_path}/one", buckets=4)
    ingest.ingest(frame(first + second), "all", one)
    expect = everything(one)
    two = ingest.target(spark, f"{tmp_path}/two", buckets=4)
    ingest.ingest(frame(first), "1", two)
    ingest.ingest(frame(second), "2", two)
    assert everything(two) == expect
    assert ingest.ingest(frame(second), "2", two) == [] and ingest.ingest(frame(first), "1", two) == []  # known batches
    assert ingest.ingest(frame(second + first), "again", two) == [] and everything(two) == expect  # nothing newer
    turned = ingest.target(spark, f"{tmp_path}/turned", buckets=4)
    ingest.ingest(frame(second), "2", turned)
    ingest.ingest(frame(first), "1", turned)
    assert everything(turned) == expect
    status = {r[:2]: r[4:] for r in expect["documents"]}
    assert status[(1, "c")] == ("failed", "blank") and status[(1, "d")] == ("failed", "blank") and (None, "x") not in status
    assert not [r for name in ("chunks", "vectors", "chunk_entities") for r in expect[name] if r[:2] in ((1, "c"), (1, "d"))]
    assert table(ingest.target(spark, f"{tmp_path}/two", buckets=4), "chunks") == expect["chunks"]
    assert {r.title for r in two.read("documents", version=1).collect() if r.document_id == "a"} == {"Old", "a.md"}


def test_a_stream_of_documents_and_a_broken_embedder(spark, tmp_path, versions):
    first, second = versions
    stream = streamed(spark, tmp_path, [first, second], DOCS, lambda s, r, k: s.createDataFrame(r, k))
    store = ingest.target(spark, f"{tmp_path}/t", buckets=4)

    def breaks(texts, dim):
        raise RuntimeError("no embedder")

    with pytest.raises(Exception, match="no embedder"):
        ingest.ingest_stream(stream, store, f"{tmp_path}/c", embedder=breaks).awaitTermination()
    assert store.versions() == [] and all(not table(store, name) for name in ingest.SCHEMAS)
    ingest.ingest_stream(stream, store, f"{tmp_path}/c").awaitTermination()
    whole = ingest.target(spark, f"{tmp_path}/whole", buckets=4)
    ingest.ingest(spark.createDataFrame(first + second, DOCS), "all", whole)
    assert everything(store) == everything(whole) and len(store.versions()) == 2


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"t": "user_id long, document_id string, x long"}, buckets=8, files=2)
    rows = lambda ids, x: spark.createDataFrame([(1, f"d{i}", x) for i in ids], store.schemas["t"])
    assert store.commit("1", rows(range(60), 0), {"t": rows(range(60), 0)}) == list(range(8))
    before = store._folders()
    touched = store.commit("2", rows([3], 1), {"t": rows([3], 1)})
    after = store._folders()
    assert len(touched) == 1 and {k for k in after if after[k] != before[k]} == {("t", touched[0])}
    assert sorted(r.x for r in store.read("t").collect()) == [0] * 59 + [1]
    store.commit("3", rows(range(60), 0), {})
    assert store.read("t").count() == 0 and store.read("t", version=2).count() == 60 and store.commit("4", rows([], 0), {}) == []


def seconds(spark, text):
    docs = spark.createDataFrame([(1, "d", text)], "user_id long, document_id string, content string")
    chunking.chunk_documents(docs).count()
    start = time.monotonic()
    n = chunking.chunk_documents(docs).count()
    return time.monotonic() - start, n


def test_chunking_is_linear_in_a_text(spark):
    text = lambda n: "\n\n".join(f"# Heading {k}\n\n" + "A sentence of some words. " * 40 if k % 4 == 0 else "word " * 60 for k in range(n))
    (once, n), (four, m) = seconds(spark, text(3000)), seconds(spark, text(12000))
    assert 3.9 < m / n < 4.1 and four < 8 * once + 2
