"""Language, search, token shards, archives and toxicity against brute force."""

from __future__ import annotations

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import files, langid, queries, token_shards, topk, toxicity, warc
from corpusgraph.llm.scratch import new_path

SF01 = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(0, None), (1, ""), (2, "123 ... 456"), (3, "x " * 30000), (None, "and the"), (5, "and the"), (5, "and the")]


def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], DOCS)


def test_language_held_out(spark):
    got = queries.op1_language(spark, SF01).join(spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark):
    model = langid.fit(spark.read.parquet(f"{SF01}/documents.parquet"))
    got = langid.predict(odd(spark), model).collect()
    assert len(got) == len(ODD)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (0, 1, 2))
    assert all(r.lang_pred in model.languages for r in got if r.doc_id in (3, None, 5))
    assert langid.predict(odd(spark).limit(0), model).count() == 0
    empty = langid.fit(odd(spark))
    assert empty.languages == [] and {r.lang_pred for r in langid.predict(odd(spark), empty).collect()} == {"und"}


def test_mixtures_are_found(spark):
    rows = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", "lang").collect()
    model = langid.fit(spark.createDataFrame(rows))
    pick = lambda lang: next(r.text for r in rows if r.lang == lang and 2000 < len(r.text) < 4000 and "|" not in r.text)[:2000]
    text = pick("fr") + "\n" + pick("de")
    r = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert set(r.languages) == {"fr", "de"} and abs(r.shares[0] - 0.5) < 0.15


def test_em_equals_plain_em():
    rng = np.random.default_rng(1)
    lik, n = rng.random((40, 3)) + 1e-3, np.array([15, 25])
    text = np.repeat([0, 1], n)
    share, value = langid.proportions(lik, text, n, np.ones((2, 3), bool), 7)
    for d in (0, 1):
        own, p = lik[text == d], np.full(3, 1 / 3)
        for _ in range(7):
            part = own * p
            p = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
        assert np.allclose(share[d], p, atol=1e-5) and np.isclose(value[d], np.log(own @ p).sum(), atol=1e-3)


def brute_top(rows, k, every, scale=256):
    held = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            held.append((i, [max(-(2**63), min(2**63 - 1, int(np.floor(scale * float(np.float32(x)))))) for x in v]))
    out = {}
    for i, v in held:
        if i % every == 0 and i not in out:
            scores = sorted(((-max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), j) for j, w in held if j != i and len(w) == len(v)))[:k]
            out[i] = [(j, -s) for s, j in scores]
    return {(i, r + 1, j, s) for i, x in out.items() for r, (j, s) in enumerate(x)}


def test_search_equals_brute_force(spark):
    frame = spark.read.parquet(f"{SF01}/embeddings.parquet")
    expect = brute_top([(r.vec_id, r.embedding) for r in frame.collect()], 5, 50)
    assert {tuple(r) for r in topk.search(frame).collect()} == expect


def test_search_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.25, -1.0]) for i in range(300, 700)]  # one large group of equal vectors
    rows += [(700, None), (750, [1.0, None, 0.0, 0.0]), (800, [float("nan")] * 4), (850, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (900, [])]
    rows += [(950, [1.0, 2.0]), (951, [3.0, -1.0]), (1000, [3.0e7, 1.0, 1.0, 1.0]), (1001, [9.0e7, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, part string")
    assert {tuple(r) for r in topk.search(frame).collect()} == brute_top(rows, 5, 50)
    assert topk.search(frame.limit(0)).count() == 0
    assert {tuple(r) for r in topk.search(frame.where("vec_id = 950")).collect()} == set()


def test_trees_prune_and_stay_exact():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.05, size=(400, 6)) for c in np.eye(6) * 3]) * 256
    points = np.floor(points).astype(np.int64)
    tree = topk.Tree.load(topk.build(points, np.arange(len(points))).dump())
    assert (tree.points == points[tree.ids]).all() and len(tree.lo) > 50
    away = lambda a, b: np.sqrt(((a - b) ** 2).sum(axis=-1))
    for i in range(len(tree.lo)):
        assert (away(tree.flat[tree.lo[i] : tree.hi[i]], tree.center[i]) <= tree.radius[i] + 1e-6).all()
        if tree.n_child[i]:  # nesting, separation, covering
            kids = np.arange(tree.child[i], tree.child[i] + tree.n_child[i])
            assert tree.middle[i] == tree.middle[kids[0]] and tree.hi[kids[-1]] == tree.hi[i]
            apart = away(tree.center[kids][:, None], tree.center[kids][None]) + np.eye(len(kids)) * 1e9
            assert apart.min() > tree.radius[i] * topk.SHRINK and tree.radius[kids].max() <= tree.radius[i] * topk.SHRINK + 1e-6
    asked = points[::5]
    asking = topk.build(asked, np.arange(len(asked)) + 10_000)
    best = topk.Best(asking.kth, 3)
    done = topk.dual_search(asking, tree, best)
    scores = asked @ points.T
    for r, name in enumerate(asking.ids.tolist()):
        order = np.lexsort((np.arange(len(points)), -scores[name - 10_000]))[:3]
        assert best.id[r].tolist() == order.tolist()
    assert done < 0.25 * scores.size


def test_search_of_many_lengths_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "PIVOT_ROWS", 50)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) * 0.1 + np.eye(8)[i % 8]).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(i, rng.normal(size=1 + i % 90).astype(np.float32).tolist()) for i in range(2000, 2400)]
    rows += [(3000 + i, [s * 1e17, s * 1e17]) for i, s in enumerate((1.0, -1.0, 1.0, -1.0, 1.0, 1.0, 1.0))]
    rows += [(3050, [1.0] * 8)] * 7 + [(3050, [0.5] * 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    assert {tuple(r) for r in topk.search(frame).collect()} == brute_top(sorted(rows), 5, 50)


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 17, 1000, 65537):
        order = token_shards.Permutation(n, 9)
        slots = order.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n))
        assert (order.number(slots) == np.arange(n)).all()
    assert (token_shards.Permutation(1000, 1).slot(np.arange(1000)) != token_shards.Permutation(1000, 2).slot(np.arange(1000))).any()


def test_shards_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(120).unionByName(odd(spark))
    folder = new_path(spark, "shards")
    index = token_shards.materialise(docs, folder, length=64, shard=50)
    rows = sorted(token_shards.verified(index, folder, length=64).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    held = collections.defaultdict(list)
    sizes = collections.Counter(r.shard for r in rows)
    assert len(sizes) > 3 and sum(sizes.values()) == len(rows) and max(sizes.values()) < 100
    assert [r.doc_id for r in rows] != sorted((r.doc_id for r in rows), key=str)
    for r in rows:
        ids = next(token_shards.read_slots(folder, r.file, r.record, 1, 64)).tolist()
        assert len(ids) == r.n_tokens and r.record == r.slot - sum(n for x, n in sizes.items() if x < r.shard) and r.byte_offset == r.record * 132
        held[r.doc_id, r.start].append(ids)
    expect = collections.defaultdict(list)
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        for j in range(0, len(ids), 64):
            expect[r.doc_id, j].append(ids[j : j + 64])
    assert {k: sorted(v) for k, v in held.items()} == {k: sorted(v) for k, v in expect.items()}
    assert token_shards.shards(docs.limit(0)).count() == 0


def test_archives_round_trip(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    extra = spark.createDataFrame([(9001, "http://a\r\nX: y", None), (9000, None, ""), (9002, "u", "same é"), (9003, "u", "same é"), (None, "u", "same é"), (8999, "u", "x" * 300000)], "page_id long, url string, html string")
    rows = pages.unionByName(extra).withColumn("archive", F.lit(1)).withColumn("sha1", F.lit("?"))
    got = {r.page_id: r for r in warc.archive(rows).collect()}
    first: dict[bytes, int] = {}
    plain = [(r.page_id, (r.html or "").encode()) for r in rows.collect()]
    for i, payload in sorted((i, p) for i, p in plain if i is not None):
        first.setdefault(payload, i)
    assert len(got) == len(plain)
    for i, payload in plain:
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        if i is not None:
            assert (r.record_type, r.refers_to) == (("response", None) if first[payload] == i else ("revisit", first[payload]))
    assert warc.archive(rows.limit(0)).count() == 0


def test_archive_frames(spark):
    import struct

    import zstandard

    folder = new_path(spark, "warc")
    records = [warc.record(i, "u", (f"<html>page {i} " + "common words " * 50).encode(), "D" * 32, None) for i in range(400)]
    name, places = warc.write_archive(folder, records)
    with files.read(folder, name) as source:
        raw = source.read()
    magic, size = struct.unpack_from("<II", raw)
    assert magic == 0x184D2A5D and size > 0
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    at, n = places[123]
    assert reader.decompress(raw[at : at + n]) == records[123]
    with files.read(folder, name) as source:
        assert list(warc.read_archive(source)) == records


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = queries.op10_toxicity(spark, "/root/testdata/sf0.1").collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 10000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    caught = [labels[r.doc_id] for r in held if r.predicted]
    assert sum(caught) >= 0.9 * len(caught) and sum(caught) >= 0.9 * sum(labels[r.doc_id] for r in held)
    for low, high in ((0, 0.1), (0.1, 0.9), (0.9, 1.01)):  # calibration, by bins of score
        own = [(r.score, labels[r.doc_id]) for r in held if low <= r.score < high]
        assert len(own) > 20 and abs(sum(s - y for s, y in own)) <= 0.1 * len(own) + 2


def test_scores_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    index = toxicity.fit(docs, labels)
    texts, toxic = {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    split = lambda t: collections.Counter(x for w in re.findall(r"[^\W\d_]+", t.lower()) for x in ([w, ("begin", w[:5])] if len(w) > 5 else [w]))
    held = {i: split(texts[i]) for i in toxic if i in texts}
    n = [sum(toxic[i] == y for i in held) for y in (0, 1)]
    df = [collections.Counter(w for i in held if toxic[i] == y for w in held[i]) for y in (0, 1)]
    weigh = lambda w: np.log(1 + sum(n) / (1 + df[0][w] + df[1][w])) * abs(np.log((df[1][w] + 0.5) / (n[1] + 1)) - np.log((df[0][w] + 0.5) / (n[0] + 1)))

    def unit(counts):
        own = {w: (1 + np.log(c)) * weigh(w) for w, c in counts.items() if df[0][w] + df[1][w]}
        norm = np.sqrt(sum(x * x for x in own.values()))
        return {w: x / norm for w, x in own.items()} if norm else own

    vectors = {i: unit(c) for i, c in held.items() if c}
    for r in toxicity.score(docs, index).collect():
        own = unit(split(texts[r.doc_id]))
        if not own:
            continue
        near = sorted(((sum(x * v.get(w, 0) for w, x in own.items()), i) for i, v in vectors.items()), key=lambda x: (-x[0], x[1]))
        near = [x for x in near if x[0] > 0][: toxicity.NEAREST]
        by = [1 / (1.001 - min(c, 1)) for c, _ in near]
        rate = n[1] / sum(n)
        vote = (sum(b * toxic[i] for b, (_, i) in zip(by, near, strict=True)) + 0.5 * rate) / (sum(by) + 0.5)
        assert abs(index.calibrated(vote) - r.score) < 0.02


def test_nearest_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "COMMON", 15)  # so that some terms have lists and some have none
    rng = np.random.default_rng(8)
    dense = rng.random((900, 40)) * (rng.random((900, 40)) < 0.1)
    dense = dense[dense.sum(axis=1) > 0]
    dense /= np.sqrt((dense**2).sum(axis=1, keepdims=True))
    begin = np.concatenate([[0], np.cumsum((dense > 0).sum(axis=1))])
    n = len(dense)
    held = (dense > 0).sum(axis=0)
    index = toxicity.Index(np.arange(40, dtype=np.uint64), np.ones(40), held, begin, np.nonzero(dense)[1], dense[dense > 0], np.zeros(n), np.ones(n), np.arange(n), 0.1, 0.1).ready()
    assert (index.column >= 0).sum() == 15
    for _ in range(60):
        terms = np.sort(rng.choice(40, 4, replace=False))
        weight = rng.random(4)
        found, cosine = index.nearest(terms, weight, 10)
        scores = dense[:, terms] @ weight
        order = np.lexsort((np.arange(n), -np.round(scores, 12)))[:10]
        order = order[scores[order] > 0]
        assert found.tolist() == order.tolist() and np.allclose(cosine, scores[order])
        rest = order[order != order[0]]
        assert index.nearest(terms, weight, 9, without=int(order[0]))[0].tolist() == rest.tolist()


@pytest.mark.parametrize("labels", [[0, 1, None, 1, 0, 1, 0], [1] * 7, [None] * 7])
def test_toxicity_of_odd_rows(spark, labels):
    rows = spark.createDataFrame([(i, t, y) for (i, t), y in zip(ODD, labels, strict=True)], "doc_id long, text string, toxic int")
    index = toxicity.fit(odd(spark), rows.drop("text"))
    got = toxicity.score(odd(spark), index).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd(spark).limit(0), index).count() == 0
