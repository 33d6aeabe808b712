"""The whole job where a cut would leave part of it out."""

from __future__ import annotations

import hashlib
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from corpusgraph.llm import langid, mixing, near_dedup, packing, pii, quality, scratch, textnum, token_shards, tokens, warc
from corpusgraph.llm.scratch import new_path

from test_documents import brute_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def own(i, n=12):
    return " ".join(f"own{i}x{k}" for k in range(n))


def test_a_common_line_stays_where_its_first_holder_goes(spark):
    a, b, c = "first shared passage of three", " ".join(f"b{k}" for k in range(60)), "third shared passage of all"
    texts = {0: a}  # fails the base rules
    texts |= {1: f"{b}\n{own(1)}"}
    texts |= {2: f"{a}\n{b}\n{own(2, 4)}"}  # loses line b, and so is depleted
    texts |= {i: f"{a}\n{own(i)}" for i in range(3, 15)}
    texts |= {i: f"{b}\n{c}\n{own(i, 4)}" for i in range(20, 32)}  # all depleted
    frame = spark.createDataFrame([(i, t, "en", "h", 1) for i, t in texts.items()], DOCS)
    got = {r.doc_id: r.text for r in quality.apply_quality(frame).collect()}
    assert set(got) == {1, *range(3, 15), 20}
    assert {x: [i for i in sorted(got) if x in got[i].split("\n")] for x in (a, b, c)} == {a: [3], b: [1], c: [20]}


def test_a_page_that_was_crawled_twice(spark):
    rows = [(1, "u", "one"), (2, "u", "two"), (5, "u", "one"), (5, "u", "five"), (6, "u", "one"), (6, "u", "two"), (-1, "u", "six"), (-5, "u", "six"), (9, "u", "six"), (None, "u", "six"), (None, "u", "seven"), (None, "u", "seven")]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    expect = [(1, "one", None), (2, "two", None), (5, "five", None), (5, "one", 1), (6, "one", 1), (6, "two", 2), (-1, "six", -5), (-5, "six", None), (9, "six", -5), (None, "six", -5), (None, "seven", None), (None, "seven", None)]
    assert sorted((str(r.page_id), r.payload_digest, r.refers_to or 0, r.record_type) for r in got) == sorted((str(i), warc.digest(x.encode()), f or 0, "revisit" if f else "response") for i, x, f in expect)


def test_links_from_80_percent_on(spark):
    held = [f"w{k}" for k in range(204)]  # 200 shingles
    texts = []
    for g, changed in enumerate((3, 4, 5)):  # 5 shingles each: 185, 180 and 175 of 200 shared, so 0.86, 0.82 and 0.78
        texts += [[f"g{g}{w}" for w in held], [f"g{g}x{i}" if i % 40 == 20 and i < 40 * changed else f"g{g}{w}" for i, w in enumerate(held)]]
    frame = spark.createDataFrame([(i, " ".join(t), "en", "h", 1) for i, t in enumerate(texts)], DOCS)
    kept = lambda x: {r.doc_id for r in x.collect()}
    assert kept(near_dedup.deduplicate(frame, percent=80)) == {0, 2, 4, 5}
    assert kept(near_dedup.near_duplicates(frame).where("kept")) == {0, 2, 3, 4, 5}


def test_enough_bands_for_each_threshold():
    assert [near_dedup.bands_for(x) for x in (85, 80)] == [36, 56]
    assert all((1 - (x / 100) ** near_dedup.ROWS) ** near_dedup.bands_for(x) <= near_dedup.MISS for x in (50, 70, 80, 85, 95))


def test_rows_without_an_id_and_with_the_same(spark):
    rows = [(None, own(1)), (None, own(2)), (None, "few words"), (4, own(3)), (4, own(4)), (5, own(3)), (6, own(5)), (6, "short")]
    frame = spark.createDataFrame([(i, t, "en", "h", 1) for i, t in rows], DOCS)
    plain = lambda x: sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in x.collect())
    passed = quality.apply_quality(frame)
    assert plain(passed) == sorted((-1 if i is None else i, t) for i, t in rows if len(t.split()) > 9)
    # each row is judged by its own text: only the copy of own(3) under the larger id goes
    expect = [(-1 if i is None else i, t) for i, t in rows if i != 5]
    for parts in (1, 3):
        assert plain(near_dedup.deduplicate(frame.repartition(parts))) == sorted(expect)


def test_a_long_secret_is_redacted_whole(spark):
    secret = "".join("aB3-_x9Z"[k % 8] for k in range(2000))
    frame = spark.createDataFrame([(1, f"the token: {secret} and more", "en", "h", 1)], DOCS)
    assert pii.redact(frame).first().text == "the token: [SECRET] and more"
    text = "token=" * 50000 + "1"  # each cue's value runs to the end: one span
    assert pii.find(text)["secret"] == [(6, len(text))]


def test_a_text_of_all_four_languages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("lang is not null").collect()
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 4
    text = "\n".join(next(r.text for r in rows if r.lang == x and 2000 < len(r.text) < 4000 and "|" not in r.text)[:2000] for x in model.languages)
    r = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert set(r.languages) == set(model.languages) and all(abs(x - 0.25) < 0.1 for x in r.shares)


def test_long_texts_of_many_words_are_tokenized(spark):
    rng = np.random.default_rng(1)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    text = b" ".join(x.tobytes() for x in letters[rng.integers(0, 26, (3_000_000, 6))]).decode()
    e = tokens.Encoder(public_tokenizers.path(tokens.TOKENIZER))
    ((first, ids, offset),) = e.encode(pa.array([text]))
    cut = text.rfind(" ", 0, 2_000_000)
    whole = e.tokenizer.encode(text[:cut], add_special_tokens=False).ids
    assert (first, offset[-1]) == (0, len(ids)) and ids[: len(whole)].tolist() == whole and len(ids) > 3_000_000


def test_cuts_change_no_token():
    e = tokens.encoder()
    text = "Ｗide œuvre Σίσυφος ΣΑΣ don't  <|endoftext|> l'été … 12 345 " * 40
    assert e._slow(text.encode(), 50).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_slots_depend_on_rows_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "same"), (None, "same"), (7, None), (7, None)], "doc_id long, text string"))
    found = []
    for parts in (3, 17):
        folder = new_path(spark, "shards")
        index = token_shards.materialise(docs.repartition(parts), folder, length=32, shard=40)
        found.append(sorted(map(str, index.drop("file").collect())))
    assert found[0] == found[1] and len(found[0]) > 200


def test_a_text_of_50_mb_is_read_in_parts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").where("lang is not null").collect()
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    some = "\n".join(r.text for r in rows if r.lang == "fr")
    text = (some * (50_000_000 // len(some.encode()) + 1)).encode()
    block = textnum.Block(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 0)
    one = langid.infer(model, textnum.Block(block.buf[: len(some.encode())], np.array([0, len(some.encode())]), 0))
    tracemalloc.start()
    shares = langid.infer(model, block)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert model.languages[int(shares[0].argmax())] == "fr" and abs(shares - one).max() < 0.02


def test_runs_without_spaces_are_many_observations(spark):
    model = langid.Model(["a", "b"], np.log(np.full((1 << langid.BITS, 2), 0.5, dtype=np.float32)))
    raw = ("語" * 1000 + " x").encode()
    lik, n = langid.likelihoods(model, textnum.Block(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 0))
    assert n.tolist() == [-(-1000 // langid.LONGEST) + 1] and len(lik) == n[0]


def test_counts_of_all_kinds(spark):
    frame = spark.createDataFrame([(1, "password=b7db7aa4a5 http://me:pw@h.org/x IBAN DE89370400440532013000 1.2.3.4")], "doc_id long, text string")
    r = pii.detect(frame).first()
    assert (r.n_secret, r.n_url, r.n_account, r.n_ip, r.n_email) == (1, 1, 1, 1, 1)


def test_near_copies_by_row(spark):
    rng = np.random.default_rng(8)
    a, b, c = own(1, 40), own(2, 40), own(3, 40)
    rows = [(3, a), (5, a), (5, b), (5, b), (9, None), (9, ""), (None, b), (None, c), (None, c), (None, "w"), (-7, "w"), (2, None)]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_duplicates(frame).collect())
    reach = {a: 3, b: 5, c: None, "w": -7}
    size = lambda t: 0 if not t else 36 if t != "w" else 1
    comp = lambda i, t: reach[t] if t else i
    assert got == sorted((str(i), size(t), str(comp(i, t)), i is not None and comp(i, t) == i) for i, t in rows)
    full = frame.selectExpr("*", "'en' as lang", "'h' as source", "1L as n_chars")
    stay = sorted((str(r.doc_id), r.text or "") for r in near_dedup.deduplicate(full).collect())
    assert stay == sorted([("3", a), ("5", b), ("None", c), ("-7", "w"), ("9", ""), ("9", ""), ("2", "")])


def test_chains_of_half_similar_texts_stay_linear(spark):
    words, texts = [f"w{k}" for k in range(4000)], []
    for i in range(300):  # each shares half of its words with the next
        texts.append(" ".join(words[i * 10 : i * 10 + 20] * 1))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(frame).collect()} == set(range(300))


def test_blocks_of_a_bucket(spark, monkeypatch):
    # one band only, so all texts with the same registers meet in one bucket and must be compared in blocks
    monkeypatch.setattr(near_dedup, "ROWS", 1)
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    rng, rows = np.random.default_rng(3), []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(90)] + [f"s{k}" for k in range(110)]
        for _ in range(20):
            text = list(base)
            text[int(rng.integers(0, 90))] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame).collect()}
    assert got == brute_components(rows, 85)


def test_large_tables_are_joined_by_shuffle(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = lambda: [sorted(map(str, x.collect())) for x in (near_dedup.near_duplicates(docs), quality.quality(docs).drop("removed"), mixing.mixture(docs).select("doc_id", "taken"))]
    before = plain()
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(scratch, "HEAVY", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plain() == before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_columns_of_any_name(spark):
    rows = [(i, f"some words of a text that is long enough to stay {i} {own(i)}", "en", "s", 1, *range(11)) for i in range(12)]
    extra = "removed long, unit long, key long, copies long, turn long, row long, gone long, keeper long, __id long, __kept long, host long"
    frame = spark.createDataFrame(rows, f"{DOCS}, {extra}")
    for f in (quality.apply_quality, near_dedup.deduplicate, pii.redact, mixing.mix):
        assert f(frame).columns == frame.columns and f(frame).count() >= 12
    for f in (quality.quality, near_dedup.near_duplicates, pii.detect, mixing.mixture, packing.pack):
        assert f(frame).count() >= 12
    assert scratch.clear(spark) > 0


def test_a_repeated_row_loses_its_words_once(spark):
    line = "a common line of eight words in all"
    rows = [(i, f"{line}\n{own(i, 5)}", "en", "h", 1) for i in range(12)]
    got = {r.doc_id: (r.n_removed_words, r.kept) for r in quality.quality(spark.createDataFrame([*rows, rows[3], rows[3]], DOCS)).collect()}
    assert got[3] == (8, True) and got[4] == (8, True) and got[0] == (0, True)
    without = [(None, *x[1:]) for x in rows]  # documents of their own
    got = quality.quality(spark.createDataFrame(without, DOCS)).collect()
    assert sorted(r.n_removed_words for r in got) == [0] + [8] * 11
