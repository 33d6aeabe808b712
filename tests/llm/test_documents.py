"""Quality, near-duplicates, personal data, mixing and packing against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusgraph.llm import mixing, near_dedup, packing, pii, quality, queries, textnum

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF01 = "/root/testdata/sf0.01"
ODD = [None, "", " \t\n", "one", "a b c d", "a b c d e", "a b c d e", "x " * 40000, "é ß\x0b¿ ñ", "line\n\nline\n", "\x00 zero", None, "", "ÀÉ"]


def odd(spark):
    rows = [(i if i != 3 else None, t, None, None if i % 4 == 1 else f"s{i % 3}", None) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], rows[5]], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet")


def brute_measures(text):
    w = words(text)
    windows = collections.defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    hit = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}


def brute_quality(rows, max_docs, max_lost):
    norm = lambda x: tuple(w.translate({k: k + 32 for k in range(65, 91)}) for w in words(x))
    out, lines, holders = {}, {}, collections.defaultdict(set)
    for i, text, host in rows:
        m = brute_measures(text)
        out[i] = m | {"base_failed": m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]}
        lines[i] = [(host, norm(x)) for x in (text or "").split("\n") if words(x)]
        for x in lines[i]:
            holders[x].add(i)
    common = {x: {i for i in v if not out[i]["base_failed"]} for x, v in holders.items() if len(v) > max_docs}
    lost = lambda i, keeper: sum(len(x[1]) for x in lines[i] if x in common and keeper.get(x) != i)
    first = {x: min(v) for x, v in common.items() if v}
    depleted = {i: 100 * lost(i, first) > max_lost * out[i]["n_words"] for i in out}
    keeper = {x: min(v, key=lambda i: (depleted[i], i)) for x, v in common.items() if v}
    for i, m in out.items():
        m["n_removed_words"] = 0 if m["base_failed"] else lost(i, keeper)
        m["kept"] = not m["base_failed"] and (i in keeper.values() or 100 * m["n_removed_words"] <= max_lost * m["n_words"])
    return out


@pytest.mark.parametrize(("max_docs", "max_lost"), [(quality.MAX_DOCS, quality.MAX_LOST), (1, 30)])
def test_quality_equals_brute_force(docs, max_docs, max_lost):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    expect = brute_quality(rows, max_docs, max_lost)
    got = quality.quality(docs, max_docs, max_lost).drop("removed", "host").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.asDict() == expect[r.doc_id] | {"doc_id": r.doc_id}


def test_quality_removes_lines(spark):
    common = "A line that\tall share here"
    rows = [(i, f"{common.upper() if i % 2 else common}\nown words of document number {i} and some more of them here", "en", "h", 1) for i in range(20)]
    rows.append((99, common, "en", "h", 1))
    got = {r.doc_id: r for r in quality.apply_quality(spark.createDataFrame(rows, SCHEMA), max_docs=5).collect()}
    assert 99 not in got and len(got) == 20
    assert got[0].text.startswith("A line") and all("ine that" not in got[i].text.lower() for i in range(1, 20))
    assert got[3].n_chars == len(got[3].text)


def test_odd_rows(spark):
    frame = odd(spark)
    n = frame.count()
    q = quality.quality(frame).collect()
    assert len(q) == n
    for r in q:
        if r.doc_id is not None and r.doc_id not in (4, 5):
            m = brute_measures(ODD[r.doc_id])
            assert {k: r[k] for k in m} == m
    quality.apply_quality(frame).collect()
    d = near_dedup.near_duplicates(frame).collect()
    assert len(d) == n and {r.component_id for r in d if r.doc_id == 6} == {5}
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in d if r.doc_id in (0, 1, 2, 11, 12))
    near_dedup.deduplicate(frame).collect()
    assert pii.detect(frame).count() == n
    assert pii.redact(frame).count() == n
    m = mixing.mixture(frame).collect()
    assert len(m) == n and all(r.taken <= 3 * r.size for r in m)
    mixing.mix(frame).collect()
    p = packing.pack(frame).collect()
    assert sum(r.length for r in p if r.doc_id == 0) == 1
    for x in (quality.quality, near_dedup.near_duplicates, pii.detect, mixing.mixture, packing.pack, near_dedup.deduplicate, mixing.mix, quality.apply_quality, pii.redact):
        assert x(frame.limit(0)).count() == 0


def test_extra_columns(spark):
    rows = [(1, "some words of a text that is long enough to stay in the table", "en", "s", 1, 2, "x", 3.0)]
    frame = spark.createDataFrame(rows, SCHEMA + ", host long, component_id string, size double")
    for f in (quality.apply_quality, near_dedup.deduplicate, pii.redact, mixing.mix):
        assert f(frame).columns == frame.columns and f(frame).count() >= 1
    assert packing.pack(frame).count() >= 1


def brute_components(rows, percent):
    sets = {}
    for i, text in rows:
        w = words((text or "").translate({k: k + 32 for k in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = collections.Counter()
    for v in holders.values():
        for a in range(len(v)):
            for b in range(a):
                shared[v[b], v[a]] += 1
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(docs):
    expect = brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 85)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(expect)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expect
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_and_large_families(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows, text = [], list(base)
    for i in range(260):  # a chain: each a small change of the one before
        text = list(text)
        text[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(text)))
    for i in range(260, 520):  # a star: each a change of the base
        own = list(base)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(120)] = f"m{i}"
        rows.append((i, " ".join(own)))
    expect = brute_components(rows, 85)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expect


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 62, 900, dtype=np.uint64), rng.integers(0, 1 << 62, 100, dtype=np.uint64)
    x, y, z = (near_dedup.registers(s, np.array([0]))[0] for s in (a, b, np.concatenate([a, b])))
    assert (near_dedup.merge(x, y) == z).all()
    guess = near_dedup.joint_estimate(np.array([(x > z).sum()]), np.array([(x < z).sum()]), np.array([900.0]), np.array([1000.0]))
    assert abs(guess[0] - 0.9) < 0.08


def brute_pii(text):
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and pii.luhn(d)]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return out


def test_pii_equals_regexes(docs):
    rng = random.Random(3)
    for alphabet in ("a@.b", "1.2 25", "0123456789 -4111", "+1 ()9.-a@.x5"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            found = pii.find(text)
            assert {k: found[k] for k in pii.BASE_KINDS} == brute_pii(text), text
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in pii.detect(docs).collect():
        spans = brute_pii(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in spans[k])
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and set(filter(None, line.split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(spans[k]) for k in pii.BASE_KINDS)


def test_pii_cues_and_redaction():
    text = "IBAN: DE89370400440532013000, password=b7db7aa4a5 mailto:jo@ex.org http://me:pw@h.org/x Compte 123-456-789. token of"
    found = pii.find(text)
    assert [text[a:b] for a, b in found["account"]] == ["DE89370400440532013000", "123-456-789"]
    assert [text[a:b] for a, b in found["secret"]] == ["b7db7aa4a5"]
    assert [text[a:b] for a, b in found["url"]] == ["http://me:pw@h.org/x"]
    assert pii.redacted("a jo@ex.org b") == "a [EMAIL] b" and pii.redacted(None) is None
    assert pii.find("IBAN DE89370400440532013001")["account"] == []


def brute_targets(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, free, out = sum(sizes.values()), set(names), {}
    while free:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        out |= {s: cap * sizes[s] for s in over} if over else share
        free -= over or free
    return out


def test_mixing_meets_targets(docs):
    rows = mixing.mixture(docs).collect()
    sizes, taken, most = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
        assert 0 <= r.taken <= 3 * r.size
    expect = brute_targets(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - expect[r.source]) < 1e-6 * r.target
    for s in sizes:
        assert abs(taken[s] - expect[s]) <= most[s]
    again = mixing.mixture(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_targets_stop_and_share_again(spark):
    sizes = {"a": 10, "b": 1000, "c": 5000, "d": 3, "é": 70, None: 900}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    for s, x in brute_targets(sizes).items():
        assert got[s] == pytest.approx(x)


def test_packing_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    some = docs.limit(150)
    texts = {r.doc_id: r.text for r in some.collect()}
    rows = packing.pack(some).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    held = collections.defaultdict(list)
    for r in rows:
        held[r.doc_id].append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 and 1 << r.bucket == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    for i, text in texts.items():
        own = sorted(held[i], key=lambda r: r.start)
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert [x for r in own for x in r.ids] == ids and {r.doc_tokens for r in own} == {len(ids)}
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])


def test_tokens_of_odd_texts():
    from corpusgraph.llm.tokens import encoder

    e, rng = encoder(), random.Random(5)
    bits = ["s", "'s", "'re", "a", "É", "ß", " ", "\n", "3", "²", "...", ".", "don't", "l'été", "Ａ", "œ", "<|endoftext|>", "\xa0", "\x1c", "\x85", "Σ", "ª", "'", "́", "İ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    got = [i[o[k] : o[k + 1]].tolist() for _, i, o in e.encode(pa.array(texts)) for k in range(len(o) - 1)]
    assert got == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_blocks_cover_slices():
    column = pa.array(["a b", None, "", "c\nd e", "f"]).slice(1)
    seen = [(b.first + i, bytes(b.buf[b.bounds[i] : b.bounds[i + 1]])) for b in textnum.blocks(column, 4) for i in range(b.n)]
    assert seen == [(0, b""), (1, b""), (2, b"c\nd e"), (3, b"f")]


def test_queries_name_columns(spark):
    assert queries.QUERIES["op5_quality"](spark, "/root/testdata/sf0.001").columns[0] == "doc_id"
