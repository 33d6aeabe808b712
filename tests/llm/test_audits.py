"""Divergence, contamination and the Merkle manifest against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corpusgraph.llm import decontaminate, divergence, merkle, order, queries, scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \t\n", "one", "A b c D", "a b c d", "a b c d", "x " * 30000, "é ß\x0b¿ ñ É", "line\n\nline\n", "\x00 zero 42x7", None, "", "ÀÉ 9"]
LOW = {k: k + 32 for k in range(65, 91)}


def odd(spark):
    rows = [(i if i != 3 else None, t, None if i % 5 == 0 else ("en", "")[i % 2], None if i % 4 == 1 else f"s{i % 3}", None if i % 3 == 0 else i) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], rows[5], rows[5]], DOCS)


def widened(df):
    """Columns that an operator may use itself."""
    names = ["term", "n", "docs", "g", "p", "value", "rank", "pos", "tree", "leaf", "lang_", "part", "__part", "item_id", "block"]
    for x in names:
        df = df if x in df.columns else df.withColumn(x, df["text"])
    return df


def same(df, expect):
    got = sorted(map(str, (tuple(r) for r in df.collect())))
    assert got == sorted(map(str, expect))


# --- divergence


def brute_divergence(rows, least=3, most=200):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in docs}:
        held = collections.Counter(w for la, _, ws in docs if la == lang for w in set(ws))
        kept = sorted(w for w, n in held.items() if n >= least)
        count = {s: collections.Counter(w for la, so, ws in docs if (la, so) == (lang, s) for w in ws if held[w] >= least) for s in {x[1] for x in docs if x[0] == lang}}
        whole = sum(count.values(), collections.Counter())
        p = lambda c, w: 1 + 1_000_000_000 * (c[w] + 1) // (sum(c.values()) + len(kept))
        away = lambda a, b: (a - b) ** 2 // b
        for s, c in count.items():
            pairs = [(t, sum(away(p(c, w), p(d, w)) for w in kept)) for t, d in count.items() if t != s]
            terms = [(w, away(p(c, w), p(whole, w))) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, v, k) for k, (x, v) in enumerate(found, 1) if part == "pair" or k <= most]
    return out


def _triples(df):
    return [tuple(r) for r in df.select("text", "lang", "source").collect()]


def test_divergence_equals_brute_force(spark, sf):
    for frame in (odd(spark), widened(odd(spark)), spark.read.parquet(f"{sf}/documents.parquet").limit(60)):
        same(divergence.divergence(frame), brute_divergence(_triples(frame)))
    same(divergence.divergence(odd(spark), least=1, most=2), brute_divergence(_triples(odd(spark)), 1, 2))
    assert divergence.divergence(odd(spark).limit(0)).count() == 0


def test_many_groups_and_columns_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in rng.choices(range(200), k=rng.randint(0, 9))), rng.choice("ab"), f"s{rng.randint(0, 20)}") for _ in range(250)]
    frame = spark.createDataFrame([(i, t, la, s, 1) for i, (t, la, s) in enumerate(rows)], DOCS)
    expect = brute_divergence(rows)
    same(divergence.divergence(frame), expect)
    # the tasks see the sizes of this module through its defaults: compare the blocks here
    monkeypatch.setattr(divergence, "ROWS", 8)
    audit = divergence.Audit(frame)
    heads = [(r.lang, r.g, r.source, r.p0, r.v) for r in audit.groups.collect()]
    cells = audit.cells.collect()
    got = []
    for lang in "ab":
        own = [x for x in heads if x[0] == lang]
        names = {x[1]: x[2] for x in own}
        blocks = range(-(-len(own) // 8))
        for low, high in itertools.combinations_with_replacement(blocks, 2):
            rows_ = [(x[1], None, x[3], x[4]) for x in own if x[1] // 8 in (low, high)] + [(c.g, c.term, c.p, None) for c in cells if c.lang == lang and c.g // 8 in (low, high)]
            table = pa.table({"lang": [lang] * len(rows_), "low": [low] * len(rows_), "high": [high] * len(rows_), "g": pa.array([x[0] for x in rows_]), "term": pa.array([x[1] for x in rows_], pa.string()), "p": [x[2] for x in rows_], "columns": pa.array([x[3] for x in rows_], pa.int64())})
            got += [(r["lang"], names[r["g"]], names[r["h"]], r["value"]) for r in divergence._compare(table).to_pylist()]
    assert sorted(got) == sorted((la, s, x, v) for la, s, part, x, v, _ in expect if part == "pair")


def test_quadrants_that_are_zero_in_both_are_not_visited():
    n, floor = 512, np.array([5, 7], dtype=np.int64)
    row, column, value = np.array([0, 1]), np.array([3, 400]), np.array([50, 70])
    a = divergence.K2Tree(row, column, value, floor, n)
    found = divergence.joint_leaves(a, a, 2, 2)
    assert sorted(found[4].tolist()) == [3 // divergence.LEAF, 400 // divergence.LEAF]
    forth, back = divergence.block_divergence(a, a, 2, 2)
    dense = np.repeat(floor[:, None], n, axis=1)
    dense[row, column] = value
    brute = lambda p, q: int(((p - q) ** 2 // q).sum())
    assert forth.tolist() == [[brute(dense[i], dense[k]) for k in (0, 1)] for i in (0, 1)]
    assert back.tolist() == [[brute(dense[k], dense[i]) for k in (0, 1)] for i in (0, 1)]


def test_counts_beyond_63_bits_of_product(spark):
    frame = spark.createDataFrame([(10_000_000_000_000, 3, 20_000_000_000_000)], "n long, v long, total long")
    got = frame.select(divergence._probability("n", "total").alias("p")).first().p
    assert got == 1 + 10**9 * (10**13 + 1) // (2 * 10**13 + 3)


# --- contamination

ITEMS = "item_id string, text string"


def brute_contamination(docs, items, window=10):
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOW))
    held = [(i, split(t)) for i, t in items]
    out = []
    for doc, text in docs:
        words, hit, names = split(text), set(), set()
        for i, ws in held:
            size = min(len(ws), window)
            for at in range(len(ws) - size + 1) if size else ():
                for k in range(len(words) - size + 1):
                    if words[k : k + size] == ws[at : at + size]:
                        hit |= set(range(k, k + size))
                        names |= {i} - {None}
        out.append((doc, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "b", "c", "dé", "E5"])
    items = [("short", "only Four words here"), ("none", "?!"), ("void", None), (None, "a b c a b c a b c a b c"), ("same", "a b c a b c a b c a b c"), ("same", "b b b b b b b b b b b b")]
    items += [(f"i{k}", " ".join(word() for _ in range(rng.randint(8, 30)))) for k in range(30)]
    docs = []
    for k in range(120):
        text = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            ws = (rng.choice(items)[1] or "").split()
            at = rng.randint(0, len(ws))
            text += ws[at : at + rng.randint(5, 25)]
        docs.append((k if k % 9 else None, rng.choice([" ", ". ", "-", "\n"]).join(text)))
    docs += [(500, "a " * 3000), (501, "b " * 4000 + "only four, words HERE"), (502, None), (503, ""), (1, docs[1][1]), (1, docs[1][1])]
    return docs, items


def test_contamination_equals_brute_force(spark, planted, monkeypatch):
    docs, items = planted
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, ITEMS)
    expect = brute_contamination(docs, items)
    same(decontaminate.contamination(frame, bench).drop("longest"), expect)
    same(decontaminate.contamination(widened(frame), widened(bench)).drop("longest"), expect)
    kept = decontaminate.decontaminate(widened(frame), bench)
    assert kept.columns == widened(frame).columns
    same(kept.select("doc_id", "text"), [d for d, x in zip(docs, expect, strict=True) if not x[5]])
    none = decontaminate.contamination(frame, bench.limit(0))
    assert {tuple(r)[2:4] for r in none.collect()} == {(0, 0)} and none.count() == len(docs)
    assert decontaminate.contamination(frame.limit(0), bench).count() == 0
    frame = odd(spark)
    same(decontaminate.contamination(frame, bench).drop("longest"), brute_contamination([(r.doc_id, r.text) for r in frame.collect()], items))


def test_small_shards_blocks_and_spreads_change_nothing(spark, planted, monkeypatch):
    docs, items = planted
    bench = spark.createDataFrame(items, ITEMS)
    folder = decontaminate.stored_items(bench, "item_id", "text")
    for shard, block, spread in ((1 << 23, 1 << 22, 1 << 20), (300, 60, 7), (1, 1, 1)):
        for name, size in (("SHARD", shard), ("BLOCK", block), ("SPREAD", spread)):
            monkeypatch.setattr(decontaminate, name, size)
        some = docs if spread > 7 else docs[:40]
        got = []
        for at, n, found in decontaminate._found(pa.array([t for _, t in some], pa.string()), folder, 10, 10):
            words, hit = found.counts()
            got += [(some[at + k][0], int(words[k]), int(hit[k]), sorted(found.names[k])) for k in range(n)]
        assert [(a, b, c, hashlib.sha256(",".join(x).encode()).hexdigest()) for a, b, c, x in got] == [(a, b, c, e) for a, b, c, _, e, _ in brute_contamination(some, items)]


def test_matches_are_the_longest_ones(spark):
    passage = [f"p{k}" for k in range(40)]
    docs = [(1, " ".join(["x", *passage[5:30], "y"])), (2, " ".join(passage)), (3, " ".join([*passage[:12], "z", *passage[:9]])), (4, "nothing")]
    bench = spark.createDataFrame([("i", " ".join(passage)), ("j", "q r")], ITEMS)
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS)
    same(decontaminate.matches(frame, bench), [(1, 1, "i", 5, 25), (2, 0, "i", 0, 40), (3, 0, "i", 0, 12)])
    assert {r.doc_id: r.longest for r in decontaminate.contamination(frame, bench).collect()} == {1: 25, 2: 40, 3: 12, 4: 0}


@pytest.mark.parametrize("rows", ["own", "odd"])
def test_contamination_query_equals_its_sql(spark, sf, planted, tmp_path, rows):
    folder = sf
    if rows == "odd":
        docs, items = planted
        folder = str(tmp_path)
        texts = [*docs, *((700 + k, t and t[:2000]) for k, t in enumerate(ODD)), (None, "only four words here"), (None, None)]
        spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], DOCS).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([*items, ("É,1", "x x"), ("z", "é"), ("0", "42X7")], ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    found = queries.QUERIES["op12_contamination"](spark, folder)
    with duckdb.connect() as duck:
        for t in ("documents", "benchmark"):
            duck.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'/*.parquet' if rows == 'odd' else ''}')")
        expect = duck.sql(queries.ORACLES["op12_contamination"])
        assert found.columns == expect.columns
        same(found, expect.fetchall())


def test_suffixes_are_in_order():
    rng = np.random.default_rng(1)
    words = pa.array([f"w{k}" for k in rng.integers(0, 3, 400)], pa.large_string())
    first = np.array([0, 50, 50, 400])
    shard = decontaminate.Shard(words, first, 16)
    code = shard.code.tolist()

    def suffix(at):
        end = int(shard.first[shard.doc[at] + 1]) - 1
        return code[at : min(at + 16, end)]

    found = [suffix(int(x)) for x in shard.order]
    assert sorted(shard.order.tolist()) == list(range(len(code))) and found == sorted(found)


# --- manifest


def brute_manifest(rows):
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf_of = lambda i, s, la, n, t: h(*map(field, (i, s, la, n, t)))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
        return levels

    way = lambda levels, k: [(k >> d & 1, lv[(k >> d) ^ 1] if (k >> d) ^ 1 < len(lv) else None) for d, lv in enumerate(levels[:-1])]
    groups = collections.defaultdict(list)
    for i, t, la, s, n in rows:
        tampered = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        groups[la].append((i is not None, i or 0, leaf_of(i, s, la, n, t), leaf_of(i, s, la, n + 1, t) if tampered else None))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {la: tree([x[2] for x in sorted(groups[la], key=lambda x: x[:3])]) for la in langs}
    top = tree([trees[la][-1][0] for la in langs])
    out = []
    for k, la in enumerate(langs):
        for j, (has, i, leaf, other) in enumerate(sorted(groups[la], key=lambda x: x[:3])):
            path = way(trees[la], j) + way(top, k)
            end = other or leaf
            for right, x in path:
                end = h(end) if x is None else h(x, end) if right else h(end, x)
            out.append((i if has else None, leaf, trees[la][-1][0], top[-1][0], h(*(x for _, x in path if x)), end, end == top[-1][0]))
    return out


@pytest.mark.parametrize("height", [1, 2, 12])
def test_manifest_equals_brute_force(spark, height, monkeypatch):
    rows = [(i, f"text {i}", ("a", "b", None, "ß")[min(i % 7, 3)], f"s{i % 3}", i) for i in range(75)] + [(900, "alone", "only", "s", 5)]
    frames = [spark.createDataFrame(rows, DOCS), odd(spark), widened(odd(spark))] if height == 12 else []
    for frame in frames:
        own = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in frame.collect()]
        same(merkle.manifest(frame, when=queries.remainder(7) == 0), brute_manifest(own))
    # small blocks, and so several layers, with the same functions on this side
    monkeypatch.setattr(merkle, "HEIGHT", height)
    leaves = [merkle.digest(str(k)) for k in range(75)]
    nodes, n, path_of = leaves, len(leaves), [[] for _ in leaves]
    at = list(range(75))
    while True:
        cut = 1 << height
        trees = [merkle.subtree(nodes[k : k + cut], merkle._height(n)) for k in range(0, len(nodes), cut)]
        for i in range(75):
            path_of[i] += merkle.siblings(trees[at[i] >> height], merkle._height(n), at[i] & (cut - 1))
            at[i] >>= height
        nodes, n = [x[0] for x in trees], -(-n // cut)
        if len(nodes) == 1:
            break
    whole = list(leaves)
    while len(whole) > 1:
        whole = [merkle.digest(*whole[k : k + 2]) for k in range(0, len(whole), 2)]
    assert nodes == whole and all(merkle.folded(x, path) == whole[0] for x, path in zip(leaves, path_of, strict=True))


def test_a_tree_of_several_layers(spark):
    rows = [(i, "", "big" if i % 50 else "small", None, 1) for i in range(9001)]
    same(merkle.manifest(spark.createDataFrame(rows, DOCS), when=queries.remainder(7) == 0), brute_manifest(rows))
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_addresses_fill_the_array_and_keep_subtrees_together():
    for levels in range(1, 12):
        every = np.concatenate(merkle._layout(levels))
        assert sorted(every.tolist()) == list(range((1 << levels) - 1))
    where = merkle._layout(4)
    assert where[0].tolist() == [0] and sorted([*where[0], *where[1]]) == [0, 1, 2]
    for k in range(4):  # each bottom tree of two levels is one piece
        own = sorted([int(where[2][k]), *where[3][2 * k : 2 * k + 2].tolist()])
        assert own == list(range(3 + 3 * k, 6 + 3 * k))


def test_positions_over_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "", "x", "y"]), rng.randint(0, 50)) for _ in range(3000)]
    frame = scratch.written(spark.createDataFrame(rows, "k string, v long").repartition(5), "rows")
    got = [tuple(r) for r in order.numbered(frame, "k", ["v"]).collect()]
    expect = []
    for k in (None, "", "x", "y"):
        expect += [(k, v, i) for i, v in enumerate(sorted(v for key, v in rows if key == k))]
    assert sorted(map(str, got)) == sorted(map(str, expect))
