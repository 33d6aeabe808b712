"""How far the sources of a language differ in their words.

The counts of a language are a matrix of groups (sources) and terms, most of it zero. Its
columns are dealt into stripes of bounded width, its rows into blocks; a stripe of a block is
held as a K-squared tree (K = 2): each quadrant that isn't all zero has a node with four
children, down to small dense leaves. Two blocks are compared by walking both trees at once,
over pairs of quadrants of the same columns. A pair in which both are all zero is
never visited: there each group has one probability, so its columns are priced by one
product. The others end in leaves that are compared group by group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked, top
from .order import numbered
from .runs import TERM, runs
from .scratch import small, written
from .textnum import blocks

#: Probabilities are integers in units of one in ``SCALE``.
SCALE = 1_000_000_000
#: Columns of a stripe (about) and rows of a block.
STRIPE, ROWS = 4096, 256
LEAF = 8
#: Pairs of leaves that are compared at once.
PAIRS = 2048


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each term in a group and the number
    of its rows that hold it. Nulls read as ''. Texts are counted in blocks, so what is
    shuffled are the distinct terms of a block and not its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [batch.column(i).dictionary_encode() for i in (1, 2)]
            group = np.asarray(held[0].indices, dtype=np.int64) * max(len(held[1].dictionary), 1) + np.asarray(held[1].indices, dtype=np.int64)
            for block in blocks(batch.column(0), 1 << 22):
                words, first = runs(block, TERM)
                coded = words.dictionary_encode()
                width = max(len(coded.dictionary), 1)
                text_of = np.repeat(np.arange(block.n), np.diff(first))
                own, times = np.unique(text_of * width + np.asarray(coded.indices, dtype=np.int64), return_counts=True)
                cell, at = np.unique(group[block.first + own // width] * width + own % width, return_inverse=True)
                n = np.zeros(len(cell), dtype=np.int64)
                np.add.at(n, at, times)
                g = cell // width
                pick = lambda d, k: d.take(pa.array(k))
                k = max(len(held[1].dictionary), 1)
                yield pa.RecordBatch.from_arrays(
                    [pick(held[0].dictionary, g // k), pick(held[1].dictionary, g % k), pick(coded.dictionary, cell % width).cast(pa.string()), pa.array(n), pa.array(np.bincount(at, minlength=len(cell)).astype(np.int64))],
                    names=["lang", "source", "term", "n", "docs"],
                )

    empty = lambda x: F.coalesce(F.col(f"`{x}`").cast("string"), F.lit(""))
    counted = docs.select(empty(text).alias("text"), empty(lang).alias("lang"), empty(source).alias("source")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class K2Tree:
    """The nonzero quadrants of a matrix of ``rows`` x ``columns`` cells. ``levels[d][node]`` are the four
    children (row half, column half) of a node of depth d, -1 for an all-zero one;
    ``leaves[leaf]`` are the LEAF x LEAF values, ``floor`` of the row where a cell is zero. The matrix is
    filled up with zeros to a square of ``side`` or more (trees that are walked together share it)."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, floor: np.ndarray, columns: int, side: int = LEAF):
        side = max(len(floor), columns, side, LEAF)
        self.depth = max(side - 1, 0).bit_length() - (LEAF - 1).bit_length()
        self.floor = np.ones(LEAF << self.depth, dtype=np.int64)
        self.floor[: len(floor)] = floor
        self.columns = columns
        code = (row // LEAF) << 32 | column // LEAF
        nodes, leaf = np.unique(code, return_inverse=True)
        self.leaves = np.repeat(self.floor.reshape(-1, LEAF)[nodes >> 32][:, :, None], LEAF, axis=2)
        self.leaves[leaf, row % LEAF, column % LEAF] = value
        self.levels: list[np.ndarray] = []
        for _ in range(self.depth):
            r, c = nodes >> 32, nodes & 0xFFFFFFFF
            above, at = np.unique((r >> 1) << 32 | c >> 1, return_inverse=True)
            child = np.full((len(above), 4), -1, dtype=np.int64)
            child[at, (r & 1) * 2 + (c & 1)] = np.arange(len(nodes))
            self.levels.insert(0, child)
            nodes = above
        self.root = 0 if len(nodes) else -1

    def leaf_values(self, leaf: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Values of leaves (-1: all zero) at the block rows ``rows``."""
        flat = np.repeat(self.floor.reshape(-1, LEAF)[rows][:, :, None], LEAF, axis=2)
        full = leaf >= 0
        flat[full] = self.leaves[leaf[full]]
        return flat


def _below(tree: K2Tree, depth: int, node: np.ndarray, which: int) -> np.ndarray:
    out = np.full(len(node), -1, dtype=np.int64)
    full = node >= 0
    out[full] = tree.levels[depth][node[full], which]
    return out


def joint_leaves(a: K2Tree, b: K2Tree, rows_a: int, rows_b: int) -> tuple[np.ndarray, ...]:
    """Pairs of leaves ``(leaf of a, leaf of b, their row blocks, their column block)`` of the same
    columns, of which at least one isn't all zero. Where both trees are one, each pair
    of row blocks comes once."""
    u, v, i, k, j = (np.array([x], dtype=np.int64) for x in (a.root, b.root, 0, 0, 0))
    for d in range(a.depth):
        side = LEAF << (a.depth - d - 1)
        parts = []
        for which in range(8):
            di, dk, dj = which >> 2, which >> 1 & 1, which & 1
            u2, v2, i2, k2 = _below(a, d, u, di * 2 + dj), _below(b, d, v, dk * 2 + dj), i * 2 + di, k * 2 + dk
            keep = ((u2 >= 0) | (v2 >= 0)) & (i2 * side < rows_a) & (k2 * side < rows_b)
            if a is b:
                keep &= i2 <= k2
            parts.append([x[keep] for x in (u2, v2, i2, k2, j * 2 + dj)])
        u, v, i, k, j = (np.concatenate(x) for x in zip(*parts, strict=True))
    some = (u >= 0) | (v >= 0)
    return tuple(x[some] for x in (u, v, i, k, j))


def block_divergence(a: K2Tree, b: K2Tree, rows_a: int, rows_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all columns of ``(p - q) ** 2 // q``: of each row of ``a`` as p against each row of ``b`` as
    q, and of each row of ``b`` against each of ``a`` (transposed to the same shape)."""
    n_a, n_b = -(-rows_a // LEAF), -(-rows_b // LEAF)
    forth, back = (np.zeros((n_a, n_b, LEAF, LEAF), dtype=np.int64) for _ in range(2))
    met = np.zeros((n_a, n_b), dtype=np.int64)
    found = joint_leaves(a, b, rows_a, rows_b)
    for at in range(0, len(found[0]), PAIRS):
        u, v, i, k, j = (x[at : at + PAIRS] for x in found)
        p, q = a.leaf_values(u, i), b.leaf_values(v, k)
        width = np.minimum(a.columns - j * LEAF, LEAF)
        beyond = np.arange(LEAF)[None, :] >= width[:, None]  # columns after the last one
        p, q = np.where(beyond[:, None, :], 1, p)[:, :, None, :], np.where(beyond[:, None, :], 1, q)[:, None, :, :]
        away = (p - q) ** 2
        np.add.at(forth, (i, k), (away // q).sum(axis=3))
        np.add.at(back, (i, k), (away // p).sum(axis=3))
        np.add.at(met, (i, k), width)
    if a is b:  # the pairs of row blocks below the diagonal are those above it, turned
        low = np.tril_indices(n_a, -1)
        forth[low], back[low] = (x.transpose(1, 0, 3, 2)[low] for x in (back, forth))
        met[low] = met.T[low]
    wide = lambda x: x.transpose(0, 2, 1, 3).reshape(n_a * LEAF, n_b * LEAF)[:rows_a, :rows_b]
    zero = np.repeat(np.repeat(a.columns - met, LEAF, axis=0), LEAF, axis=1)[:rows_a, :rows_b]
    p, q = a.floor[:rows_a, None], b.floor[None, :rows_b]
    return wide(forth) + zero * ((p - q) ** 2 // q), wide(back) + zero * ((p - q) ** 2 // p)


def _compare(table: pa.Table) -> pa.Table:
    """Divergences of the group pairs of two row blocks over one stripe. Rows without a term
    are the groups, with the value of a zero cell; ``columns`` is the width of the stripe."""
    lang, low, high = (table.column(x)[0].as_py() for x in ("lang", "low", "high"))
    g, p = (np.asarray(table.column(x).combine_chunks(), dtype=np.int64) for x in ("g", "p"))
    heads = np.asarray(table.column("term").combine_chunks().is_null())
    columns = int(np.asarray(table.column("columns").combine_chunks().drop_null())[0])
    coded = table.column("term").combine_chunks().dictionary_encode()
    term = np.asarray(coded.indices.fill_null(-1), dtype=np.int64)
    frequent = np.argsort(-np.bincount(term[~heads], minlength=1), kind="stable")
    rank = np.empty_like(frequent)
    rank[frequent] = np.arange(len(frequent))  # frequent terms first: what is zero lies together

    def tree(block: int) -> tuple[K2Tree, int]:
        own = g // ROWS == block
        rows = int(own[heads].sum())
        floor = np.ones(rows, dtype=np.int64)
        floor[g[own & heads] % ROWS] = p[own & heads]
        cells = own & ~heads
        return K2Tree(g[cells] % ROWS, rank[term[cells]], p[cells], floor, columns, ROWS), rows

    a, rows_a = tree(low)
    b, rows_b = (a, rows_a) if low == high else tree(high)
    forth, back = block_divergence(a, b, rows_a, rows_b)
    i, k = np.indices(forth.shape).reshape(2, -1)
    first, second = low * ROWS + i, high * ROWS + k
    keep = first != second
    sides = [(first[keep], second[keep], forth.ravel()[keep])]
    if low != high:
        sides.append((second, first, back.ravel()))
    out = [np.concatenate(x) for x in zip(*sides, strict=True)]
    return pa.table({"lang": pa.array([lang] * len(out[0]), pa.string()), "g": out[0], "h": out[1], "value": out[2]})


def _probability(n: str, total: str) -> Column:
    """``1 + floor(SCALE * (n + 1) / (total + v))`` in whole numbers of any size; 1 without terms."""
    return F.expr(f"case when v = 0 then 1L else 1L + (cast({SCALE} as decimal(38, 0)) * cast({n} + 1 as decimal(19, 0))) div cast({total} + v as decimal(20, 0)) end")


def _away(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


class Audit:
    """Terms, groups and cells of ``docs``, each a written table that both reports read.
    ``groups(lang, source, g, v, p0, ...)``: all groups, numbered in their language, with its number of kept terms and
    the probability of a term that they lack. ``cells(lang, source, g, term, p, q, stripe)``: terms a group has."""

    def __init__(self, docs: DataFrame, least: int = 3, text: str = "text", lang: str = "lang", source: str = "source"):
        plain = lambda x, to: F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("")).alias(to)
        counts = written(term_counts(docs, text, lang, source), "counts")
        terms = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"), "terms")
        found = counts.drop("docs").join(terms, ["lang", "term"])
        every = written(docs.select(plain(lang, "lang"), plain(source, "source")).distinct(), "groups")
        # one row per language, counted before it is sent to all: rows are never dealt by language
        known = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
        spread = every.groupBy("lang").agg((F.floor((F.count("*") - 1) / ROWS) + 1).cast("long").alias("n_blocks"))
        langs = written(spread.join(known, "lang", "left").fillna(0, ["v", "n_lang"]), "langs")
        sizes = small(langs, langs.count())
        held = found.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
        sized = numbered(every, "lang", ["source"]).join(held, ["lang", "source"], "left").fillna(0, ["n_group"]).join(sizes, "lang")
        self.groups = written(sized.select("lang", "source", F.col("pos").alias("g"), "v", "n_blocks", "n_group", "n_lang", _probability("0", "n_group").alias("p0")), "groups")
        self.n_groups = self.groups.count()
        self.stripes = F.greatest(F.ceil(F.col("v") / STRIPE), F.lit(1)).cast("long")
        stripe = F.pmod(F.xxhash64("term"), self.stripes).alias("stripe")
        joined = found.join(small(self.groups, self.n_groups), ["lang", "source"])
        self.cells = written(joined.select("lang", "source", "g", "term", _probability("n", "n_group").alias("p"), _probability("total", "n_lang").alias("q"), stripe, "n_blocks"), "cells")
        self.widths = terms.join(sizes, "lang").select("lang", stripe).groupBy("lang", "stripe").agg(F.count("*").alias("columns"))

    def pairs(self) -> DataFrame:
        """``(lang, source, item, value)``: the divergence of each source from each other one of the
        language, over all its kept terms."""
        none = lambda kind: F.lit(None).cast(kind)
        heads = self.groups.select("lang", "g", "n_blocks", none("string").alias("term"), F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), self.stripes - 1)).alias("stripe"))
        heads = heads.join(self.widths, ["lang", "stripe"], "left").withColumn("columns", F.coalesce("columns", F.lit(0).cast("long")))
        rows = self.cells.select("lang", "g", "n_blocks", "term", "p", "stripe", none("long").alias("columns")).unionByName(heads)
        own = F.floor(F.col("g") / ROWS).cast("long")
        dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))).withColumn("low", F.least(own, "other")).withColumn("high", F.greatest(own, "other"))
        parts = dealt.select("lang", "low", "high", "stripe", "g", "term", "p", "columns").groupBy("lang", "low", "high", "stripe").applyInArrow(_compare, "lang string, g long, h long, value long")
        sums = parts.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
        names = small(self.groups.select("lang", "g", "source"), self.n_groups)
        items = small(self.groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), self.n_groups)
        return sums.join(names, ["lang", "g"]).join(items, ["lang", "h"]).select("lang", "source", "item", "value")

    def terms(self, most: int = 200) -> DataFrame:
        """``(lang, source, item, value, rank)``: the ``most`` terms that a source has more often than its language.
        A group's terms are first cut in parts, then together."""
        more = self.cells.where("p > q").select("lang", "source", F.col("term").alias("item"), _away("p", "q").alias("value"), F.pmod(F.xxhash64("term"), F.lit(32)).alias("part"))
        first = top(more, ["lang", "source", "part"], [F.desc("value"), "item"], most).drop("rank", "part")
        return top(first, ["lang", "source"], [F.desc("value"), "item"], most)


def divergence(docs: DataFrame, least: int = 3, most: int = 200, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: the parts ``pair`` and ``term`` of an ``Audit``, ranked by value,
    then item. Only the three named columns are read; each row is a document, whatever its id.
    Null texts, languages and sources read as ''. A source alone in its language has no pairs, a language
    without kept terms has pairs of value 0; an empty table gives no rows. All arithmetic is in whole numbers."""
    audit = Audit(docs, least, text, lang, source)
    pairs = ranked(audit.pairs(), ["lang", "source"], [F.desc("value"), "item"])
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return shape(pairs, "pair").unionByName(shape(audit.terms(most), "term"))
