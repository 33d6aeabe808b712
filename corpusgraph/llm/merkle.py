"""A Merkle manifest of a table: a tree of digests for each language, and one over their roots.

The leaves of a language, in the order of their ids, are cut into aligned blocks of
``2 ** HEIGHT``; each block's subtree is stored as one array of digests in van Emde Boas order: a
tree is split at half its height into a top tree and bottom trees, each stored in one
piece and split again. Where a node lies follows from its depth and index alone, so the same
arithmetic serves construction, siblings and proofs, whatever the size of a cache line. The roots of the blocks
are the leaves of the next layer, until a language has one root; the roots of the languages are
treated alike.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered
from .scratch import small, written

#: Levels below the root of a block's subtree: 4,096 leaves.
HEIGHT = 12


def digest(*parts: str) -> str:
    """Lower-case hex SHA-256 of the parts, one after another."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def veb_address(depth: np.ndarray, index: np.ndarray, levels: int) -> np.ndarray:
    """Where the nodes of a tree of ``levels`` levels lie: ``index`` counts them from the left at
    their ``depth`` (the root has 0)."""
    depth, index = np.asarray(depth, dtype=np.int64).copy(), np.asarray(index, dtype=np.int64).copy()
    base = np.zeros_like(depth)
    todo = [(np.arange(len(depth)), levels)]
    while todo:
        own, size = todo.pop()
        if size == 1 or not len(own):
            continue
        high = size // 2  # levels of the top tree
        under = depth[own] >= high
        todo.append((own[~under], high))
        low = own[under]
        d = depth[low] - high
        base[low] += (1 << high) - 1 + (index[low] >> d) * ((1 << (size - high)) - 1)
        index[low] &= (1 << d) - 1
        depth[low] = d
        todo.append((low, size - high))
    return base


@lru_cache(maxsize=32)
def _layout(levels: int) -> list[np.ndarray]:
    """Addresses of the nodes of each depth, from the left."""
    return [veb_address(np.full(1 << d, d), np.arange(1 << d), levels) for d in range(levels)]


def subtree(leaves: list[str], height: int) -> list[str | None]:
    """The nodes over ``leaves`` (at most ``2 ** height``) in van Emde Boas order; a node over two is
    the digest of both, over one the digest of that one, over none None."""
    where = _layout(height + 1)
    out: list[str | None] = [None] * ((2 << height) - 1)
    for k, x in enumerate(leaves):
        out[where[height][k]] = x
    n = len(leaves)
    for d in range(height - 1, -1, -1):
        below, here = where[d + 1], where[d]
        n, had = (n + 1) // 2, n
        for k in range(n):
            left = out[below[2 * k]]
            out[here[k]] = digest(left, out[below[2 * k + 1]]) if 2 * k + 1 < had else digest(left)
    return out


def siblings(nodes: list[str | None], height: int, leaf: int) -> list[str]:
    """From a leaf of a subtree to below its root, what it is hashed with: ``L`` or ``R`` and the
    digest of the sibling on that side, or ``-`` where it stands alone."""
    where = _layout(height + 1)
    out = []
    for d in range(height, 0, -1):
        other = nodes[where[d][leaf ^ 1]]
        out.append("-" if other is None else ("L" if leaf & 1 else "R") + other)
        leaf >>= 1
    return out


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for x in path:
        leaf = digest(leaf) if x == "-" else digest(x[1:], leaf) if x[0] == "L" else digest(leaf, x[1:])
    return leaf


def field(value: Column) -> Column:
    """A field of a leaf: ``-`` for null, else its size in UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _height(n: int) -> int:
    """The height of the subtree that a block of a sequence of ``n`` nodes has: the last layer's
    ends where one node remains."""
    return min(HEIGHT, max(n - 1, 0).bit_length())


def _built(table: pa.Table) -> pa.Table:
    """The subtree of one block of nodes ``(tree, block, pos, n, digest)``."""
    table = table.sort_by("pos")
    n = table.column("n")[0].as_py()
    nodes = subtree(table.column("digest").to_pylist(), _height(n))
    root = nodes[0]
    return pa.table({"tree": table.column("tree").slice(0, 1), "block": table.column("block").slice(0, 1), "n": table.column("n").slice(0, 1), "root": [root], "nodes": pa.array([nodes], pa.list_(pa.string()))})


def layers(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of all layers over ``nodes(tree, pos, n, digest)``, lowest first, as tables ``(tree,
    block, n, root, nodes)`` with the number ``n`` of nodes in the layer of that tree. Each layer is
    built from the roots of the one below; the last has one block in each tree."""
    out = []
    while True:
        blocked = nodes.select("tree", F.shiftright("pos", HEIGHT).alias("block"), "pos", "n", "digest")
        built = written(blocked.groupBy("tree", "block").applyInArrow(_built, "tree long, block long, n long, root string, nodes array<string>"), "layer")
        out.append(built)
        more = built.where(F.col("n") > 1 << HEIGHT)
        if more.isEmpty():
            return out
        nodes = built.select("tree", F.col("block").alias("pos"), (F.shiftright(F.col("n") - 1, HEIGHT) + 1).alias("n"), F.col("root").alias("digest")).where(F.col("n") > 0)


def roots(built: list[DataFrame]) -> DataFrame:
    """``(tree, subroot)`` of the trees of some layers."""
    return built[-1].select("tree", F.col("root").alias("subroot"))


def paths(built: list[DataFrame], above: DataFrame) -> DataFrame:
    """``(tree, block, nodes, n, path)`` of the lowest blocks, where ``path`` leads from a block's root through
    the layers over it, and on along ``above(tree, path)`` from the tree's root."""
    top = built[-1].join(above, "tree")
    for lower in reversed(built[:-1]):
        child = top.groupBy("tree", "block").applyInArrow(_children, "tree long, block long, path array<string>")
        top = lower.join(child, ["tree", "block"])
    return top.select("tree", "block", "n", "nodes", "path")


def _children(table: pa.Table) -> pa.Table:
    tree, block, n, nodes, path = (table.column(x)[0].as_py() for x in ("tree", "block", "n", "nodes", "path"))
    held = range(min(n - (block << HEIGHT), 1 << HEIGHT))
    rows = [siblings(nodes, _height(n), k) + path for k in held]
    return pa.table({"tree": pa.array([tree] * len(rows), pa.int64()), "block": pa.array([(block << HEIGHT) + k for k in held], pa.int64()), "path": pa.array(rows, pa.list_(pa.string()))})


def _proved(rows: pa.Table, blocks: pa.Table) -> pa.Table:
    """The proof of each leaf of a block, and the root that its own or its changed digest leads to."""
    n, nodes, path = (blocks.column(x)[0].as_py() for x in ("n", "nodes", "path"))
    root = blocks.column("root")[0].as_py()
    leaf, changed, pos = (rows.column(x).to_pylist() for x in ("leaf", "changed", "pos"))
    proofs, ends = [], []
    for own, other, k in zip(leaf, changed, pos, strict=True):
        way = siblings(nodes, _height(n), k & ((1 << HEIGHT) - 1)) + path
        proofs.append(digest(*(x[1:] for x in way)))
        ends.append(folded(other or own, way))
    return pa.table({"id": rows.column("id"), "tree": rows.column("tree"), "leaf": rows.column("leaf"), "proof_sha256": proofs, "folded_root": ends, "verified": [x == root for x in ends]})


class Manifest:
    """The trees of ``docs``. ``leaves(id, lang, leaf, changed, tree, pos, n)``: a row per document; ``low``: the blocks
    over the leaves of each language, layer by layer; ``high``: those over the subroots;
    ``languages(lang, tree, n)``. ``fields`` are hashed in this order; ``changed`` is the leaf with one more in ``tamper``, where
    the condition ``when`` holds."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tamper: str = "n_chars", when: Column | None = None):
        plain = F.sha2(F.concat(*(field(F.col(f"`{x}`")) for x in fields)), 256)
        other = F.sha2(F.concat(*(field(F.col(f"`{x}`").cast("decimal(38,0)") + 1 if x == tamper else F.col(f"`{x}`")) for x in fields)), 256)
        changed = F.when(when if when is not None else F.lit(False), other)
        leaves = written(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group}`").alias("lang"), plain.alias("leaf"), changed.alias("changed")), "leaves")
        placed = numbered(leaves, "lang", [F.asc_nulls_first("id"), "leaf"])
        sizes = written(leaves.groupBy("lang").agg(F.count("*").alias("n")).withColumn("none", F.lit(0)), "sizes")
        self.languages = written(numbered(sizes, "none", [F.asc_nulls_first("lang")]).select("lang", "n", F.col("pos").alias("tree")), "languages")
        side = self.languages.withColumnRenamed("lang", "of")
        self.leaves = written(placed.join(side, placed["lang"].eqNullSafe(side["of"])).drop("of"), "placed")
        self.low = layers(self.leaves.select("tree", "pos", "n", F.col("leaf").alias("digest")))
        subroots = roots(self.low)
        number = self.languages.count()
        self.high = layers(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(number).cast("long").alias("n"), F.col("subroot").alias("digest")))

    def proofs(self) -> DataFrame:
        """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of each document."""
        root = F.lit((self.high[-1].first() or [None] * 5)[3]).cast("string").alias("root")
        none = F.expr("cast(array() as array<string>)")
        top = paths(self.high, self.high[-1].select("tree", none.alias("path")))
        above = top.groupBy("tree", "block").applyInArrow(_children, "tree long, block long, path array<string>").select(F.col("block").alias("tree"), "path")
        blocks = paths(self.low, above).select("*", root)
        own = self.leaves.select("id", "tree", F.shiftright("pos", HEIGHT).alias("block"), "pos", "leaf", "changed")
        kind = self.leaves.schema["id"].dataType.simpleString()
        found = own.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(_proved, f"id {kind}, tree long, leaf string, proof_sha256 string, folded_root string, verified boolean")
        subroots = roots(self.low)
        return found.join(small(subroots, subroots.count()), "tree").select("id", "leaf", "subroot", root, "proof_sha256", "folded_root", "verified")


def manifest(docs: DataFrame, when: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row of ``docs(doc_id, source, lang, n_chars,
    text)``; ``when`` tells which rows are tampered with.

    A null language is one of its own and the first, a null field is ``-``; rows without an id come first in
    their language, rows that share one are ordered by their leaf (equal leaves are the same in any order). A row whose
    changed field is null keeps its leaf. An empty table gives no rows; columns beyond the five are ignored."""
    return Manifest(docs, when=when).proofs().withColumnRenamed("id", "doc_id")
