"""Exact top-k inner products by dual-tree cover-tree search.

Vectors are dealt to the nearest of a sample of pivots (their number follows the data) and
cut into bounded blocks, queries likewise by the nearest of fewer pivots; each block gets a
cover tree: a node's centre is one of its points and the centre of its first child, children
are within its radius and further apart than half of it, and radii are those of the points
really covered. Every query starts with the k best scores among the pivots, which are real
candidates. Blocks of queries meet those blocks of vectors whose bound
``q.c + |q| R + |c| r + r R`` reaches the group's worst k-th score, and inside a pair of
blocks both trees are walked together, pruning node pairs by the same bound. Scores are
integers, computed exactly.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .near_dedup import _groups
from .scratch import small, written

SCALE, TOP, QUERY_EVERY = 256, 5, 50
#: Vectors and queries in a block at most about; vectors for each pivot.
BLOCK, QUERY_BLOCK, PIVOT_ROWS = 1024, 256, 512
#: Pivots of one vector length, and numbers in them, at most: the size of a broadcast.
MAX_PIVOTS, PIVOT_NUMBERS = 4096, 1 << 22
#: Points in a leaf; covering radii shrink by this factor from level to level.
LEAF, SHRINK = 16, 0.5
#: Blocks of queries that a task holds, and blocks of vectors that it meets, about.
GROUPS, SLICE = 16, 64
#: Points of leaves whose scores are computed at a time.
BATCH = 256
#: No score is smaller or larger than these.
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: Larger products than this lose bits as doubles and are computed in integers.
_EXACT = float(1 << 52)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` and ``b``; one that doesn't fit in
    a long stops at the long's limits."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if most < _EXACT:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.array([max(-_MOST, min(_MOST, x)) for x in exact.ravel().tolist()], dtype=np.int64).reshape(exact.shape)


@dataclass
class Tree:
    """A cover tree: node ``i`` covers the points ``lo[i]:hi[i]`` within ``radius[i]`` of
    point ``middle[i]`` and has the children ``child[i]:child[i] + n_child[i]``. ``points``
    and ``ids`` are in tree order."""

    points: np.ndarray
    ids: np.ndarray
    kth: np.ndarray
    middle: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    child: np.ndarray
    n_child: np.ndarray

    def __post_init__(self) -> None:
        self.flat = self.points.astype(np.float64)
        self.center = self.flat[self.middle]
        self.norm = np.sqrt((self.center**2).sum(axis=1))
        self.most = float(np.abs(self.flat).max())

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        held = np.load(io.BytesIO(raw))
        return cls(*(held[f.name] for f in fields(cls)))


def build(points: np.ndarray, ids: np.ndarray, kth: np.ndarray | None = None) -> Tree:
    """The tree of a block's points (at least one)."""
    values = points.astype(np.float64)
    order = np.arange(len(points))
    away = ((values - values.mean(axis=0)) ** 2).sum(axis=1)
    middle, radius, lo, hi, child, n_child = [], [], [], [], [], []

    def node(a: int, b: int, center: int) -> None:
        middle.append(center)
        radius.append(float(np.sqrt(((values[order[a:b]] - values[center]) ** 2).sum(axis=1).max())))
        lo.append(a)
        hi.append(b)
        child.append(0)
        n_child.append(0)

    node(0, len(points), int(np.argmin(away)))
    i = 0
    while i < len(lo):
        a, b = lo[i], hi[i]
        if b - a > LEAF and radius[i] > 0:
            own, reach = order[a:b], radius[i] * SHRINK
            # a greedy net, from the node's own centre on: each new centre is the point farthest from all so far
            far, part, centers, at = np.full(len(own), np.inf), np.zeros(len(own), dtype=np.int64), [], middle[i]
            while True:
                gap = np.sqrt(((values[own] - values[at]) ** 2).sum(axis=1))
                closer = gap < far
                far[closer], part[closer] = gap[closer], len(centers)
                centers.append(at)
                k = int(np.argmax(far))
                if far[k] <= reach:
                    break
                at = int(own[k])
            order[a:b] = own[np.argsort(part, kind="stable")]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=len(centers)))]).tolist()
            child[i] = len(lo)
            for x, y, center in zip(cuts, cuts[1:], centers, strict=False):
                if y > x:
                    node(a + x, a + y, center)
                    n_child[i] += 1
        i += 1
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    most = float(np.abs(values).max())
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    kth = np.full(len(points), _LEAST) if kth is None else kth
    as_int = lambda x: np.array(x, dtype=np.int64)
    return Tree(points[order].astype(kind), ids[order], kth[order], place[as_int(middle)], np.array(radius), as_int(lo), as_int(hi), as_int(child), as_int(n_child))


def bound(q: Tree, i: int, d: Tree, j: np.ndarray) -> np.ndarray:
    """No query below ``i`` has a larger inner product with a vector below ``j``; stops, as
    scores do, at the limits of a long."""
    top = d.center[j] @ q.center[i] + q.norm[i] * d.radius[j] + d.norm[j] * q.radius[i] + q.radius[i] * d.radius[j]
    slack = 1e-9 * (q.norm[i] + q.radius[i]) * (d.norm[j] + d.radius[j]) + 1e-6
    return np.clip(top + slack, float(_LEAST), float(_MOST))


class Best:
    """The ``k`` best of each query (in its tree's order): scores and ids, ties to smaller
    ids; ``kth`` is the score that a candidate must reach."""

    def __init__(self, kth: np.ndarray, k: int):
        self.k, self.kth = k, kth.astype(np.int64).copy()
        self.score: list[np.ndarray] = [np.zeros(0, np.int64)] * len(kth)
        self.id: list[np.ndarray] = [np.zeros(0, np.int64)] * len(kth)

    def add(self, first: int, own: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores (queries x ids) of the queries from ``first`` on, whose own ids are ``own``."""
        good = (scores >= self.kth[first : first + len(own)][:, None]) & (ids[None, :] != own[:, None])
        for x in np.flatnonzero(good.any(axis=1)).tolist():
            row, hit = first + x, np.flatnonzero(good[x])
            score, name = np.concatenate([self.score[row], scores[x][hit]]), np.concatenate([self.id[row], ids[hit]])
            best = np.lexsort((name, -score.astype(object) if score.min() == _LEAST else -score))[: self.k]
            self.score[row], self.id[row] = score[best], name[best]
            if len(best) == self.k:
                self.kth[row] = max(self.kth[row], self.score[row][-1])


def dual_search(q: Tree, d: Tree, best: Best) -> int:
    """Walk both trees; returns the number of products that were computed."""
    todo, done = [(0, np.zeros(1, dtype=np.int64))], 0
    plain = q.most * d.most * q.points.shape[1] < _EXACT
    while todo:
        i, j = todo.pop()
        a, b = int(q.lo[i]), int(q.hi[i])
        top = bound(q, i, d, j)
        keep = top >= float(best.kth[a:b].min())
        j, top = j[keep], top[keep]
        if not len(j):
            continue
        inner = d.n_child[j] > 0
        if q.n_child[i] and (not inner.any() or q.radius[i] >= d.radius[j[inner]].max()):
            todo += [(x, j) for x in range(int(q.child[i]), int(q.child[i] + q.n_child[i]))]
        elif inner.any():
            up, n = j[inner], d.n_child[j[inner]]
            kids = np.repeat(d.child[up] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            todo.append((i, np.concatenate([j[~inner], kids])))
        else:
            order = np.argsort(-top, kind="stable")
            j, top = j[order], top[order]
            size = np.cumsum(d.hi[j] - d.lo[j])
            at = 0
            while at < len(j) and top[at] >= float(best.kth[a:b].min()):  # most promising first
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH, side="right")))
                points = np.concatenate([np.arange(x, y) for x, y in zip(d.lo[j[at:to]].tolist(), d.hi[j[at:to]].tolist(), strict=True)])
                scores = np.rint(q.flat[a:b] @ d.flat[points].T).astype(np.int64) if plain else dots(q.points[a:b], d.points[points])
                best.add(a, q.ids[a:b], d.ids[points], scores)
                done += scores.size
                at = to
    return done


def quantised(embeddings: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, v array<long>)``: each component as floor(scale * x), x as double; rows
    with a null vector, or a null or non-finite component, are left out, and so are null
    ids and empty vectors."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall(F.col("x"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return embeddings.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null and size(x) > 0").where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def pivots_of(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a sample for each vector length that fills more than a block, about one of
    ``PIVOT_ROWS`` and at most about ``MAX_PIVOTS`` (fewer of long vectors)."""
    counts = {r.dim: r.n for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).collect()}
    if not counts:
        return {}
    share = [(dim, int((1 << 30) * min(1.0, min(MAX_PIVOTS, n / PIVOT_ROWS, PIVOT_NUMBERS / dim) / n)) + 1) for dim, n in counts.items()]
    limits = vectors.sparkSession.createDataFrame(share, "dim int, most long")
    some = vectors.join(F.broadcast(limits), "dim").where(F.pmod(F.xxhash64("vec_id", F.lit("pivot")), F.lit(1 << 30)) < F.col("most"))
    some = some.groupBy("dim", "vec_id").agg(F.min("v").alias("v")).orderBy(F.xxhash64("vec_id"), "vec_id").toPandas()
    return {dim: (own["vec_id"].to_numpy(), np.array(own["v"].tolist(), dtype=np.int64)) for dim, own in some.groupby("dim")}


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)


def search(embeddings: DataFrame, k: int = TOP, every: int = QUERY_EVERY, scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each vector whose id is divisible by
    ``every``, its ``k`` largest inner products with other rows, ties to smaller ids.

    Reads ``vec_id`` and ``embedding`` alone. Vectors of different lengths are searched
    apart. Rows of a repeated id are one candidate each and, as queries, one query (the
    smallest vector). A score stops at the limits of a long. No vectors, or no query,
    give no rows."""
    spark = embeddings.sparkSession
    vectors = quantised(embeddings, scale).withColumn("dim", F.size("v"))
    pivots = pivots_of(vectors)
    shared = spark.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim_of = batch.column(2).to_numpy()
            near, group, kth = np.zeros(len(batch), dtype=np.int32), np.zeros(len(batch), dtype=np.int32), np.full(len(batch), _LEAST, dtype=np.int64)
            for dim in np.unique(dim_of).tolist():
                if dim not in shared.value:
                    continue
                rows = np.flatnonzero(dim_of == dim)
                own = _matrix(batch.column(1).take(pa.array(rows)))
                ids, centers = shared.value[dim]
                flat, net = own.astype(np.float64), centers.astype(np.float64)
                away = (net**2).sum(axis=1)[None, :] - 2 * flat @ net.T
                near[rows] = away.argmin(axis=1)
                names = batch.column(0).to_numpy()[rows]
                asked = np.flatnonzero(names % every == 0)
                if len(asked):
                    few = max(1, len(ids) * PIVOT_ROWS // (every * QUERY_BLOCK))
                    group[rows[asked]] = away[asked, :few].argmin(axis=1)
                    score = dots(own[asked], centers)
                    score[names[asked][:, None] == ids[None, :]] = _LEAST
                    if score.shape[1] >= k:
                        kth[rows[asked]] = np.partition(score, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(near), pa.array(group), pa.array(kth)], names=["vec_id", "v", "dim", "pivot", "group", "kth"])

    dealt = vectors.mapInArrow(deal, "vec_id long, v array<long>, dim int, pivot int, group int, kth long").withColumn("row", F.monotonically_increasing_id())
    dealt = written(dealt, "dealt")
    asked = dealt.where(F.col("vec_id") % every == 0).groupBy("dim", "vec_id").agg(F.min(F.struct("v", "group", "kth", "row")).alias("x")).select("dim", "vec_id", "x.*")
    # of a repeated id that is asked in several lengths, the smallest vector is the query
    asked = written(asked.groupBy("vec_id").agg(F.min(F.struct("v", "dim", "group", "kth", "row")).alias("x")).select("vec_id", "x.*"), "asked")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dim", "a", "b", "center", "radius", "worst", "tree"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.binary()]
        for t in _groups(batches, 3):
            tree = build(_matrix(t["v"]), t["vec_id"].to_numpy(), t["kth"].to_numpy())
            row = [*(t[x][0].as_py() for x in ("dim", "a", "b")), tree.center[0].tolist(), float(tree.radius[0]), int(tree.kth.min()), tree.dump()]
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=names)

    def blocked(rows: DataFrame, by: str, most: int, name: str) -> DataFrame:
        parts = written(rows.groupBy("dim", by).agg(F.count("*").alias("n"), F.ceil(F.count("*") / most).cast("int").alias("parts")), "parts")
        keyed = rows.join(small(parts, parts.count()), ["dim", by]).select("dim", F.col(by).alias("a"), F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("b"), "vec_id", "v", "kth")
        packed = keyed.repartition("dim", "a", "b").sortWithinPartitions("dim", "a", "b").mapInArrow(pack, "dim int, a int, b int, center array<double>, radius double, worst long, tree binary")
        return written(packed, name)

    left = blocked(asked, "group", QUERY_BLOCK, "query-blocks")
    right = blocked(dealt, "pivot", BLOCK, "vector-blocks")
    # some blocks of queries together are a crew; a crew meets a block of vectors if one of its bounds says so
    crews = left.groupBy("dim").agg(F.ceil(F.count("*") / GROUPS).cast("int").alias("crews"))
    crew_of = left.join(F.broadcast(crews), "dim").withColumn("crew", F.pmod(F.xxhash64("a", "b"), F.col("crews")).cast("int"))
    q = crew_of.select("dim", "crew", F.col("center").alias("q_center"), F.col("radius").alias("q_radius"), "worst")
    d = right.select("dim", "a", "b", "center", "radius").join(F.broadcast(crews), "dim").withColumn("crew", F.explode(F.sequence(F.lit(0), F.col("crews") - 1)))
    q_norm, d_norm = F.sqrt(_dot(F.col("q_center"), F.col("q_center"))), F.sqrt(_dot(F.col("center"), F.col("center")))
    reach = _dot(F.col("center"), F.col("q_center")) + q_norm * F.col("radius") + d_norm * F.col("q_radius") + F.col("radius") * F.col("q_radius")
    reach = F.least(reach + 1e-9 * (q_norm + F.col("q_radius")) * (d_norm + F.col("radius")) + 1e-6, F.lit(float(_MOST)))
    met = d.join(q, ["dim", "crew"]).withColumn("reach", reach).where(F.col("reach") >= F.col("worst").cast("double")).groupBy("dim", "crew", "a", "b").agg(F.max("reach").alias("reach"))
    met = written(met, "met")
    slices = met.groupBy("dim", "crew").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    slices = written(slices, "slices")
    with_slices = lambda x: x.join(small(slices, slices.count()), ["dim", "crew"])
    blocks = with_slices(met.join(right.select("dim", "a", "b", "tree"), ["dim", "a", "b"])).select("dim", "crew", F.pmod(F.xxhash64("a", "b"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("kind"), (-F.col("reach")).alias("place"), "tree")
    asking = with_slices(crew_of).select("dim", "crew", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("kind"), F.lit(0.0).alias("place"), "tree")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a crew's trees with their best so far, then the blocks of vectors, most promising first
        held: list[tuple[Tree, Best]] = []
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            for tree, best in held:
                n = [len(x) for x in best.score]
                if sum(n):
                    columns = (np.repeat(tree.ids, n), np.concatenate(best.id), np.concatenate(best.score))
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(len(batch)):
                key = tuple(batch.column(x)[row].as_py() for x in range(3))
                if key != now:
                    yield from out()
                    held, now = [], key
                tree = Tree.load(batch.column(5)[row].as_py())
                if batch.column(3)[row].as_py() == 0:
                    held.append((tree, Best(tree.kth, k)))
                else:
                    for asked_, best in held:
                        dual_search(asked_, tree, best)
        yield from out()

    work = blocks.unionByName(asking).repartition("dim", "crew", "slice").sortWithinPartitions("dim", "crew", "slice", "kind", "place")
    found = work.mapInArrow(walk, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
