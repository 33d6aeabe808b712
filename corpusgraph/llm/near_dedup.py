"""Near-duplicate detection with SetSketch registers.

Each text becomes its set of distinct word shingles. A register is the smallest of
one hash function's exponential variates over the set, on an exponentially spaced,
truncated scale: ``clip(floor(1 - log_b(min h)), 0, q + 1)``. Registers merge by
maximum and agree with a probability close to the sets' Jaccard similarity.

1. rows with equal sets form one class (pre-aggregated by a 128-bit set digest), a node
   of the graph of links;
2. nodes are banded; in each band bucket every node is compared with the bucket's first
   and last node, sketches first (sizes and joint likelihood estimate), then full sets.
   This is linear in a bucket and joins the true copies in it;
3. only buckets whose nodes are still in different components are compared further, in
   blocks of bounded chunks: sketches first, then the sets of the nodes that may be
   linked. A block hands on a spanning forest of its verified links, never its pairs;
4. components of the links are carried back to all rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import components
from .scratch import private, small, spread_join, unit, written
from .textnum import SHINGLE, blocks, shingle_hashes

#: Registers in a band; a link at the threshold meets in no band with a probability of at most MISS.
ROWS, MISS = 6, 4.1e-8
#: SetSketch parameters for two-byte registers.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: Standard errors of the likelihood estimate below the threshold that are still verified.
MARGIN = 5.5
#: Members of a star in one part, and nodes and shingles in one chunk of a bucket, at most about.
PART, CHUNK, CHUNK_SHINGLES = 512, 512, 1 << 20


def bands_for(percent: int) -> int:
    """Bands that a threshold needs: 36 at 0.85, 56 at 0.80."""
    return max(1, math.ceil(math.log(MISS) / math.log1p(-((min(percent, 99) / 100) ** ROWS))))


@lru_cache(maxsize=8)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of ``n`` hash functions."""
    rng = np.random.default_rng(7)
    mul = rng.integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return mul, rng.integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2)


def registers(shingles: np.ndarray, begin: np.ndarray, n: int = 36 * ROWS) -> np.ndarray:
    """SetSketch registers (texts x n, uint16) of nonempty runs of shingles."""
    mul, add = _functions(n)
    least = np.empty((n, len(begin)), dtype=np.uint64)
    for k in range(n):
        np.minimum.reduceat(shingles * mul[k] + add[k], begin, out=least[k])
    uniform = (least.T.astype(np.float64) + 0.5) / 2.0**64
    return np.clip(np.floor(1 - np.log(-np.log1p(-uniform) / RATE) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(left, right)


def joint_estimate(above: np.ndarray, below: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, n: int = 36 * ROWS) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the numbers of registers in which
    the left sketch is above or below the right one, of ``n``, given both set sizes."""
    u = n_left / (n_left + n_right)
    v = 1 - u
    equal = n - above - below
    chance = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    slope = lambda x: (BASE - 1) / BASE / (1 - x * (BASE - 1) / BASE) / np.log(BASE)
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):  # the log likelihood is concave: bisect its derivative
        j = (lo + hi) / 2
        p, m = chance(u - v * j), chance(v - u * j)
        dp, dm = -v * slope(u - v * j), -u * slope(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            rise = np.where(above > 0, above * dp / p, 0) + np.where(below > 0, below * dm / m, 0) - equal * (dp + dm) / (1 - p - m)
        up = rise > 0
        lo, hi = np.where(up, j, lo), np.where(up, hi, j)
    return (lo + hi) / 2


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, sorted distinct shingle hashes)`` of each text."""
    for block in blocks(column):
        starts, ends, first = block.words()
        hashes, begin = shingle_hashes(block.hashes(starts, ends, fold=True), first, width)
        for i in range(block.n):
            yield block.first + i, np.unique(hashes[begin[i] : begin[i + 1]])


def signatures(docs: DataFrame, width: int = SHINGLE, n: int = 36 * ROWS) -> DataFrame:
    """``(doc_id, unit, n_shingles, digest, sketch)`` of every row of ``docs(doc_id, unit,
    text)``; texts without words have size 0 and null digest and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = np.zeros(len(batch), dtype=np.int64), [None] * len(batch), [None] * len(batch)
            held, rows, many = [], [], 0

            def flush():
                if held:
                    begin = np.concatenate([[0], np.cumsum([len(x) for x in held])])[:-1]
                    for row, sketch in zip(rows, registers(np.concatenate(held), begin, n), strict=True):
                        sketches[row] = sketch.tobytes()

            for row, own in shingle_sets(batch.column(2), width):
                sizes[row] = len(own)
                if len(own):
                    digests[row] = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    held.append(own)
                    rows.append(row)
                    many += len(own)
                    if many > 1 << 16:
                        flush()
                        held, rows, many = [], [], 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "unit", "n_shingles", "digest", "sketch"])

    return docs.select("doc_id", "unit", "text").mapInArrow(run, "doc_id long, unit binary, n_shingles long, digest binary, sketch binary")


def band_hashes(sketch: Column, bands: int) -> Column:
    """One 64-bit hash for each band of a sketch."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(sketch, i * (2 * ROWS) + 1, F.lit(2 * ROWS))))


def may_link(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches (rows of ``a`` and ``b``) of sets of the given sizes can
    belong to a link: fitting sizes, and a likelihood estimate not far below the threshold."""
    likely = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    n, limit = a.shape[1], percent / 100
    # registers agree at least as often as sets overlap, so few equal ones rule a link out
    fewest = n * (limit - (MARGIN + 2) * math.sqrt(limit * (1 - limit) / n))
    for at in range(0, len(a), 4096):
        likely[at : at + 4096] &= (a[at : at + 4096] == b[at : at + 4096]).sum(axis=1) >= fewest
        rows = at + np.flatnonzero(likely[at : at + 4096])
        if not len(rows):
            continue
        guess = joint_estimate((a[rows] > b[rows]).sum(axis=1), (a[rows] < b[rows]).sum(axis=1), n_a[rows].astype(float), n_b[rows].astype(float), n)
        likely[rows] = guess >= limit - MARGIN * math.sqrt(limit * (1 - limit) / n)
    return likely


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes are linked."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree in their first ``n_keys`` columns; rows are sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for at, to in zip(cuts, cuts[1:], strict=False):
            if to > at:
                if (key := keys[:, at].tolist()) != last and held:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(at, to - at))
                last = key
    if held:
        yield pa.Table.from_batches(held)


def _sketches(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), n)


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in column.to_pylist()]


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def star_links(stars: DataFrame, nodes: DataFrame, n_registers: int, percent: int) -> DataFrame:
    """The verified ones of ``stars(hub, node)``, as ``(a, b)``. A star is dealt in parts
    of about ``PART`` members, and each part gets a row of its hub; sketches are compared
    first, and only what may be linked meets with its set."""

    def dealt(pairs: DataFrame, value: str) -> DataFrame:
        parts = written(pairs.groupBy("hub").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PART).cast("int").alias("parts")), "stars")
        members = spread_join(pairs, parts, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", F.lit(1).alias("member"))
        hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"), F.lit(0).alias("member"))
        rows = hubs.unionByName(members).join(nodes.select("node", "n_shingles", value), "node")
        return rows.select("hub", "part", "member", "node", "n_shingles", value).repartition("hub", "part").sortWithinPartitions("hub", "part", "member")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 2):
            sketches, size = _sketches(t["sketch"], n_registers), t["n_shingles"].to_numpy()
            hub, one = np.broadcast_to(sketches[:1], (len(t) - 1, n_registers)), np.full(len(t) - 1, size[0])
            rows = 1 + np.flatnonzero(may_link(hub, sketches[1:], one, size[1:], percent))
            if len(rows):
                yield _pairs(t["hub"].to_numpy()[rows], t["node"].to_numpy()[rows])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 2):
            sets = _sets(t["shingles"])
            rows = [k for k in range(1, len(t)) if linked(sets[0], sets[k], percent)]
            if rows:
                yield _pairs(t["hub"].to_numpy()[rows], t["node"].to_numpy()[rows])

    likely = written(dealt(stars, "sketch").mapInArrow(near, "a long, b long"), "likely")
    return dealt(likely.select(F.col("a").alias("hub"), F.col("b").alias("node")), "shingles").mapInArrow(check, "a long, b long")


def block_links(places: DataFrame, nodes: DataFrame, n_registers: int, percent: int) -> DataFrame:
    """A spanning forest of the links between nodes of one bucket that are in different
    components; ``places(bucket, node, component)`` has the buckets to be compared.

    A bucket is dealt into chunks of bounded size by hash, and each two chunks are a
    block. In a block, pairs whose sketches may be linked connect nodes to groups; the
    groups then meet with their sets and are verified by growing a forest."""
    sized = places.join(nodes.select("node", "n_shingles"), "node")
    chunks = written(
        sized.groupBy("bucket").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES), F.ceil(F.count("*") / CHUNK)).cast("int").alias("k")), "chunks"
    )
    own = spread_join(places, chunks, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    keyed = own.select("bucket", "node", "component", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    keyed = keyed.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component")
    dealt = keyed.join(nodes.select("node", "n_shingles", "sketch"), "node").select("bucket", "i", "j", "own", "node", "component", "n_shingles", "sketch")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            sketches, size = _sketches(t["sketch"], n_registers), t["n_shingles"].to_numpy()
            node, component, side = (t[x].to_numpy() for x in ("node", "component", "own"))
            parent, same = np.arange(len(t)), t["i"][0] == t["j"][0]
            for x in range(len(t) - 1):
                rest = np.arange(x + 1, len(t))
                open_ = component[rest] != component[x]
                if not same:
                    open_ &= side[rest] != side[x]
                rest = rest[open_]
                if len(rest):
                    hit = rest[may_link(np.broadcast_to(sketches[x : x + 1], (len(rest), n_registers)), sketches[rest], np.full(len(rest), size[x]), size[rest], percent)]
                    for y in np.unique(parent[hit]).tolist():
                        low, high = sorted((y, int(parent[x])))
                        parent[parent == high] = low
            groups, count = np.unique(parent, return_counts=True)
            keep = np.isin(parent, groups[count > 1])
            if keep.any():
                where = [np.full(int(keep.sum()), t[x][0].as_py()) for x in ("bucket", "i", "j")]
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in (*where, parent[keep], node[keep], component[keep], side[keep]))], names=["bucket", "i", "j", "part", "node", "component", "own"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 4):
            sets, sketches, size = _sets(t["shingles"]), _sketches(t["sketch"], n_registers), t["n_shingles"].to_numpy()
            node, label, side = t["node"].to_numpy(), t["component"].to_numpy().copy(), t["own"].to_numpy()
            same, found = t["i"][0] == t["j"][0], []
            for x in range(len(t) - 1):
                rest = np.arange(x + 1, len(t))
                open_ = label[rest] != label[x]
                if not same:
                    open_ &= side[rest] != side[x]
                rest = rest[open_]
                if len(rest):
                    rest = rest[may_link(np.broadcast_to(sketches[x : x + 1], (len(rest), n_registers)), sketches[rest], np.full(len(rest), size[x]), size[rest], percent)]
                for y in rest.tolist():
                    if label[x] != label[y] and linked(sets[x], sets[y], percent):
                        label[label == label[y]] = label[x]
                        found.append((int(node[x]), int(node[y])))
            if found:
                yield _pairs(*zip(*found, strict=True))

    groups = written(dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(near, "bucket long, i long, j long, part long, node long, component long, own long"), "groups")
    full = groups.join(nodes.select("node", "n_shingles", "sketch", "shingles"), "node").select("bucket", "i", "j", "part", "node", "component", "own", "n_shingles", "sketch", "shingles")
    return full.repartition("bucket", "i", "j", "part").sortWithinPartitions("bucket", "i", "j", "part").mapInArrow(check, "a long, b long")


def relatives(base: DataFrame, heads: DataFrame, width: int) -> DataFrame:
    """``(node, n_shingles, sketch, shingles)`` of ``heads(node, unit, n_shingles, sketch)``
    with the sets of their texts, from ``base(doc_id, unit, text)``."""
    n = heads.count()
    # ids and digests alone may be broadcast; sketches meet the texts by node
    texts = base.select("unit", "text").join(small(heads.select("node", "unit"), n), "unit").dropDuplicates(["node"])
    texts = texts.join(heads.select("node", "n_shingles", "sketch").hint("merge"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [own.tobytes() for _, own in sorted(shingle_sets(batch.column(3), width), key=lambda x: x[0])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=["node", "n_shingles", "sketch", "shingles"])

    return texts.select("node", "n_shingles", "sketch", "text").mapInArrow(run, "node long, n_shingles long, sketch binary, shingles binary")


def classes(base: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of ``base(doc_id, unit, text)``, and for each distinct set ``(digest,
    n, component_id, best)``: its rows, the smallest id reachable from it, and the first
    (by id, null last, then unit) of all rows reachable."""
    bands = bands_for(percent)
    signed = written(signatures(base, width, bands * ROWS), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "unit")
    heads = signed.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.min(first).alias("best"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    # numbers given while writing stay as they are
    heads = written(heads.withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = heads.select("node", F.explode(band_hashes(F.col("sketch"), bands)).alias("bucket"))
    met = written(banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1"), "buckets")
    shared = written(spread_join(banded, met.select("bucket", "n", "low", "high", F.col("n").alias("members")), "bucket"), "shared")
    nodes = written(relatives(base, heads.join(shared.select("node").distinct(), "node").select("node", F.col("best.unit").alias("unit"), "n_shingles", "sketch"), width), "relatives")

    stars = shared.select(F.col("low").alias("hub"), "node").union(shared.select(F.col("high").alias("hub"), "node")).where("hub <> node")
    stars = written(stars.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node")).distinct(), "pairs")
    links = written(star_links(stars, nodes, bands * ROWS, percent), "star-links")
    found = written(components(links), "components")
    # up to three nodes, all pairs have been compared; beyond that, nodes of one component need not be
    labelled = shared.where("members > 3").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = written(labelled.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket", "n"), "mixed")
    if not mixed.isEmpty():
        more = written(block_links(written(spread_join(labelled, mixed, "bucket"), "places"), nodes, bands * ROWS, percent), "block-links")
        if not more.isEmpty():
            found = written(components(links.unionByName(more)), "components")
    # only nodes with links need the first row of their component
    own = heads.select("node", "digest", "n", "least", "best")
    first_of = found.join(own, "node").groupBy("component").agg(F.min("least").alias("component_id"), F.min("best").alias("first"))
    reached = found.join(first_of, "component").select("node", "component_id", "first")
    return signed, written(own.join(reached, "node", "left").select("digest", "n", F.when(F.col("first").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("first", "best").alias("best")), "labels")


def _base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", "text", unit("doc_id", "text").alias("unit"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = SHINGLE) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    ``docs`` needs a long id and a string text; other columns are ignored whatever
    their names. Each row is judged by its own text, so rows of a repeated id with
    different texts may be in different components. Two texts are linked if ``100 * |A n B|
    >= percent * |A u B|`` on their sets of distinct ``width``-word shingles (A-Z
    lower-cased; a shorter text is one shingle). ``component_id`` is the smallest id
    reachable over links, null if no row reachable has an id. A null, empty or wordless
    text has size 0 and is its own component. ``kept`` is ``doc_id = component_id``, false
    for a null id. An empty table gives no rows."""
    signed, labels = classes(_base(docs, id_col, text_col), percent, width)
    worded = signed.where("digest is not null").select("doc_id", "n_shingles", "digest")
    out = spread_join(worded, labels.select("digest", "n", "component_id"), "digest").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(signed.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicate(docs: DataFrame, percent: int = 85, width: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: of each component its first row
    by id (null last), then by a digest of id and text, then of the whole row; and every
    row without words. Rows of a repeated id, or without one, are judged each by its own text."""
    own, key, row = private(docs, "unit", "gone", "row")
    keyed = docs.withColumn(own, unit("doc_id", "text"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), unit("doc_id", "text").alias("unit"))
    signed, labels = classes(base, percent, width)
    worded = spread_join(signed.where("digest is not null").select("unit", "digest"), labels.select("digest", "n", F.col("best.unit").alias("best")), "digest")
    units = written(worded.groupBy("unit").agg(F.count("*").alias("n"), F.max(F.col("unit") != F.col("best")).alias("gone")), "units")
    stay = keyed.join(units.where("gone").select(F.col("unit").alias(key)), F.col(own) == F.col(key), "left_anti")
    # copies of a first row in id and text: one of them stays
    again = units.where("not gone and n > 1").select(F.col("unit").alias(key))
    n = again.count()
    if n:
        whole = F.struct(*(F.col(f"`{x}`") for x in docs.columns))
        copies = stay.join(small(again, n), F.col(own) == F.col(key), "left_semi")
        one = copies.groupBy(own).agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias(row)).select(f"{row}.*")
        return stay.join(small(again, n), F.col(own) == F.col(key), "left_anti").select(*docs.columns).unionByName(one)
    return stay.select(*docs.columns)
