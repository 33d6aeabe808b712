"""Approximate nearest vectors by an inverted file: trained cells, coded residuals, exact re-scoring."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranking import top

#: Vectors that cells and codes are fitted on, at most; all vectors are indexed.
SAMPLE = 20_000
#: Vectors of a part of a cell, and queries of a block, that one task multiplies at once.
PART, BLOCK = 4096, 512
CODES = 256


@dataclass
class VectorIndex:
    """``entries(user_id, cell, part, chunk_id, code, embedding)``: each vector in the cell of its nearest ``centre``, with its
    residual coded in ``books`` (one of 256 codewords for each group of dimensions)."""

    centres: np.ndarray
    books: np.ndarray
    entries: DataFrame
    parts: DataFrame


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), dtype=np.int64)
    half = (centres**2).sum(axis=1) / 2
    for at in range(0, len(points), 4096):
        out[at : at + 4096] = np.argmax(points[at : at + 4096] @ centres.T - half, axis=1)
    return out


def _means(points: np.ndarray, n: int, rounds: int, seed: int = 7) -> np.ndarray:
    """``n`` centres by Lloyd's iteration; an empty one takes the place of a point."""
    rng = np.random.default_rng(seed)
    n = min(n, len(points))
    centres = points[rng.choice(len(points), n, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(points, centres)
        count = np.bincount(own, minlength=n)
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], points[rng.integers(0, len(points), n)])
    return centres


def _fit(sample: np.ndarray, cells: int, groups: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    centres = _means(sample, cells, rounds)
    rest = sample - centres[_nearest(sample, centres)]
    books = np.zeros((groups, CODES, sample.shape[1] // groups))
    for g, part in enumerate(np.split(rest, groups, axis=1)):
        found = _means(part, CODES, rounds)
        books[g, : len(found)] = found
        books[g, len(found) :] = found[0]
    return centres, books


def build_index(vectors: DataFrame, cells: int = 64, groups: int = 8, sample: int = SAMPLE, rounds: int = 8) -> VectorIndex:
    """Index of ``vectors(user_id, chunk_id, embedding)`` by cosine. Cells and codes are shared by all users and fitted on about ``sample``
    vectors chosen by a hash of their ids; vectors that are null or zero take no part. The dimension must be a multiple of ``groups``."""
    held = vectors.where("embedding is not null").select("user_id", "chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    held = held.where(F.exists("embedding", lambda x: x != 0))
    n = held.count()
    if not n:
        raise ValueError("no vectors to index")
    chosen = held.where(F.pmod(F.xxhash64("user_id", "chunk_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / n)) + 1).limit(2 * sample)
    points = _unit(np.array([r.embedding for r in chosen.select("embedding").collect()] or [held.first().embedding]))
    centres, books = _fit(points, cells, groups, rounds)
    kinds = {x: held.schema[x].dataType.simpleString() for x in ("user_id", "chunk_id")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = _unit(np.array(batch["embedding"].tolist(), dtype=float).reshape(len(batch), -1))
            cell = _nearest(own, centres)
            rest = own - centres[cell]
            code = np.stack([_nearest(part, books[g]) for g, part in enumerate(np.split(rest, groups, axis=1))], axis=1).astype(np.uint8)
            yield pd.DataFrame({"user_id": batch["user_id"], "chunk_id": batch["chunk_id"], "cell": cell.astype(np.int32), "code": [x.tobytes() for x in code], "embedding": list(own.astype(np.float32))})

    coded = written(held.mapInPandas(run, f"user_id {kinds['user_id']}, chunk_id {kinds['chunk_id']}, cell int, code binary, embedding array<float>"), "coded")
    parts = written(coded.groupBy("user_id", "cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "cells")
    placed = coded.join(F.broadcast(parts) if parts.count() <= 1_000_000 else parts, ["user_id", "cell"]).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).drop("parts")
    return VectorIndex(centres, books, written(placed.repartition("user_id", "cell", "part"), "entries"), parts)


def approximate_search(queries: DataFrame, index: VectorIndex, k: int, probes: int = 8, refine: int = 10) -> DataFrame:
    """``(user_id, query_id, chunk_id, distance, rank)``: of the vectors in the ``probes`` cells nearest to a query, the ``refine * k``
    nearest by their codes, in the order of their exact cosine distance (ties by chunk id). With all cells probed and ``refine=0`` (no
    codes) this is the exact search. A zero query has no results."""
    centres, books = index.centres, index.books
    probes = min(probes, len(centres))
    asked = queries.where("embedding is not null").select("user_id", "query_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.exists("embedding", lambda x: x != 0))
    kinds = {x: asked.schema[x].dataType.simpleString() for x in ("user_id", "query_id")} | {"chunk_id": index.entries.schema["chunk_id"].dataType.simpleString()}

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (centres**2).sum(axis=1) / 2
        for batch in batches:
            own = _unit(np.array(batch["embedding"].tolist(), dtype=float).reshape(len(batch), -1))
            near = np.argsort(-(own @ centres.T - half), axis=1, kind="stable")[:, :probes]
            row = np.repeat(np.arange(len(batch)), probes)
            yield pd.DataFrame({"user_id": batch["user_id"].to_numpy()[row], "query_id": batch["query_id"].to_numpy()[row], "cell": near.ravel().astype(np.int32), "query": list(own[row])})

    probed = asked.mapInPandas(probe, f"user_id {kinds['user_id']}, query_id {kinds['query_id']}, cell int, query array<double>")
    met = probed.join(index.parts, ["user_id", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(64)))
    blocks = met.groupBy("user_id", "cell", "part", "block").agg(F.collect_list(F.struct("query_id", "query")).alias("asked"))
    packs = index.entries.groupBy("user_id", "cell", "part").agg(F.collect_list(F.struct("chunk_id", "code", "embedding")).alias("held"))
    joined = packs.join(blocks, ["user_id", "cell", "part"]).select("user_id", "cell", "held", "asked")
    most = refine * k if refine else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                own = np.array([x["embedding"] for x in row.held], dtype=float)
                code = np.frombuffer(b"".join(x["code"] for x in row.held), dtype=np.uint8).reshape(len(own), -1)
                ids = np.array([x["chunk_id"] for x in row.held], dtype=object)
                cell = centres[row.cell]
                out = []
                for at in range(0, len(row.asked), BLOCK):
                    some = row.asked[at : at + BLOCK]
                    q = np.array([x["query"] for x in some], dtype=float)
                    away = np.round(1 - q @ own.T, 6) if not most else None
                    for i, x in enumerate(some):
                        if most:  # products with the centre and the codewords stand for those with the vectors
                            tables = np.einsum("gcd,gd->gc", books, q[i].reshape(len(books), -1))
                            near = cell @ q[i] + tables[np.arange(len(books)), code].sum(axis=1)
                            pick = np.argpartition(-near, most - 1)[:most] if len(near) > most else np.arange(len(near))
                            exact = np.round(1 - own[pick] @ q[i], 6)
                            out += [(row.user_id, x["query_id"], ids[j], float(-near[j]), float(d)) for j, d in zip(pick.tolist(), exact, strict=True)]
                        else:
                            pick = np.argpartition(away[i], k - 1)[:k] if len(ids) > k else np.arange(len(ids))
                            edge = away[i][pick].max(initial=-1.0)
                            out += [(row.user_id, x["query_id"], ids[j], float(away[i][j]), float(away[i][j])) for j in np.flatnonzero(away[i] <= edge).tolist()]
                yield pd.DataFrame(out, columns=["user_id", "query_id", "chunk_id", "near", "distance"])

    found = joined.mapInPandas(run, f"user_id {kinds['user_id']}, query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, near double, distance double")
    if most:
        found = top(found, ["user_id", "query_id"], ["near", "chunk_id"], most).drop("rank")
    return top(found.drop("near"), ["user_id", "query_id"], ["distance", "chunk_id"], k)
