"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are all words and word beginnings of the labelled examples; none is left out. A term
weighs its TF-IDF times the log ratio of its rates in the two classes (a delta
TF-IDF), so terms that tell the classes apart count and common words hardly do. The
examples, as unit vectors, are held in an inverted index in blocks, with the largest weight
of each term in each block: blocks are scored in the order of their bounds until no other
can hold one of the ``NEAREST`` best. The few most frequent terms have no lists: their part
of the cosines is a product of dense matrices for many texts at a time, and its largest
value in each block is part of the bound. A text's vote is the distance-weighted share of
toxic ones among its nearest examples; a logistic curve, fitted on the examples' own
votes with each left out, turns it into a calibrated score. The nearest examples' ids
are the evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import sample
from .letters import Letters
from .scratch import small, written
from .textnum import blocks, mix

#: Fitted on at most about so many labelled texts of each class.
MAX_TEXTS = {1: 1500, 0: 3000}
#: Letters in a word beginning.
PREFIX = 5
#: Examples in a block of the index, neighbours that vote, weight of the prior rate.
BLOCK_SIZE, NEAREST, PRIOR = 64, 32, 0.5
#: Blocks that are scored first, to find the score that others have to reach; terms without
#: lists; texts whose dense parts are computed at a time.
FIRST, COMMON, TEXTS = 4, 1024, 128
#: Ids of the nearest examples that a result carries.
EVIDENCE = 5


def features(block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and longer words' beginnings, with their text numbers."""
    letters = Letters(block)
    text = np.repeat(np.arange(letters.n), np.diff(letters.first))
    long_ = letters.ends - letters.starts > PREFIX
    return np.concatenate([letters.hashes(), mix(letters.hashes(PREFIX)[long_] + np.uint64(1))]), np.concatenate([text, text[long_]])


def counted(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(row, distinct features, their counts)`` of each text that has any."""
    for block in blocks(column):
        own, text = features(block)
        order = np.lexsort((own, text))
        own, text = own[order], text[order]
        new = np.ones(len(own), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        n, own, text = np.diff(np.append(at, len(new))), own[at], text[at]
        cuts = np.searchsorted(text, np.arange(block.n + 1))
        for i in np.unique(text).tolist():
            yield block.first + i, own[cuts[i] : cuts[i + 1]], n[cuts[i] : cuts[i + 1]]


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of the ranges ``begin:begin + n``, one after the other."""
    return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


@dataclass
class Index:
    """``terms`` (sorted hashes) with their weights ``idf`` and the number of examples that
    ``held`` them; examples as unit vectors in CSR form (``begin, term, weight``), in blocks
    of ``BLOCK_SIZE``; their votes and ids; the calibration's slope and offset."""

    terms: np.ndarray
    idf: np.ndarray
    held: np.ndarray
    begin: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    positive: np.ndarray
    total: np.ndarray
    ids: np.ndarray
    rate: float
    empty_rate: float
    slope: float = 1.0
    offset: float = 0.0

    def ready(self) -> Index:
        """With its inverted lists: for each term the blocks that hold it, with the largest
        weight there and the postings; and the dense matrix of the common terms."""
        if hasattr(self, "post_example"):
            return self
        n = len(self.begin) - 1
        self.blocks = max(1, -(-n // BLOCK_SIZE))
        example = np.repeat(np.arange(n), np.diff(self.begin)).astype(np.int32)
        common = np.argsort(-self.held, kind="stable")[: min(COMMON, len(self.terms))]
        self.column = np.full(len(self.terms), -1)
        self.column[common] = np.arange(len(common))
        at = self.column[self.term]
        self.dense = np.zeros((n, len(common)))
        self.dense[example[at >= 0], at[at >= 0]] = self.weight[at >= 0]
        rare = np.flatnonzero(at < 0)
        order = rare[np.lexsort((example[rare], self.term[rare]))]
        self.post_example, self.post_weight = example[order], self.weight[order].astype(np.float64)
        term, block = self.term[order].astype(np.int64), self.post_example // BLOCK_SIZE
        key = term * self.blocks + block
        at = np.flatnonzero(np.diff(key, prepend=-1))
        self.list_begin = np.searchsorted(term[at], np.arange(len(self.terms) + 1))
        self.list_block, self.list_post, self.list_n = block[at].astype(np.int64), at, np.diff(np.append(at, len(key)))
        self.list_most = np.maximum.reduceat(self.post_weight, at) if len(at) else np.zeros(0)
        return self

    def common(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The common terms' part of the cosines of some texts (rows) with all examples."""
        asked = np.zeros((len(vectors), self.dense.shape[1]))
        for row, (terms, weight) in enumerate(vectors):
            at = self.column[terms]
            asked[row, at[at >= 0]] = weight[at >= 0]
        return asked @ self.dense.T

    def nearest(self, terms: np.ndarray, weight: np.ndarray, k: int = NEAREST, without: int = -1, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Examples of the ``k`` largest cosines above 0, best first, ties to the smaller
        example; and the cosines. ``without`` names an example that takes no part;
        ``common`` is the text's row of ``common``."""
        common = self.common([(terms, weight)])[0] if common is None else common
        rare = self.column[terms] < 0
        terms, by = terms[rare], weight[rare]
        n = self.list_begin[terms + 1] - self.list_begin[terms]
        lists, by = _ranges(self.list_begin[terms], n), np.repeat(by, n)
        block = self.list_block[lists]
        bound = np.bincount(block, by * self.list_most[lists], self.blocks) + np.maximum.reduceat(common, np.arange(0, len(common), BLOCK_SIZE)) + 1e-9
        order = np.argsort(-bound)

        def scored(now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The examples of some blocks and their cosines."""
            place = np.full(self.blocks, -1)
            place[now] = np.arange(len(now))
            own = np.flatnonzero(place[block] >= 0)
            size = self.list_n[lists[own]]
            posts = _ranges(self.list_post[lists[own]], size)
            local = np.repeat((place[block[own]] - block[own]) * BLOCK_SIZE, size) + self.post_example[posts]
            part = np.bincount(local, self.post_weight[posts] * np.repeat(by[own], size), len(now) * BLOCK_SIZE)
            names = (now[:, None] * BLOCK_SIZE + np.arange(BLOCK_SIZE)[None, :]).ravel()
            inside = (names < len(common)) & (names != without)
            return names[inside], part[inside] + common[names[inside]]

        names, values = scored(order[:FIRST])
        least = np.partition(values, -k)[-k] if len(values) >= k else 0.0
        more = order[FIRST:][bound[order[FIRST:]] >= max(least, 1e-9)]
        if len(more):
            names, values = (np.concatenate(x) for x in zip((names, values), scored(more), strict=True))
        least = np.partition(values, -k)[-k] if len(values) >= k else 0.0
        keep = np.flatnonzero((values >= least - 1e-9) & (values > 1e-12))
        names, values = names[keep], values[keep]
        best = np.lexsort((names, -np.round(values, 12)))[:k]
        return names[best], values[best]

    def vote(self, terms: np.ndarray, weight: np.ndarray, without: int = -1, common: np.ndarray | None = None) -> tuple[float, list[int]]:
        """The share of toxic examples among the nearest, by distance, and their ids."""
        found, cosine = self.nearest(terms, weight, without=without, common=common)
        if not len(found):
            return self.empty_rate, []
        by = 1 / (1.001 - np.minimum(cosine, 1))
        share = (by * self.positive[found]).sum() + PRIOR * self.rate
        return float(share / ((by * self.total[found]).sum() + PRIOR)), self.ids[found[:EVIDENCE]].tolist()

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weight = (1 + np.log(counts)) * self.idf[terms]
        norm = np.sqrt((weight * weight).sum())
        return weight / norm if norm > 0 else weight

    def calibrated(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * _logit(vote) + self.offset, -30, 30))))

    def known(self, features_: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a text's features, as far as examples hold them."""
        at = np.searchsorted(self.terms, features_)
        keep = np.flatnonzero(self.terms[np.minimum(at, len(self.terms) - 1)] == features_) if len(self.terms) else at[:0]
        return at[keep], self.vector(at[keep], counts[keep])

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]]]:
        """Calibrated score and evidence of some texts from their features and counts."""
        vectors = [self.known(*x) for x in texts]
        common = self.common(vectors) if len(self.terms) else [None] * len(vectors)
        out: list[tuple[float, list[int]]] = []
        for (terms, weight), row in zip(vectors, common, strict=True):
            if len(terms):
                vote, ids = self.vote(terms, weight, common=row)
                out.append((self.calibrated(vote), ids))
            else:
                out.append((self.empty_rate, []))
        return out


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 40) -> tuple[float, float]:
    """Slope (at least 0) and offset of the logistic curve of ``y`` (shares) over ``x`` with weights
    ``n``, by damped Newton steps with a little ridge."""
    at = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        slope = design.T @ (n * (y - p)) - 1e-3 * (at - [1.0, 0.0])
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-3
        step = np.linalg.solve(curve, slope)
        at = at + step / max(1.0, np.abs(step).max())
    return max(0.0, float(at[0])), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, most: dict[int, int] | None = None) -> Index:
    """The index of ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``, toxic being 0 or
    1; other labels and null ids are not used. A document with both labels counts as one
    example of each. Labels are thinned before they meet texts, so only the sampled ids travel;
    the sampled texts' features reach the driver (at most ``most`` texts of each class)."""
    most = most or MAX_TEXTS
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = totals.get(1, 0) / max(1, sum(totals.values()))
    none = Index(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0, np.int64), rate, rate)
    if len(totals) < 2:
        return none
    chosen = sample(known, "toxic", most[0], {0: totals[0]}).unionByName(sample(known, "toxic", most[1], {1: totals[1]}))
    chosen = written(chosen.distinct(), "toxicity-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(small(chosen, chosen.count()), "doc_id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = [np.zeros(0, np.int64)] * len(batch), [np.zeros(0, np.int32)] * len(batch)
            for row, found, counts in counted(batch.column(2)):
                own[row], n[row] = found.view(np.int64), counts.astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms", "counts"])

    table = texts.select("doc_id", "toxic", "text").mapInArrow(vectors, "doc_id long, toxic int, terms array<long>, counts array<int>")
    table = written(table.dropDuplicates(), "toxicity-vectors").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")]).combine_chunks()
    toxic = table["toxic"].to_numpy()
    size = pa.compute.list_value_length(table["terms"]).to_numpy()
    n = {y: int((toxic == y).sum()) for y in (0, 1)}
    if not n[0] or not n[1] or not size.any():
        return none
    # each sampled text stands for so many labelled ones
    stand = np.where(toxic == 1, totals[1] / n[1], totals[0] / n[0])
    blank = size == 0
    empty_rate = float((stand * toxic)[blank].sum() / stand[blank].sum()) if blank.any() else rate
    flat = pa.compute.list_flatten(table["terms"]).to_numpy().view(np.uint64)
    counts = pa.compute.list_flatten(table["counts"]).to_numpy()
    terms, term = np.unique(flat, return_inverse=True)
    held = np.repeat(np.arange(len(toxic)), size)
    ones = np.bincount(term, toxic[held] == 1, len(terms))
    zeros = np.bincount(term, toxic[held] == 0, len(terms))
    df, total = ones * totals[1] / n[1] + zeros * totals[0] / n[0], sum(totals.values())
    ratio = np.log((ones + 0.5) / (n[1] + 1)) - np.log((zeros + 0.5) / (n[0] + 1))
    idf = np.log(1 + total / (1 + df)) * np.abs(ratio)
    weight = (1 + np.log(counts)) * idf[term]
    norm = np.sqrt(np.bincount(held, weight**2, len(toxic)))
    weight = weight / np.where(norm > 0, norm, 1)[held]
    # examples of one class and strongest term share blocks, which keeps bounds tight
    first = np.cumsum(size) - size
    lead = np.zeros(len(toxic), dtype=np.int64)
    lead[held[np.lexsort((weight, held))]] = term[np.lexsort((weight, held))]
    order = np.lexsort((np.arange(len(toxic)), lead, toxic))
    order = order[~blank[order]]
    posts = _ranges(first[order], size[order])
    index = Index(
        terms, idf, (ones + zeros), np.concatenate([[0], np.cumsum(size[order])]), term[posts].astype(np.int32), weight[posts].astype(np.float32),
        (stand * toxic)[order], stand[order], table["doc_id"].to_numpy()[order], rate, empty_rate,
    )
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.ready()
        for batch in batches:
            votes = []
            for e in batch.column(0).to_pylist():
                at, w = own.term[own.begin[e] : own.begin[e + 1]], own.weight[own.begin[e] : own.begin[e + 1]].astype(np.float64)
                known_ = own.held[at] > 1  # a new text has no terms of its own either
                at, w = at[known_].astype(np.int64), w[known_]
                votes.append(own.vote(at, w / max(1e-12, np.sqrt((w * w).sum())), without=e)[0] if len(at) else own.empty_rate)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.float64())], names=["example", "vote"])

    votes = docs.sparkSession.range(len(order)).selectExpr("id as example").repartition(64).mapInArrow(left_out, "example long, vote double").toArrow().sort_by("example")
    index.slope, index.offset = logistic(_logit(votes["vote"].to_numpy()), toxic[order].astype(float), stand[order])
    return index


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, score, predicted, evidence`` (ids of the nearest
    labelled texts). Only the two named columns are read. A null, empty or wordless text
    has the rate of such labelled texts (of all, if there is none) and no evidence.
    Repeated and null ids are kept as they are; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int, evidence array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.ready()
        for batch in batches:
            out: list = [(own.empty_rate, [])] * len(batch)
            for some in batched(counted(batch.column(1)), TEXTS):
                for (row, *_), found in zip(some, own.scores([x[1:] for x in some]), strict=True):
                    out[row] = found
            values = np.array([x[0] for x in out], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), pa.array((values >= 0.5).astype(np.int32)), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["doc_id", "score", "predicted", "evidence"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
