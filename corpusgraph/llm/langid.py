"""Language identification by multilingual mixture inference.

The model has the trigram distribution of each language. Every word of a text (every
``LONGEST`` letters of a longer run, as in scripts without spaces) is an observation whose likelihood in a language is the product over its trigrams; EM finds
the text's language proportions. The language set is the one of largest penalised
likelihood among the sets of the k leading ones, for every k: each language beyond the first costs
``PENALTY * log(words)``. The prediction is the language of largest proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .letters import Letters
from .textnum import Block, blocks

#: Trigrams are hashed to so many bits; counts are smoothed by so much.
BITS, SMOOTH = 16, 0.05
#: The model is fitted on at most about so many labelled texts of a language.
MAX_TEXTS = 4000
#: More labels than this are an error: the model would outgrow a broadcast.
MAX_LANGUAGES = 512
EM_STEPS, PENALTY = 10, 2.0
UNKNOWN = "und"
#: Letters in an observation, at most; longer texts are read in parts of about so many bytes.
LONGEST, PART = 24, 1 << 19
#: Observations whose EM terms are held as doubles at a time.
ROWS = 1 << 17


@dataclass
class Model:
    """``logp[trigram, language]`` for ``languages`` in sorted order."""

    languages: list[str]
    logp: np.ndarray


def sample(rows: DataFrame, label: str, most: int, counts: dict, id_col: str = "doc_id") -> DataFrame:
    """Rows of each label thinned by a hash of their id to about ``most``."""
    kept: Column = F.lit(False)
    for value, n in counts.items():
        kept = kept | ((F.col(label) == value) & (F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most / n))))
    return rows.where(kept)


def fit(labelled: DataFrame, most: int = MAX_TEXTS) -> Model:
    """The model of ``labelled(doc_id, text, lang)``; rows without text or lang are not
    used. At most ``MAX_LANGUAGES x 2**BITS`` sums reach the driver."""
    rows = labelled.where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for block in blocks(batch.column(0)):
                for part in parts(block):
                    letters = Letters(part)
                    grams = letters.trigrams(BITS)
                    cut = np.searchsorted(np.flatnonzero(letters.letter), letters.bounds)
                    for i in range(part.n):
                        own = sums.setdefault(langs[block.first + i], np.zeros(1 << BITS, dtype=np.int64))
                        own += np.bincount(grams[cut[i] : cut[i + 1]], minlength=1 << BITS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], names=["lang", "gram", "n"])

    table = sample(rows, "lang", most, counts).select("text", "lang").mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas() if counts else None
    names = sorted(counts)
    dense = np.zeros((1 << BITS, max(len(names), 1)))
    if table is not None:
        dense[table["gram"].to_numpy(dtype=np.int64), np.searchsorted(names, table["lang"].to_numpy(dtype=str))] = table["n"]
    dense += SMOOTH
    return Model(names, np.log(dense / dense.sum(axis=0)).astype(np.float32))


def parts(block: Block) -> Iterator[Block]:
    """A block, or a single long text of it in parts: cut at white space or, where there
    is none for long, between characters."""
    if len(block.buf) <= 2 * PART or block.n > 1:
        yield block
        return
    raw, at = block.buf, 0
    while at < len(raw):
        to = min(at + PART, len(raw))
        if to < len(raw):
            space = np.flatnonzero(raw[to : to + PART] <= 0x20)
            to += int(space[0]) if len(space) else 0
            while to < len(raw) and raw[to] & 0xC0 == 0x80:
                to += 1
        yield Block(raw[at:to], np.array([0, to - at]), block.first)
        at = to


def _sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, begin, axis=0)


def proportions(lik: np.ndarray, text: np.ndarray, n_words: np.ndarray, allowed: np.ndarray, steps: int = EM_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """EM: shares of each language in each text (``allowed``: texts x languages), and
    each text's log likelihood relative to ``lik``'s scale. Every text has words; they are
    worked through in slices, so memory beside ``lik`` is bounded."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    cuts = [(a, min(a + ROWS, len(lik))) for a in range(0, len(lik), ROWS)]

    def over_words(f, width: tuple) -> np.ndarray:
        out = np.zeros((len(n_words), *width))
        for a, b in cuts:
            own = text[a:b]
            begin = np.flatnonzero(np.diff(own, prepend=-1))
            out[own[begin]] += _sums(f(lik[a:b].astype(np.float64), own), begin)
        return out

    def expected(x: np.ndarray, own: np.ndarray) -> np.ndarray:
        part = x * share[own]
        return part / part.sum(axis=1, keepdims=True)

    for _ in range(steps):
        share = over_words(expected, lik.shape[1:]) / n_words[:, None]
        share = np.where(allowed, np.maximum(share, 1e-6), 0)
        share /= share.sum(axis=1, keepdims=True)
    return share, over_words(lambda x, own: np.log((x * share[own]).sum(axis=1)), ())


def likelihoods(model: Model, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Likelihoods (observations x languages, the largest of a row being 1) and the number
    of observations of each text of a block."""
    letters = Letters(block)
    starts, lengths = letters.starts, letters.ends - letters.starts
    many = np.maximum(1, -(-lengths // LONGEST))
    word = np.repeat(np.arange(len(starts)), many)
    turn = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
    at = np.searchsorted(np.flatnonzero(letters.letter), starts[word] + turn * LONGEST)
    n_words = np.diff(np.searchsorted(starts[word], letters.bounds))
    if not len(at):
        return np.zeros((0, len(model.languages)), np.float32), n_words
    score = np.add.reduceat(model.logp[letters.trigrams(BITS)], at, axis=0)
    return np.maximum(np.exp(score - score.max(axis=1, keepdims=True)), 1e-12), n_words


def infer(model: Model, block: Block) -> np.ndarray:
    """Language shares (texts x languages) of a block; a row of zeros has no letter. A long
    text is read in parts; 4 bytes a word and language of it are kept."""
    out = np.zeros((block.n, len(model.languages)))
    if not model.languages:
        return out
    held = [likelihoods(model, part) for part in parts(block)]
    lik = np.concatenate([x for x, _ in held]) if len(held) > 1 else held[0][0]
    n_words = sum(n for _, n in held)
    filled = np.flatnonzero(n_words)
    if not len(filled):
        return out
    n_words = n_words[filled]
    text = np.repeat(np.arange(len(filled)), n_words)
    every = np.ones((len(filled), lik.shape[1]), dtype=bool)
    share, full = proportions(lik, text, n_words, every)
    order = np.argsort(-share, axis=1, kind="stable")
    best = _sums(np.log(lik[np.arange(len(lik)), order[text, 0]].astype(np.float64)), np.concatenate([[0], np.cumsum(n_words)])[:-1])
    cost = PENALTY * np.log(n_words + 1.0)
    chosen = np.zeros_like(share)
    chosen[np.arange(len(filled)), order[:, 0]] = 1
    # a set of k languages gains no more than the full mixture does
    for k in range(2, lik.shape[1] + 1):
        open_ = np.flatnonzero(full - (k - 1) * cost > best)
        if not len(open_):
            break
        allowed = np.zeros((len(open_), lik.shape[1]), dtype=bool)
        np.put_along_axis(allowed, order[open_, :k], True, axis=1)
        rows = np.flatnonzero(np.isin(text, open_)) if len(open_) < len(filled) else slice(None)
        own, value = proportions(lik[rows], np.searchsorted(open_, text[rows]), n_words[open_], allowed)
        better = value - (k - 1) * cost[open_] > best[open_]
        chosen[open_[better]] = own[better]
        best[open_[better]] = (value - (k - 1) * cost[open_])[better]
    out[filled] = chosen
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score, languages, shares``.

    Only the two named columns are read. A text that is null or has no letter is
    ``und`` with score 0 and no languages, and so is any text if the model knows no
    language. Ties go to the language that sorts first. Repeated and null ids are kept
    as they are; an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, languages array<string>, shares array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            pred, score, langs, shares = [], [], [], []
            for block in blocks(batch.column(1)):
                for row in infer(own, block):
                    at = [k for k in np.argsort(-row, kind="stable").tolist() if row[k] > 0]
                    pred.append(own.languages[at[0]] if at else UNKNOWN)
                    score.append(min(1.0, float(row[at[0]])) if at else 0.0)
                    langs.append([own.languages[k] for k in at])
                    shares.append([float(row[k]) for k in at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], names=["doc_id", "lang_pred", "score", "languages", "shares"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
