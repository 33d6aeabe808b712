"""Benchmark passages in documents, by suffix arrays of the documents.

Documents are read in shards of bounded size (a document stays whole). A shard's words become
numbers, and all its suffixes are sorted as deep as a window. Each suffix of each item that
starts a window is then looked up by binary search, one word deeper at a time: the range of
document suffixes that agree with it shrinks to its places. From there, matches are extended
to the longest verbatim ones.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import open_fs
from .runs import WORD, runs
from .scratch import new_path
from .textnum import blocks

#: Words of a window; an item of fewer words (but some) is one window.
WINDOW = 10
#: Bytes of text in a shard (one document may be longer) and of item text in a block.
SHARD, BLOCK = 1 << 23, 1 << 22
#: Places that are spread out at once.
SPREAD = 1 << 20


class Items:
    """A block of benchmark items: ``words`` of all, item ``i`` has ``first[i]:first[i + 1]``;
    ``ids[i]`` is its id as text (or None)."""

    def __init__(self, ids: list[str | None], words: pa.LargeStringArray, first: np.ndarray, window: int):
        self.ids, self.words, self.first = ids, words, first
        count = np.diff(first)
        self.item = np.repeat(np.arange(len(ids)), count)
        place = np.arange(len(words)) - first[:-1][self.item]
        self.left = count[self.item] - place  # words from here to the end of the item
        # the words of the window that starts here, 0 if none does
        self.need = np.where(count[self.item] < window, np.where(place == 0, count[self.item], 0), np.where(self.left >= window, window, 0))
        self.longest = int(count.max()) if len(count) else 0


class Shard:
    """Some whole documents as numbered words with their suffix array. ``code`` has one -1
    after each document, which matches nothing; document ``i`` has ``first[i]:first[i + 1] - 1``."""

    def __init__(self, words: pa.LargeStringArray, first: np.ndarray, depth: int):
        coded = words.dictionary_encode()
        self.names, docs = coded.dictionary, len(first) - 1
        count = np.diff(first)
        self.first = np.concatenate([[0], np.cumsum(count + 1)])
        self.code = np.full(self.first[-1], -1, dtype=np.int64)
        self.doc = np.repeat(np.arange(docs), count + 1)
        self.is_word = np.ones(len(self.code), dtype=bool)
        self.is_word[self.first[1:] - 1] = False
        self.code[self.is_word] = np.asarray(coded.indices, dtype=np.int64)
        self.order = self._sorted(depth)

    def _sorted(self, depth: int) -> np.ndarray:
        """Suffixes in the order of their first ``depth`` words or more, by prefix doubling:
        ranks of 2h words follow from two ranks of h words."""
        n = len(self.code)
        rank, h = self.code + 1, 1
        order = np.argsort(rank)
        while h < depth:
            later = np.zeros(n, dtype=np.int64)
            later[: max(n - h, 0)] = rank[h:]
            key = rank * (n + 2) + later
            key[rank == 0] = 0  # a document's end: what follows is another's
            order = np.argsort(key)
            steps = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = steps
            h *= 2
            if steps[-1] >= self.is_word.sum():
                break
        return order

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The items' words in the shard's numbers (-2: not there), and for each item suffix the
        range of ``order`` that agrees with the window it starts (empty, if none)."""
        asked = np.asarray(pc.index_in(items.words, value_set=self.names).fill_null(-2), dtype=np.int64)
        live = np.flatnonzero((asked >= 0) & (items.need > 0))
        low, high = np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=np.int64)
        high[live] = len(self.order)
        depth = 0
        while len(live):
            deeper = live[items.need[live] > depth]
            word = asked[deeper + depth]
            low[deeper] = self._bound(low[deeper], high[deeper], depth, word, False)
            high[deeper] = self._bound(low[deeper], high[deeper], depth, word, True)
            live = deeper[low[deeper] < high[deeper]]
            depth += 1
        return asked, low, high

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray, after: bool) -> np.ndarray:
        """The first place of each range whose word at ``depth`` is not below (``after``: is above)
        the one asked for."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            at = self.order[mid] + depth  # agrees in depth words, so it is within its document
            below = self.code[at] <= word[open_] if after else self.code[at] < word[open_]
            low[open_[below]] = mid[below] + 1
            high[open_[~below]] = mid[~below]
            open_ = open_[low[open_] < high[open_]]
        return low

    def places(self, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(which range, place)`` of all places in the ranges, some ``SPREAD`` at a time."""
        size = high - low
        which = np.flatnonzero(size > 0)
        done = np.concatenate([[0], np.cumsum(size[which])])
        for start in range(0, int(done[-1]), SPREAD):
            flat = np.arange(start, min(start + SPREAD, int(done[-1])))
            own = np.searchsorted(done, flat, side="right") - 1
            yield which[own], self.order[low[which[own]] + flat - done[own]]


def stored_items(items: DataFrame, id_col: str, text_col: str) -> str:
    """The benchmark's rows in the shared folder, in files that tasks read block by block."""
    folder = new_path(items.sparkSession, "items")
    items.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).write.parquet(folder)
    return folder


def item_blocks(folder: str, window: int) -> Iterator[Items]:
    """The stored items, ``BLOCK`` bytes of text (or one item) at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, plain = open_fs(folder)
    names = sorted(x.path for x in system.get_file_info(fs.FileSelector(plain)) if x.path.endswith(".parquet"))
    for name in names:
        with system.open_input_file(name) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=4096, columns=["id", "text"]):
                for block in blocks(batch.column(1), BLOCK):
                    words, first = runs(block, WORD)
                    if len(words):
                        yield Items(batch.column(0)[block.first : block.first + block.n].to_pylist(), words, first, window)


def maximal(shard: Shard, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Maximal verbatim matches of at least a window: ``(item word, document word, words)``. They begin
    where the words before differ (or one side begins) and are extended as far as both agree."""
    asked, low, high = shard.search(items)
    for t, at in shard.places(low, high):
        begins = (t == items.first[items.item[t]]) | (at == shard.first[shard.doc[at]])
        begins |= asked[np.maximum(t - 1, 0)] != shard.code[np.maximum(at - 1, 0)]
        t, at = t[begins], at[begins]
        size = items.need[t]
        live = np.arange(len(t))
        while len(live):
            live = live[size[live] < items.left[t[live]]]
            live = live[asked[t[live] + size[live]] == shard.code[at[live] + size[live]]]
            size[live] += 1
        yield t, at, size


class Found:
    """What one shard holds of all items: hit words, and for each document its items' ids and
    the words of its longest match."""

    def __init__(self, shard: Shard):
        self.shard = shard
        self.hit = np.zeros(len(shard.code) + 1, dtype=np.int64)
        self.names: list[set[str]] = [set() for _ in range(len(shard.first) - 1)]
        self.longest = np.zeros(len(shard.first) - 1, dtype=np.int64)

    def add(self, items: Items) -> None:
        for t, at, size in maximal(self.shard, items):
            np.add.at(self.hit, at, 1)
            np.add.at(self.hit, at + size, -1)
            doc = self.shard.doc[at]
            np.maximum.at(self.longest, doc, size)
            for d, item in np.unique(np.stack([doc, items.item[t]], axis=1), axis=0).tolist():
                if items.ids[item] is not None:
                    self.names[d].add(items.ids[item])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Words and hit words of each document."""
        first = self.shard.first
        covered = np.concatenate([[0], np.cumsum(np.cumsum(self.hit[:-1]) > 0)])
        return np.diff(first) - 1, covered[first[1:]] - covered[first[:-1]]


def _shards(column: pa.Array, folder: str, window: int, depth: int) -> Iterator[tuple[int, int, Shard, Iterator[Items]]]:
    """``(first row, rows, shard, blocks of items)`` of the shards of a text column. A benchmark of
    one block is read once for the column, a larger one for each shard."""
    held = list(itertools.islice(item_blocks(folder, window), 2))
    for block in blocks(column, SHARD):
        yield block.first, block.n, Shard(*runs(block, WORD), depth), held if len(held) < 2 else item_blocks(folder, window)


def _found(column: pa.Array, folder: str, window: int, depth: int) -> Iterator[tuple[int, int, Found]]:
    for at, n, shard, parts in _shards(column, folder, window, depth):
        found = Found(shard)
        for items in parts:
            found.add(items)
        yield at, n, found


def _depth(items: DataFrame, text_col: str) -> int:
    """The words of the longest item."""
    return int(items.agg(F.max(F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest``.
    A word is hit if any occurrence of a window covers it; ``longest`` has the words of the longest
    verbatim match with an item (0: none).

    Null and empty texts have no words and aren't hit; items without words are in no document. Items
    that share an id are one; one without an id hits, but isn't among the named. Repeated and null document
    ids are judged row by row. Without items nothing is contaminated; without documents there are no rows."""
    folder, depth = stored_items(items, item_id, item_text), min(_depth(items, item_text), window)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, found in _found(batch.column(1), folder, window, depth):
                words, hit = found.counts()
                ids = [sorted(x) for x in found.names]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n), pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], pa.string()), pa.array(hit > 0), pa.array(found.longest, pa.int64()),
                    ],
                    names=names,
                )

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of an item; the others stay as they are."""
    folder, depth = stored_items(items, item_id, item_text), min(_depth(items, item_text), window)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n, found in _found(batch.column(at), folder, window, depth):
                yield batch.slice(start, n).filter(pa.array(~(found.counts()[1] > 0)))

    return docs.mapInArrow(run, docs.schema)


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Where passages lie: ``doc_id, doc_word, item_id, item_word, n_words``, 0-based words. One row for each
    maximal verbatim match of at least a window between a document and an item: it can't be extended to
    either side. Rows grow with the places a passage is found at."""
    folder, depth = stored_items(items, item_id, item_text), min(_depth(items, item_text), window)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, shard, parts in _shards(batch.column(1), folder, window, depth):
                for held in parts:
                    for t, at, size in maximal(shard, held):
                        doc, item = shard.doc[at], held.item[t]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(row + doc)), pa.array(at - shard.first[doc]), pa.array([held.ids[i] for i in item.tolist()], pa.string()), pa.array(t - held.first[item]), pa.array(size)],
                            names=["doc_id", "doc_word", "item_id", "item_word", "n_words"],
                        )

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"doc_id {kind}, doc_word long, item_id string, item_word long, n_words long")
