"""Vectorised word, line and shingle arithmetic over Arrow string columns.

A column of texts is read as one UTF-8 byte buffer and worked through in blocks
of whole documents, so memory is bounded by ``BLOCK`` bytes or the longest
single text. Words are maximal runs of bytes other than space and TAB..CR.
Hashes are polynomials modulo 2**64 over a random byte table, finished with a
bit mixer; they depend on content alone, so they agree between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
SHINGLE = 5

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.default_rng(20240501).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _TABLE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]
_P = 0x9E3779B97F4A7C15
_Q = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""

    def run(x: int) -> np.ndarray:
        out = np.full(n + 1, x, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(_P), run(pow(_P, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Some whole texts of a column: ``buf`` holds their bytes, text ``i`` of the
    block lies at ``bounds[i]:bounds[i + 1]`` and is row ``first + i``."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, first: int):
        self.buf, self.bounds, self.first = buf, bounds, first
        self.n = len(bounds) - 1

    def words(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (byte offsets) of all words, and per text the index of
        its first word (one more entry closes the last text). ``keep`` tells the bytes of
        words, if they are others than those that aren't white space."""
        keep = ~_WS[self.buf] if keep is None else keep
        inner = self.bounds[1:-1]
        inner = inner[inner < len(self.buf)]
        before = np.empty_like(keep)
        if len(keep):
            before[0] = False
            before[1:] = keep[:-1]
            before[inner] = False
        starts = np.flatnonzero(keep & ~before)
        after = np.empty_like(keep)
        if len(keep):
            after[-1] = False
            after[:-1] = keep[1:]
            after[inner[inner > 0] - 1] = False
        ends = np.flatnonzero(keep & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
        """A 64-bit hash of each byte span; ``fold`` lower-cases A-Z."""
        size = BLOCK if len(self.buf) <= BLOCK else 1 << (len(self.buf) - 1).bit_length()
        power, inverse = _powers(size)
        total = np.zeros(len(self.buf) + 1, dtype=np.uint64)
        np.cumsum((_FOLDED if fold else _TABLE)[self.buf] * power[: len(self.buf)], dtype=np.uint64, out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all LF-split lines (empty ones too) and per text the
        index of its first line."""
        feeds = np.flatnonzero(self.buf == 10)
        starts = np.concatenate([self.bounds[:-1], feeds + 1])
        order = np.argsort(starts, kind="stable")
        text = np.concatenate([np.arange(self.n), np.searchsorted(self.bounds, feeds, side="right") - 1])[order]
        order2 = np.argsort(text, kind="stable")
        starts, text = starts[order][order2], text[order2]
        first = np.searchsorted(text, np.arange(self.n + 1))
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:] - 1
        ends[first[1:] - 1] = self.bounds[1:]
        return starts, ends, first


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[Block]:
    """Blocks of a string column; a null text is an empty one."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        base = 0
        chunk = chunk.cast(pa.large_string()).fill_null("")
        _, offsets, data = chunk.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(chunk):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
            own = bounds[at : to + 1]
            yield Block(raw[own[0] : own[-1]], own - own[0], base + at)
            at = to
        base += len(chunk)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word windows of each text, and per text the index of
    its first window. A text of fewer words (but some) has one: its whole sequence."""
    count = np.diff(first)
    n = len(words)
    sums = np.zeros(max(n - width + 1, 0), dtype=np.uint64)
    factor = np.uint64(1)
    for k in range(width):
        sums += words[k : n - width + 1 + k] * factor if len(sums) else 0
        factor = np.uint64(int(factor) * int(_Q) % (1 << 64))
    windows = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(windows)])
    text = np.repeat(np.arange(len(count)), windows)
    at = first[:-1][text] + (np.arange(begin[-1]) - begin[:-1][text])
    out = np.empty(len(at), dtype=np.uint64)
    full = count[text] >= width
    out[full] = sums[at[full]]
    for i in np.flatnonzero(~full):
        own, factor, total = words[first[text[i]] : first[text[i] + 1]], 1, 0
        for w in own.tolist():
            total = (total + w * factor) % (1 << 64)
            factor = factor * int(_Q) % (1 << 64)
        out[i] = np.uint64((total + 0x5851F42D4C957F2D * len(own)) % (1 << 64))
    return mix(out), begin
