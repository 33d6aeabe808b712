"""Words as runs of letters, on code points of lower-cased text."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .textnum import Block, _powers, mix


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its one-character lower case, and whether it is a letter."""
    low, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, dtype=bool)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            letter[k] = True
            if len(x := c.lower()) == 1:
                low[k] = ord(x)
    return low, letter


class Letters:
    """``points`` of a block in lower case; word ``w`` lies at ``starts[w]:ends[w]`` and
    text ``i`` has words ``first[i]:first[i + 1]``."""

    def __init__(self, block: Block):
        low, letter = _tables()
        self.points = low[np.frombuffer(block.buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)]
        lead = np.concatenate([[0], np.cumsum((block.buf & 0xC0) != 0x80)])
        self.bounds = lead[block.bounds]
        self.letter = letter[self.points]
        n = len(self.points)
        self.begin, last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        inner = self.bounds[1:-1]
        if n:
            self.begin[0], self.begin[1:] = True, ~self.letter[:-1]
            self.begin[inner[inner < n]] = True
            last[-1], last[:-1] = True, ~self.letter[1:]
            last[inner[inner > 0] - 1] = True
            self.begin &= self.letter
            last &= self.letter
        self.last = last
        self.starts, self.ends = np.flatnonzero(self.begin), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.n = block.n

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``longest`` letters."""
        power, inverse = _powers(1 << max(19, len(self.points).bit_length()))
        total = np.zeros(len(self.points) + 1, dtype=np.uint64)
        np.cumsum(mix(self.points.astype(np.uint64) + np.uint64(0x9E37)) * power[: len(self.points)], dtype=np.uint64, out=total[1:])
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        return mix((total[ends] - total[self.starts]) * inverse[self.starts] + (ends - self.starts).astype(np.uint64))

    def trigrams(self, bits: int) -> np.ndarray:
        """A hash of ``bits`` bits for each letter with its neighbours in the word (0
        beyond its ends); letters in order."""
        at = np.flatnonzero(self.letter)
        here = self.points.astype(np.uint64)
        before = np.where(self.begin[at], 0, here[np.maximum(at - 1, 0)])
        after = np.where(self.last[at], 0, here[np.minimum(at + 1, len(here) - 1)])
        key = before * np.uint64(0x9E3779B97F4A7C15) + here[at] * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9)
        return ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)
