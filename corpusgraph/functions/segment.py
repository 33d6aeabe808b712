"""Words of text without spaces: the most probable path through a dictionary's word graph."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A dictionary is sent to all tasks, so it has no more words than this.
MOST_WORDS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Dictionary:
    """Words with their frequencies, looked up by hash and length and confirmed letter by letter. Prefixes
    need no entries of their own: all lengths up to the longest word are looked up at once."""

    def __init__(self, words: Mapping[str, float]):
        if not 0 < len(words) <= MOST_WORDS:
            raise ValueError(f"a dictionary has 1 to {MOST_WORDS} words")
        total = math.log(sum(words.values()))
        self.rare = -total  # the log probability of a character that is in no word
        self.longest = max(map(len, words))
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in {len(x) for x in words}:
            own = [x for x in words if len(x) == size and words[x] > 0]
            points = _points("".join(own)).reshape(len(own), size)
            hashes = _hash(points)
            order = np.argsort(hashes, kind="stable")
            self.of[size] = hashes[order], points[order], np.array([math.log(words[x]) - total for x in own])[order]

    def weights(self, points: np.ndarray, size: int) -> np.ndarray:
        """The log probability of the word of ``size`` characters at each position; -inf where there is none."""
        out = np.full(len(points), -np.inf)
        if size in self.of and len(points) >= size:
            hashes, words, weight = self.of[size]
            seen = np.lib.stride_tricks.sliding_window_view(points, size)
            asked = _hash(seen)
            at = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
            good = (hashes[at] == asked) & (words[at] == seen).all(axis=1)
            out[: len(seen)][good] = weight[at[good]]
        if size == 1:
            out = np.where(np.isneginf(out), self.rare, out)
        return out

    def cut(self, runs: list[str]) -> list[list[str]]:
        """The words of each run. Ties go to the longer word. All runs are worked through together, from their
        last characters on, so the number of steps is the length of the longest run."""
        sizes = np.array([len(x) for x in runs], dtype=np.int64)
        ends = np.cumsum(sizes)
        points = _points("".join(runs))
        n = len(points)
        left = np.repeat(ends, sizes) - np.arange(n)  # characters to the end of the run
        by_size = [np.where(left >= k, self.weights(points, k), -np.inf) for k in range(1, min(self.longest, int(sizes.max(initial=0))) + 1)]
        best, step = np.zeros(n + 1), np.ones(n, dtype=np.int64)
        order = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[order], np.arange(1, int(sizes.max(initial=0)) + 2))
        for d in range(1, len(bounds)):
            at = order[bounds[d - 1] : bounds[d]]  # the positions with d characters left
            score, size = np.full(len(at), -np.inf), np.ones(len(at), dtype=np.int64)
            for k in range(1, min(len(by_size), d) + 1):
                one = by_size[k - 1][at] + (best[at + k] if k < d else 0)
                better = one >= score
                score, size = np.where(better, one, score), np.where(better, k, size)
            best[at], step[at] = score, size
        out = []
        for run, start in zip(runs, (ends - sizes).tolist(), strict=True):
            words, at = [], 0
            while at < len(run):
                words.append(run[at : at + int(step[start + at])])
                at += len(words[-1])
            out.append(words)
        return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hash(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), dtype=np.uint64)
    for k in range(points.shape[1]):
        out = (out ^ points[:, k].astype(np.uint64)) * _BASE
        out ^= out >> np.uint64(29)
    return out


def word_tokens(words: Mapping[str, float], run: str = r"[一-鿿]+", least: int = 2) -> Callable[[Column], Column]:
    """A tokenizer for the keyword index: lower-case runs of letters or digits outside ``run``, and the
    dictionary's words of what ``run`` matches (by default ideographs); of ``least`` characters or more.
    ``words`` are word frequencies; characters in no word stand alone."""
    held = Dictionary(words)

    @F.arrow_udf("array<string>")
    def segmented(column: pa.Array) -> pa.Array:
        ends = column.offsets.to_pylist()
        cut = held.cut(column.values.slice(ends[0], ends[-1] - ends[0]).to_pylist())
        return pa.array([[w for x in cut[a - ends[0] : b - ends[0]] for w in x if len(w) >= least] for a, b in zip(ends, ends[1:], strict=False)], pa.list_(pa.string()))

    def tokens(col: Column) -> Column:
        low = F.lower(F.coalesce(col, F.lit("")))
        spaced = F.regexp_extract_all(F.regexp_replace(low, run, " "), F.lit(rf"[\p{{L}}\p{{N}}]{{{least},}}"), F.lit(0))
        return F.concat(spaced, segmented(F.regexp_extract_all(low, F.lit(run), F.lit(0))))

    return tokens
