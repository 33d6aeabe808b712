"""Words as runs of bytes of a class, held as exact Arrow strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textnum import Block


def byte_class(*apart: tuple[int, int]) -> np.ndarray:
    """The bytes outside the ranges ``apart``; bytes of other than ASCII characters are in."""
    held = np.ones(256, dtype=bool)
    for low, high in apart:
        held[low : high + 1] = False
    return held


#: Letters and characters beyond ASCII: ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``.
TERM = byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Those and digits: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
WORD = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def runs(block: Block, held: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The words of a block with A-Z lower-cased, and for each text the index of its first
    one (one more entry closes the last text). A word never crosses texts."""
    inside = held[block.buf]
    starts, ends, first = block.words(inside)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[block.buf[inside]])), first
