"""Token ids of whole texts with the public word-level BPE, at the speed of a cache.

White space never reaches the model and nothing merges across the tokenizer's own
split, so texts of Latin-1 characters are lower-cased and cut by that split as byte
arrays, and each distinct piece is encoded once per worker. A text with any other
character, or with a special token's string, goes through the tokenizer itself, a
long one in cuts at spaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textnum import Block, blocks

TOKENIZER = "word_bpe_49k.json"
#: The id that ends a document.
END = 2
#: Distinct pieces that a worker remembers before it starts afresh.
REMEMBER = 600_000
#: Pieces that are looked up at a time; with those remembered, at most half of the slots fill.
STEP = 400_000
_SLOTS = 1 << 21
#: Texts that go through the tokenizer are cut at a space after about so many bytes.
CUT = 1 << 20

_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
#: Classes of single bytes (ASCII, lower case) and of what follows the lead bytes C2 and C3.
_ONE = np.full(256, _OTHER, dtype=np.uint8)
_ONE[list(b"\t\n\v\f\r ")] = _SPACE
_ONE[list(b"abcdefghijklmnopqrstuvwxyz")] = _LETTER
_ONE[list(b"0123456789")] = _DIGIT
_C2 = np.full(256, _OTHER, dtype=np.uint8)
_C2[[0x85, 0xA0]] = _SPACE
_C2[[0xAA, 0xB5, 0xBA]] = _LETTER
_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _DIGIT
_C3 = np.full(256, _LETTER, dtype=np.uint8)
_C3[[0x97, 0xB7]] = _OTHER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_AFTER_C3 = np.arange(256, dtype=np.uint8)
_AFTER_C3[[x for x in range(0x80, 0x9F) if x != 0x97]] += 32
_PAIRS = np.zeros((256, 256), dtype=bool)
for _a, _b in (b"re", b"ve", b"ll"):
    _PAIRS[_a, _b] = True


def pieces(block: Block) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
    """The block in lower case, and starts, ends and text numbers of its pieces; for
    texts made of Latin-1 characters only."""
    raw, n = block.buf, len(block.buf)
    buf = _LOWER[raw]
    after2, after3 = np.flatnonzero(raw[:-1] == 0xC2) + 1, np.flatnonzero(raw[:-1] == 0xC3) + 1
    buf[after3] = _AFTER_C3[raw[after3]]
    kind = _ONE[buf]
    for at, table in ((after2, _C2), (after3, _C3)):
        kind[at] = kind[at - 1] = table[buf[at]]
    begin = np.empty(n, dtype=bool)
    if n:
        begin[0] = True
        begin[1:] = kind[1:] != kind[:-1]
        begin[1:] |= (kind[1:] == _DIGIT) & ((buf[1:] & 0xC0) != 0x80)
        bounds = block.bounds[:-1]
        begin[bounds[bounds < n]] = True
        marks = np.flatnonzero((buf == 0x27) & begin)
        if len(marks):
            text = np.searchsorted(block.bounds, marks, side="right")
            room = block.bounds[text] - marks
            tail = np.concatenate([buf, np.zeros(2, np.uint8)])
            one = np.isin(tail[marks + 1], np.frombuffer(b"stmd", np.uint8)) & (room >= 2)
            two = _PAIRS[tail[marks + 1], tail[marks + 2]] & (room >= 3)
            begin[marks[one | two] + 1] = False
            cut = np.concatenate([marks[one] + 2, marks[two] + 3])
            begin[cut[cut < n]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n) if n else starts
    filled = kind[starts] != _SPACE
    starts, ends = starts[filled], ends[filled]
    return Block(buf, block.bounds, block.first), starts, ends, np.searchsorted(starts, block.bounds)


class Encoder:
    """Encodes columns of texts to uint32 ids, without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: How the tokenizer spells each byte.
        self.spell = {}
        for k in range(256):
            char = chr(k)
            if k < 0x80:
                self.spell[k] = level.pre_tokenize_str(char)[0][0]
            else:
                raw = char.encode()
                for byte, letter in zip(raw, level.pre_tokenize_str(char)[0][0], strict=True):
                    self.spell[byte] = letter
        self.forget()

    def forget(self) -> None:
        """An empty memory: an open-addressing table from piece hashes to spans of ids."""
        self.slots = np.zeros(_SLOTS, dtype=np.uint64)
        self.span = np.zeros((_SLOTS, 2), dtype=np.int32)
        self.pool, self.used, self.known = np.zeros(1 << 16, dtype=np.uint32), 0, 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key its slot, or the empty slot where its probe ended; and whether
        it is there."""
        at = (keys >> np.uint64(20)).astype(np.int64) & (_SLOTS - 1)
        held = self.slots[at]
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (_SLOTS - 1)
            held[open_] = self.slots[at[open_]]
            open_ = open_[(held[open_] != keys[open_]) & (held[open_] != 0)]
        return at, held == keys

    def _learn(self, keys: np.ndarray, low: Block, starts: np.ndarray, ends: np.ndarray) -> None:
        keys, one = np.unique(keys, return_index=True)
        raw, spell, tokenize = low.buf.tobytes(), self.spell, self.tokenizer.model.tokenize
        found = [[t.id for t in tokenize("".join([spell[b] for b in raw[i:j]]))] for i, j in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        size = np.array([len(x) for x in found], dtype=np.int64)
        ids = np.array([x for y in found for x in y], dtype=np.uint32)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + len(ids), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(size) - size
        self.used += len(ids)
        self.known += len(keys)
        left = np.arange(len(keys))
        while len(left):  # of keys that end at one slot, the first takes it and the others probe on
            at, _ = self._find(keys[left])
            slot, own = np.unique(at, return_index=True)
            self.slots[slot] = keys[left[own]]
            self.span[slot] = np.stack([begin[left[own]], size[left[own]]], axis=1)
            left = np.delete(left, own)

    def _plain(self, block: Block) -> np.ndarray:
        """Which texts hold Latin-1 characters and no special token only."""
        plain = np.ones(block.n, dtype=bool)
        plain[np.searchsorted(block.bounds, np.flatnonzero(block.buf >= 0xC4), side="right") - 1] = False
        raw = block.buf.tobytes()
        for special in self.special:
            at = raw.find(special)
            while at >= 0:
                plain[np.searchsorted(block.bounds, at, side="right") - 1] = False
                at = raw.find(special, at + 1)
        return plain

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of rows: the first row, all their ids in one array, and the offset of
        each row in it (one more closes the last). Null and empty texts have no ids."""
        for block in blocks(column):
            plain = self._plain(block)
            if plain.all():
                yield block.first, *self._fast(block)
                continue
            parts = []
            for i in range(block.n):
                own = block.buf[block.bounds[i] : block.bounds[i + 1]]
                if plain[i]:
                    parts.append(self._fast(Block(own, np.array([0, len(own)]), 0))[0])
                else:
                    parts.append(self._slow(own.tobytes()))
            yield block.first, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _slow(self, raw: bytes, cut: int = CUT) -> np.ndarray:
        """Ids by the tokenizer itself. A space between words belongs to no piece and to no special
        token, so cuts there change nothing."""
        out, at = [], 0
        while at < len(raw):
            to = raw.find(b" ", at + cut)
            to = len(raw) if to < 0 else to + 1
            out.append(np.array(self.tokenizer.encode(raw[at:to].decode(), add_special_tokens=False).ids, dtype=np.uint32))
            at = to
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def _fast(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        low, starts, ends, first = pieces(block)
        every = low.hashes(starts, ends, fold=False) | np.uint64(1)
        found, sizes = [], []
        for a in range(0, len(every), STEP):
            if self.known > REMEMBER:
                self.forget()
            keys = every[a : a + STEP]
            at, there = self._find(keys)
            if not there.all():
                self._learn(keys[~there], low, starts[a : a + STEP][~there], ends[a : a + STEP][~there])
                at[~there] = self._find(keys[~there])[0]
            begin, size = self.span[at].T.astype(np.int64)
            offset = np.cumsum(size)
            found.append(self.pool[np.arange(offset[-1]) + np.repeat(begin - (offset - size), size)])
            sizes.append(size)
        offset = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
        return np.concatenate(found) if found else np.zeros(0, np.uint32), offset[first]


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder per worker process and file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def documents(column: pa.Array, path: str | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, ids)`` of each text, ``END`` last; a null or empty text is ``END`` alone."""
    for first, ids, offset in encoder(path).encode(column):
        for i in range(len(offset) - 1):
            yield first + i, np.append(ids[offset[i] : offset[i + 1]], np.uint32(END))
