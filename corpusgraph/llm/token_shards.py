"""Training-order materialisation of token sequences.

Documents are cut into sequences of at most ``length`` tokens. A digest of a sequence's id,
text, place and copy puts it into one of many ranges; runs of ranges with about ``shard``
sequences are a shard, and the shard's sequences, in the order of their digests, are numbered densely. A
keyed Feistel network over the next even power of two, walked until it lands below
the shard's number of sequences, permutes the numbers into slots; another one, over the
ranges, decides which of them meet in a shard. So all slots together are a keyed permutation of
all sequences that depends on the rows alone, not on partitions, files or lost executors,
and tokens are shuffled once, straight to their shard. A shard is a binary file of
fixed-stride records in slot order, so a reader resumes at any slot by seeking.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import files
from .scratch import new_path, small, unit, written
from .textnum import mix
from .tokens import documents, encoder

#: Tokens in a record, records in a shard, rounds of the network.
LENGTH, SHARD, ROUNDS = 512, 32768, 6
KEY = 0x5EED
#: Ranges of the digests (one number each reaches the driver).
RANGES = 1 << 18


def token_type(tokenizer: str | None) -> str:
    """Two bytes a token where the vocabulary allows, else four (little-endian)."""
    return "<u2" if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


class Permutation:
    """A keyed bijection of ``range(n)``."""

    def __init__(self, n: int, key: int = KEY):
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = mix(np.arange(1, 2 * ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def _pass(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & self.mask)
        return (right << np.uint64(self.half)) | left

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = self._pass(x.astype(np.uint64), keys)
        while len(beyond := np.flatnonzero(out >= self.n)):
            out[beyond] = self._pass(out[beyond], keys)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self.keys[:ROUNDS])

    def number(self, slot: np.ndarray) -> np.ndarray:
        """The inverse of ``slot``: swapped halves run the rounds backwards."""
        return self._walk(slot, self.keys[:ROUNDS][::-1])


def _digest() -> tuple[Column, Column]:
    """The digest of a row ``(unit, place, copy)`` and its range."""
    digest = F.xxhash64("unit", "place", "copy")
    return digest, F.shiftrightunsigned(digest, 64 - (RANGES - 1).bit_length()).cast("int")


def _turns() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("copy")


def materialise(docs: DataFrame, folder: str, length: int = LENGTH, shard: int = SHARD, key: int = KEY, tokenizer: str | None = None) -> DataFrame:
    """Write the sequences of ``docs(doc_id, text)`` to shards in ``folder``; returns the
    written index ``slot, shard, file, record, doc_id, start, n_tokens, ids_crc32``.

    A record is a little-endian uint32 token count and ``length`` ids of two bytes (four
    for a larger vocabulary), zeros after the last. A null or empty text is one sequence of the
    end token. Repeated rows are materialised each; null ids are kept; further columns are
    ignored; an empty table gives no shards. Slots depend on the key, the two sizes and the
    rows alone, so a rerun, or one that lost executors, gives every sequence the same slot.
    Texts are tokenized twice, to count and to write, which costs less than to store tokens in between."""
    width = token_type(tokenizer)
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    base = base.select("doc_id", "text", unit("doc_id", "text").alias("unit"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [-(-len(ids) // length) for _, ids in documents(batch.column(1), tokenizer)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["unit", "n"])

    counts = base.select("unit", "text").mapInArrow(count, "unit binary, n long").groupBy("unit").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    counts = written(counts, "sequence-counts")
    spread = counts.select("unit", "n", _turns()).select("unit", "copy", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("place"))
    found = spread.select(_digest()[1].alias("range")).groupBy("range").agg(F.count("*").alias("n")).toArrow()
    # ranges in a keyed order, then runs of them as shards
    order = Permutation(RANGES, key).slot(np.arange(RANGES))
    sums = np.zeros(RANGES, dtype=np.int64)
    sums[order[found["range"].to_numpy()]] = found["n"].to_numpy()
    shard_of = ((np.cumsum(sums) - sums) // shard).astype(np.int32)
    sizes = np.bincount(shard_of, sums, int(shard_of[-1]) + 1).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    shared = docs.sparkSession.sparkContext.broadcast((shard_of[order], sizes, first))

    repeated = counts.where("copies > 1").select("unit", "copies")
    n_repeated = repeated.count()
    rows = base.withColumn("copies", F.lit(1).cast("long"))
    if n_repeated:  # copies in id and text meet as one row that counts them
        again = small(repeated, n_repeated)
        one = base.join(again, "unit").groupBy("unit").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("copies").alias("copies"))
        rows = rows.join(again.select("unit"), "unit", "left_anti").select("doc_id", "text", "unit", "copies").unionByName(one)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, step = ["doc_id", "unit", "copies", "place", "ids"], length * np.dtype(width).itemsize
        for batch in batches:
            held, places, parts, many = [], [], [], 0

            plain = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3)], names=["doc_id", "unit", "copies"])
            for row, ids in documents(batch.column(1), tokenizer):
                raw = ids.astype(width).tobytes()
                for j in range(-(-len(raw) // step)):
                    held.append(row)
                    places.append(j)
                    parts.append(raw[j * step : (j + 1) * step])
                many += len(raw)
                if many > 1 << 22:
                    yield _taken(plain, held, places, parts, names)
                    held, places, parts, many = [], [], [], 0
            if held:
                yield _taken(plain, held, places, parts, names)

    def to_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(0, "shard", pa.array(shared.value[0][batch.column(0).to_numpy()], pa.int32()))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, sizes, first = shared.value
        size = stride(length, width)
        now, held = -1, []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            if len(t) != sizes[now]:
                raise ValueError(f"shard {now} has {len(t)} sequences, not {sizes[now]}")
            places = Permutation(len(t), key + 1 + now).slot(np.arange(len(t)))
            records, counts, sums = np.zeros((len(t), size), dtype=np.uint8), [], []
            for at, value in zip(places.tolist(), t["ids"], strict=True):
                raw = value.as_py()
                values = np.frombuffer(raw, width)
                records[at, :4] = np.frombuffer(struct.pack("<I", len(values)), np.uint8)
                records[at, 4 : 4 + len(raw)] = np.frombuffer(raw, np.uint8)
                counts.append(len(values))
                sums.append(zlib.crc32(values.astype("<u4").tobytes()))
            name, stream = files.create(folder, ".tokens")
            with stream:
                stream.write(records.data)
            back = pa.array(np.argsort(places))  # rows in slot order, as they will be read
            n, own = len(t), t.select(["doc_id", "place"]).combine_chunks().take(back)
            columns = [pa.array(first[now] + np.arange(n)), pa.array([now] * n, pa.int32()), pa.array([name] * n), pa.array(np.arange(n)), own["doc_id"].combine_chunks(), pa.array(own["place"].to_numpy().astype(np.int64) * length), pa.array(counts, pa.int64()).take(back), pa.array(sums, pa.int64()).take(back)]
            return pa.RecordBatch.from_arrays(columns, names=["slot", "shard", "file", "record", "doc_id", "start", "n_tokens", "ids_crc32"])

        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(batch)]
            for at, to in zip(cuts, cuts[1:], strict=False):
                if to > at:
                    if shards[at] != now and held:
                        yield out()
                        held = []
                    now = int(shards[at])
                    held.append(batch.slice(at, to - at))
        if held:
            yield out()

    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = rows.select("doc_id", "text", "unit", "copies").mapInArrow(cut, f"doc_id {kind}, unit binary, copies long, place int, ids binary")
    pieces = pieces.select("doc_id", "unit", "place", "ids", _turns())
    digest, place = _digest()
    pieces = pieces.select(place.alias("shard"), digest.alias("digest"), "unit", "place", "copy", "doc_id", "ids").mapInArrow(to_shard, f"shard int, digest long, unit binary, place int, copy int, doc_id {kind}, ids binary")
    dealt = pieces.repartitionById(len(sizes), F.col("shard")).sortWithinPartitions("shard", "digest", "unit", "place", "copy")
    return written(dealt.select("shard", "place", "doc_id", "ids").mapInArrow(write, f"slot long, shard int, file string, record long, doc_id {kind}, start long, n_tokens long, ids_crc32 long"), "shard-index")


def _taken(rows: pa.RecordBatch, held: list[int], places: list[int], parts: list[bytes], names: list[str]) -> pa.RecordBatch:
    some = rows.take(pa.array(held))
    return pa.RecordBatch.from_arrays([*some.columns, pa.array(places, pa.int32()), pa.array(parts, pa.binary())], names=names)


def _ids(record: bytes, width: str) -> np.ndarray:
    return np.frombuffer(record, width, struct.unpack_from("<I", record)[0], 4).astype("<u4")


def stride(length: int, width: str) -> int:
    """Bytes of a record."""
    return 4 + length * np.dtype(width).itemsize


def read_slots(folder: str, name: str, first: int, n: int, length: int = LENGTH, width: str = "<u2") -> Iterator[np.ndarray]:
    """The ids of ``n`` records of a shard file from its record ``first`` on."""
    with files.read(folder, name) as source:
        source.seek(first * stride(length, width))
        for _ in range(n):
            yield _ids(source.read(stride(length, width)), width)


def verified(index: DataFrame, folder: str, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """``index`` with the byte offset of each record, each record having been read from
    its shard again; a record that differs from its digest is an error."""
    width = token_type(tokenizer)
    size = stride(length, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, now = None, None
        for batch in batches:
            names, records, sums = batch.column(2).to_pylist(), batch.column(3).to_numpy(), batch.column(7).to_pylist()
            for name, at, crc in zip(names, (records * size).tolist(), sums, strict=True):
                if name != now:
                    source, now = files.read(folder, name), name
                if source.tell() != at:
                    source.seek(at)
                if zlib.crc32(_ids(source.read(size), width).tobytes()) != crc:
                    raise ValueError(f"a record of {name} differs from its digest")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(records * size)], names=[*batch.schema.names, "byte_offset"])

    kind = index.schema["doc_id"].dataType.simpleString()
    return index.mapInArrow(run, f"slot long, shard int, file string, record long, doc_id {kind}, start long, n_tokens long, ids_crc32 long, byte_offset long")


def shards(docs: DataFrame) -> DataFrame:
    """Write ``docs`` to new shards in the shared folder and read them back."""
    folder = new_path(docs.sparkSession, "shards")
    return verified(materialise(docs, folder), folder)
