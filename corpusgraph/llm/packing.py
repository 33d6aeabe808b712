"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two of n's
binary form (those above the sequence length as several full sequences), longest
first. Pieces of one length share a bucket, and every piece is a sequence of its own:
no sequence crosses documents and none needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .tokens import documents

#: Longest sequence; a power of two.
LENGTH = 4096


def decompose(n: int, longest: int = LENGTH) -> list[int]:
    """Piece lengths of a document of ``n`` tokens, longest first; they sum to n."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, longest: int = LENGTH, tokenizer: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, bucket, ids_crc32, doc_tokens`` and,
    if asked for, ``ids``. ``bucket`` is log2 of the length."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, start long, length long, bucket int, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    names = ["doc_id", "start", "length", "bucket", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tokens, held, many = [], [], [], 0

            def out() -> pa.RecordBatch:
                row, start, length, crc, total = (np.array(x, dtype=np.int64) for x in zip(*held, strict=True))
                columns = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(np.log2(length).astype(np.int32)), pa.array(crc), pa.array(total)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.concatenate(tokens).view(np.int32))))
                return pa.RecordBatch.from_arrays(columns, names=names)

            for row, ids in documents(batch.column(1), tokenizer):
                at, raw = 0, memoryview(ids.astype("<u4").tobytes())
                for size in decompose(len(ids), longest):
                    held.append((row, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), len(ids)))
                    at += size
                if with_ids:
                    tokens.append(ids)
                    many += len(ids)
                if many > 1 << 19 or len(held) > 1 << 15:
                    yield out()
                    held, tokens, many = [], [], 0
            if held:
                yield out()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(docs: DataFrame, longest: int = LENGTH, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """The pieces of all ``docs(doc_id, text)`` with ``sequence_id, offset``.

    Each piece is numbered as it is written to the shared folder, so its number stays what it
    is when the table is read again; within a file, pieces lie by bucket, so equal
    lengths are read together. A null or empty text is its end token alone: one piece of
    length 1. Repeated and null ids are packed row by row; further columns are ignored; an
    empty table gives no rows."""
    made = pieces(docs, longest, tokenizer, with_ids).withColumn("sequence_id", F.monotonically_increasing_id())
    return written(made.sortWithinPartitions("bucket"), "pieces").withColumn("offset", F.lit(0).cast("long"))


def write_sequences(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, a folder for each bucket of equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)
