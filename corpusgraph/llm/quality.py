"""Quality rules: per-document measures and cross-document line frequency.

Lines are normalised (runs of white space count as one, A-Z as a-z) and hashed; the
distinct documents that hold a line are counted for each host. A line in more than
``max_docs`` documents of its host is common.

Common lines are removed from all documents but one keeper each (``keepers``), so that one
copy of any text of the documents that pass the base rules stays; a document that loses
more than ``max_lost`` percent of its words is rejected as depleted. Verdicts are by row:
rows that share an id, or have none, are judged each by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import private, small, unit, written
from .textnum import Block, _powers, blocks, mix

#: A line in more documents of a host than this is boilerplate.
MAX_DOCS = 10
#: A document that loses more than this percentage of its words is depleted.
MAX_LOST = 70
#: Base rules: fewest words, and the largest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEATED = 10, 20
WINDOW = 5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def measures(block: Block) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The five numbers of each text, then hash and word count of its lines and each
    text's first line."""
    starts, ends, first = block.words()
    exact, folded = block.hashes(starts, ends, fold=False), block.hashes(starts, ends, fold=True)
    n_words = np.diff(first)
    depth = np.concatenate([[0], np.cumsum((block.buf & 0xC0) != 0x80, dtype=np.int64)])
    chars = np.concatenate([[0], np.cumsum(depth[ends] - depth[starts])])
    out = {"n_words": n_words, "word_chars": chars[first[1:]] - chars[first[:-1]], "n_symbols": _sums(_SYMBOL[block.buf], block.bounds)}

    text = np.repeat(np.arange(block.n), n_words)
    covered = np.zeros(len(starts) + 1, dtype=np.int64)
    if len(starts) >= WINDOW:
        size = len(starts) - WINDOW + 1
        window, factor = np.zeros(size, dtype=np.uint64), 1
        for k in range(WINDOW):
            window += exact[k : k + size] * np.uint64(factor)
            factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        at = np.flatnonzero(text[:size] == text[WINDOW - 1 :])
        _, which, count = np.unique(mix(window[at] + mix(text[at].astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
        again = at[count[which] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, np.minimum(again + WINDOW, len(starts)), -1)
    out["n_repeat_words"] = _sums(np.cumsum(covered)[:-1] > 0, first)

    line_starts, line_ends, line_first = block.lines()
    own, to = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    line_words = to - own
    line_text = np.repeat(np.arange(block.n), np.diff(line_first))
    filled = line_words > 0
    raw = block.hashes(line_starts[filled], line_ends[filled], fold=False)
    _, seen = np.unique(mix(raw + mix(line_text[filled].astype(np.uint64) + np.uint64(1))), return_index=True)
    fresh = np.bincount(line_text[filled][seen], minlength=block.n)
    out["n_dup_lines"] = np.bincount(line_text[filled], minlength=block.n) - fresh

    power, inverse = _powers(1 << max(19, len(starts).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(folded * power[: len(folded)], dtype=np.uint64)])
    hashes = mix((total[to] - total[own]) * inverse[own] + line_words.astype(np.uint64))
    return out, hashes, line_words, line_first


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id, host, unit``, the five numbers, ``lines`` (hashes) and ``line_words``."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("unit", unit("doc_id", "host", "text"))
    schema = f"doc_id {base.schema['doc_id'].dataType.simpleString()}, host string, unit binary, " + ", ".join(f"{x} long" for x in _NUMBERS) + ", lines array<long>, line_words array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                numbers, hashes, words, first = measures(block)
                rows = batch.slice(block.first, block.n)
                offsets = pa.array(first, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), rows.column(3), *(pa.array(numbers[x], pa.int64()) for x in _NUMBERS)]
                    + [pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(words, pa.int32()))],
                    names=["doc_id", "host", "unit", *_NUMBERS, "lines", "line_words"],
                )

    return base.mapInArrow(run, schema)


def keepers(profiles: DataFrame, max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST) -> DataFrame:
    """``(unit, removed, n_removed_words, keeps)`` of the rows that pass the base rules and
    hold a common line, with one keeper for each of these lines.

    A line is common if more than ``max_docs`` distinct ids of its host hold it (a row
    without an id counts as a document of its own). First the smallest id (null last) among the
    rows that pass keeps a line. Where its row is depleted, the smallest id among rows that
    aren't does; that only gives them lines back. Where all are depleted, the smallest
    id keeps the line and its row is exempt from depletion (``keeps``)."""
    key = F.xxhash64(F.col("host").isNull(), F.col("host"), F.col("x.line"))
    zipped = F.arrays_zip(F.col("lines").alias("line"), F.col("line_words").alias("words"))
    lines = profiles.select("doc_id", "unit", "n_words", base_failed().alias("failed"), "host", F.explode(zipped).alias("x")).where("x.words > 0")
    lines = lines.select("doc_id", "unit", "n_words", "failed", key.alias("key"), "x.line", "x.words")
    who = F.coalesce(F.col("doc_id").cast("string").cast("binary"), F.col("unit")).alias("who")
    common = written(lines.select("key", who).distinct().groupBy("key").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs).select("key"), "common-lines")
    n_common = common.count()
    # rows that are copies of one another are one unit, and its words count once
    copies = profiles.groupBy("unit").agg(F.count("*").alias("copies"))
    held = lines.where("not failed").join(small(common, n_common), "key").groupBy("unit", "doc_id", "n_words", "key", "line").agg(F.sum("words").alias("words"))
    held = written(held.join(copies, "unit").withColumn("words", F.expr("words div copies")).drop("copies"), "holders")
    gone = F.col("keeper") != F.col("unit")
    place = [F.col("doc_id").isNull().alias("none"), "doc_id", "unit"]

    first = held.groupBy("key").agg(F.min(F.struct(*place))["unit"].alias("keeper"))
    lost = held.join(small(first, n_common), "key").groupBy("unit", "n_words").agg(F.sum(F.when(gone, F.col("words")).otherwise(0)).alias("lost"))
    lost = lost.select("unit", (100 * F.col("lost") > max_lost * F.col("n_words")).alias("depleted"))
    final = held.join(lost, "unit").groupBy("key").agg(F.min(F.struct("depleted", *place))["unit"].alias("keeper"))
    return (
        held.join(small(final, n_common), "key")
        .groupBy("unit")
        .agg(F.collect_list(F.when(gone, F.col("line"))).alias("removed"), F.sum(F.when(gone, F.col("words")).otherwise(0)).alias("n_removed_words"), F.max(~gone).alias("keeps"))
    )


def judged(docs: DataFrame, max_docs: int, max_lost: int, columns: tuple[str, str, str] = ("doc_id", "text", "source")) -> DataFrame:
    """``profile`` of each row with ``base_failed, removed, n_removed_words, kept``."""
    profiles = written(profile(docs, *columns), "profiles")
    joined = profiles.join(keepers(profiles, max_docs, max_lost), "unit", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    fit = F.coalesce("keeps", F.lit(False)) | (100 * F.col("n_removed_words") <= max_lost * F.col("n_words"))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & fit)


def quality(docs: DataFrame, max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST) -> DataFrame:
    """One row per document: ``doc_id, host``, the five numbers, ``base_failed, removed,
    n_removed_words, kept``.

    ``docs`` needs ``doc_id, text, source``; other columns are ignored. A null or
    empty text has zeros and fails the base rules. A null source is a host of its own.
    ``n_removed_words`` is 0 where the base rules fail. Repeated rows have the same verdict
    each. An empty table gives no rows."""
    return judged(docs, max_docs, max_lost).select("doc_id", "host", *_NUMBERS, "base_failed", "removed", "n_removed_words", "kept")


def apply_quality(docs: DataFrame, max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST) -> DataFrame:
    """The kept rows of ``docs``, all columns unchanged but ``text``, which has lost
    its common lines but those that it keeps (and ``n_chars``, if there, which follows
    it)."""
    own, key, gone = private(docs, "unit", "key", "removed")
    verdict = judged(docs, max_docs, max_lost).where("kept").groupBy("unit").agg(F.first("removed").alias(gone)).withColumnRenamed("unit", key)
    keyed = docs.withColumn(own, unit("doc_id", "source", "text"))
    joined = keyed.join(verdict, F.col(own) == F.col(key)).select(*(F.col(f"`{x}`") for x in docs.columns), gone)
    names, text = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = batch.column(text), batch.column(len(names))
            if removed.null_count < len(batch):
                values = texts.to_pylist()
                for block in blocks(texts):
                    for i in range(block.n):
                        drop = removed[block.first + i].as_py()
                        if drop:
                            one = Block(block.buf[block.bounds[i] : block.bounds[i + 1]], np.array([0, block.bounds[i + 1] - block.bounds[i]]), 0)
                            _, hashes, _, _ = measures(one)
                            gone = np.isin(hashes.view(np.int64), np.array(drop, dtype=np.int64))
                            lines = values[block.first + i].split("\n")
                            values[block.first + i] = "\n".join(x for x, y in zip(lines, gone.tolist(), strict=True) if not y)
                texts = pa.array(values, batch.schema.field(text).type)
            yield pa.RecordBatch.from_arrays([texts if k == text else batch.column(k) for k in range(len(names))], names=names)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
