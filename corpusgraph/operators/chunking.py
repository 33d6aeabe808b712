"""Markdown to heading-aware chunks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import strip

_HEADING = r"(?U)^(#{1,6})\s+(.+)$"


def parse_headers(docs: DataFrame) -> DataFrame:
    """``(user_id, document_id, line, level, title)`` of each heading line of
    ``docs(user_id, document_id, content)``; lines are stripped first, code fences are
    not special."""
    lines = docs.select("user_id", "document_id", F.posexplode(F.split("content", "\n")).alias("line", "raw")).withColumn("raw", strip(F.col("raw")))
    return lines.where(F.col("raw").rlike(_HEADING)).select("user_id", "document_id", "line", F.length(F.regexp_extract("raw", _HEADING, 1)).alias("level"), strip(F.regexp_extract("raw", _HEADING, 2)).alias("title"))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _cut(docs: DataFrame) -> DataFrame:
    """The sections of each document, one row each, with ``kind`` and ``content`` but without their
    ancestors. Texts are cut where they are: no shuffle, and each line is copied once."""

    def body(lines: Column, start: Column, end: Column) -> Column:
        return strip(F.array_join(F.slice(lines, start + 1, end - start), "\n"))

    def row(start: Column, end: Column, level: Column, title: Column, kind: str, content: Column) -> Column:
        return F.struct(start.cast("int").alias("start_line"), (end - 1).cast("int").alias("end_line"), level.cast("int").alias("level"), title.alias("title"), F.lit(kind).alias("kind"), content.alias("content"))

    def of_lines(lines: Column) -> Column:
        found = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("line"), strip(x).alias("raw"))), lambda x: x["raw"].rlike(_HEADING))
        return _bound(found, lambda heads: of_heads(lines, heads))

    def of_heads(lines: Column, heads: Column) -> Column:
        size, zero = F.size(lines), F.lit(0)
        end = lambda i: F.coalesce(F.get(heads, i + 1)["line"], size)
        own = F.transform(heads, lambda h, i: row(h["line"], end(i), F.length(F.regexp_extract(h["raw"], _HEADING, 1)), strip(F.regexp_extract(h["raw"], _HEADING, 2)), "section", body(lines, h["line"], end(i))))
        first = F.get(heads, zero)["line"]
        none = F.array().cast(_SECTION)
        intro = F.when(first > 0, F.array(row(zero, first, zero, F.lit("Introduction"), "intro", body(lines, zero, first)))).otherwise(none)
        return F.when(F.size(heads) == 0, F.array(row(zero, size, zero, F.lit("Document"), "document", body(lines, zero, size)))).otherwise(F.concat(intro, own))

    # an outer explode, as Spark computes what others explode a second time to filter it
    rows = docs.select("user_id", "document_id", F.explode_outer(_bound(F.split("content", "\n"), of_lines)).alias("s"))
    return rows.select("user_id", "document_id", "s.*").where("content <> ''")


_SECTION = "array<struct<start_line:int,end_line:int,level:int,title:string,kind:string,content:string>>"
_KEY = ["user_id", "document_id"]


def _before() -> tuple[Window, Window]:
    """Document order, and the rows before the current one in it."""
    order = Window.partitionBy(*_KEY).orderBy(F.when(F.col("kind") == "intro", 0).otherwise(1), "start_line", "part")
    return order, order.rowsBetween(Window.unboundedPreceding, -1)


def _with_ancestors(rows: DataFrame, *more: Column) -> DataFrame:
    """``rows`` with ``path`` and ``parent_line``: the last heading of a level is an ancestor if no
    heading above that level came after it."""
    _, before = _before()
    last = [F.max(F.when(F.col("level") == k, F.struct("start_line", "title"))).over(before).alias(f"p{k}") for k in range(1, 7)]
    ancestors = []
    for k in range(1, 7):
        above = [F.col(f"p{j}.start_line") for j in range(1, k)]
        floor = F.coalesce(F.greatest(*above) if len(above) > 1 else above[0], F.lit(-1)) if above else F.lit(-1)
        ancestors.append(F.when((F.lit(k) < F.col("level")) & (F.col(f"p{k}.start_line") > floor), F.col(f"p{k}")))
    found = rows.select("*", *last, *more).withColumn("up", F.array_compact(F.array(*ancestors)))
    path = F.concat(F.transform("up", lambda x: x["title"]), F.array("title"))
    return found.withColumn("path", path).withColumn("parent_line", F.try_element_at("up", F.lit(-1))["start_line"]).drop("up", *(f"p{k}" for k in range(1, 7)))


def sections(docs: DataFrame) -> DataFrame:
    """One row per section: ``user_id, document_id, start_line, end_line, level, path,
    parent_line, kind, content``. A section runs to the next heading of any level. The
    path has the titles of the ancestors, found by running maxima for each level. Text before
    the first heading is ``Introduction``, a text without headings ``Document``; blank
    content gives no row."""
    return _with_ancestors(_cut(docs).withColumn("part", F.lit(0))).select(*_KEY, "start_line", "end_line", "level", "path", "parent_line", "kind", "content")


def _joined(pieces: list[tuple[str, str, bool]], most: int) -> list[str]:
    """Parts of at most ``most`` characters from pieces ``(text, gap before it, starts anew)``."""
    out, open_, size = [], [], 0
    for text, gap, fresh in pieces:
        if not fresh and size + len(gap) + len(text) <= most:
            open_ += [gap, text] if size else [text]
            size += len(gap) * (size > 0) + len(text)
        else:
            if size:
                out.append("".join(open_))
            open_, size = [text], len(text)
    return [*out, "".join(open_)] if size else out


def split_text(content: Column | str, most: int = vocab.CHUNK_CHARS) -> Column:
    """Parts of at most ``most`` characters: paragraphs are joined while they fit; a longer
    paragraph starts anew and is joined by sentences, the last of which goes on with the
    next paragraph. A sentence that is too long stays whole; no text has no parts. Spark cuts the text
    into pieces; one pass over them carries the open part, in time linear in the text."""
    content = F.col(content) if isinstance(content, str) else content
    piece = lambda x, gap, fresh: F.struct(x.alias("text"), F.lit(gap).alias("gap"), fresh.alias("fresh"))
    by_sentence = lambda p: F.transform(F.split(p, r"(?U)(?<=[.!?。！？])\s+"), lambda x, i: piece(x, " ", i == 0))
    whole = lambda c: F.array(piece(c, "", F.lit(True)))
    cut = lambda c: F.flatten(F.transform(F.split(c, r"(?U)\n\s*\n"), lambda p: F.when(F.length(p) > most, by_sentence(p)).otherwise(F.array(piece(p, "\n\n", F.lit(False))))))
    pieces = _bound(F.coalesce(content, F.lit("")), lambda c: F.when(F.length(c) <= most, whole(c)).otherwise(cut(c)))

    @F.arrow_udf("array<string>")
    def parts(column: pa.Array) -> pa.Array:
        text, gap, fresh = (column.values.field(k).to_pylist() for k in range(3))
        ends = column.offsets.to_pylist()
        return pa.array([_joined(list(zip(text[a:b], gap[a:b], fresh[a:b], strict=True)), most) for a, b in zip(ends, ends[1:], strict=False)], pa.list_(pa.string()))

    return parts(pieces)


def add_overlap(parts, n: int = vocab.OVERLAP_CHARS):
    """Each part but the first with the last ``n`` characters of the one before in front."""
    if n == 0:
        return parts
    return F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.right(F.get(parts, i - 1), F.lit(n)), x)))


def chunk_documents(docs: DataFrame, overlap: int = vocab.OVERLAP_CHARS) -> DataFrame:
    """The chunks of ``docs(user_id, document_id, content)`` with hierarchy, links and
    order. Ids are ``document:line`` of the section (zero padded, so they sort in document
    order), with ``_j`` for later parts; all parts of a text without headings carry one.

    Sections are cut and split where the documents are; the chunks are shuffled once, by document, and
    everything that looks at others (overlap, ancestors, links) is a window in document order."""
    cut = _cut(docs).withColumn("parts", split_text("content")).select("*", F.posexplode_outer(F.when(F.col("kind") == "intro", F.array("content")).otherwise(F.col("parts"))).alias("part", "body")).drop("content", "parts")
    name = lambda line, kind: F.concat(F.col("document_id"), F.lit(":"), kind, F.lpad(line.cast("string"), 9, "0"))
    suffix = lambda j: F.concat(F.lit("_"), F.lpad(j.cast("string"), 6, "0"))
    order, before = _before()
    rows = cut.withColumn("base_id", name(F.col("start_line"), F.when(F.col("kind") == "intro", "a").otherwise("b")))
    lone = (F.col("kind") == "document") & F.lead("part").over(order).isNull()  # the last part: of several if it isn't the first
    rows = rows.withColumn("chunk_id", F.when((F.col("part") > 0) | ((F.col("kind") == "document") & ~lone), F.concat("base_id", suffix(F.col("part")))).otherwise(F.col("base_id")))
    ends = [F.max(F.when(F.col("level") == k, F.struct("start_line", "part", "chunk_id"))).over(before).alias(f"e{k}") for k in range(1, 7)]
    rows = _with_ancestors(rows, *ends, F.lag("body").over(order).alias("last_body"))
    ancestor = F.coalesce(*(F.when(F.col(f"e{k}.start_line") == F.col("parent_line"), F.col(f"e{k}.chunk_id")) for k in range(1, 7)))
    later = (F.col("part") > 0) & (F.col("kind") == "section")
    parent = F.when(~later, ancestor).when(F.col("part") == 1, F.col("base_id")).otherwise(F.concat("base_id", suffix(F.col("part") - 1)))
    rows = rows.withColumn("path", F.when(later, F.concat("path", F.array(F.concat(F.lit("[Part "), (F.col("part") + 1).cast("string"), F.lit("]"))))).otherwise(F.col("path")))
    body = F.when((F.col("part") > 0) & F.lit(overlap > 0), F.concat(F.right("last_body", F.lit(overlap)), "body")).otherwise(F.col("body"))
    return rows.select(
        *_KEY, "chunk_id", F.row_number().over(order).cast("long").alias("ordinal"), body.alias("content"), "level", "path", F.array_join("path", ",").alias("hierarchy_path"), parent.alias("parent_id"),
        F.lag("chunk_id").over(order).alias("prev_chunk_id"), F.lead("chunk_id").over(order).alias("next_chunk_id"), "start_line", "end_line",
    )


def next_links(chunks: DataFrame) -> DataFrame:
    """Distinct ``(user_id, from_chunk, to_chunk)`` from both neighbour columns, between
    chunks that exist."""
    pairs = chunks.where("prev_chunk_id is not null").select("user_id", F.col("prev_chunk_id").alias("from_chunk"), F.col("chunk_id").alias("to_chunk"))
    pairs = pairs.union(chunks.where("next_chunk_id is not null").select("user_id", F.col("chunk_id"), F.col("next_chunk_id"))).distinct()
    ids = chunks.select("user_id", "chunk_id")
    return pairs.join(ids.withColumnRenamed("chunk_id", "from_chunk"), ["user_id", "from_chunk"], "left_semi").join(ids.withColumnRenamed("chunk_id", "to_chunk"), ["user_id", "to_chunk"], "left_semi")
