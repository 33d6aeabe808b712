"""Dictionary-compressed WARC archives.

An archive starts with a skippable frame that holds a Zstandard dictionary built from
its own records; every record follows as a frame of its own, so any one can be read by
its offset. Records with equal payloads are revisits of the one with the smallest id. A
record's id is made of page id and payload digest, so a revisit names exactly one payload.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .scratch import new_path, spread_join, unit, written

#: Magic of the skippable frame that holds a WARC dictionary.
DICTIONARY_FRAME = 0x184D2A5D
LEVEL = 3
#: An archive is closed at about so many bytes of records; its dictionary has at most
#: so many bytes and is built from records of about so many bytes, evenly spaced.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 20, 64 << 10, 4 << 20
#: Equal payloads of fewer bytes are all responses.
MIN_REVISIT = 0


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(" " if c in "\r\n\0" else c for c in value)


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{sha1}>"


def _page(value: str) -> int | None:
    number = value.split(":")[2]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit has no body and names the payload's digest and size."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, sha1)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, sha1)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def build_dictionary(records: list[bytes]):
    """A dictionary from evenly spaced records of up to ``SAMPLE_BYTES``; None if there
    is too little to build one from."""
    import zstandard

    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    some = [x[: 1 << 17] for x in records[::step]]
    while some and sum(map(len, some)) > 2 * SAMPLE_BYTES:
        some = some[::2]
    total = sum(map(len, some))
    if len(some) < 16 or total < 1 << 14:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 8), some, k=256, d=8)
    except zstandard.ZstdError:
        return None  # too alike to build from


def write_archive(folder: str, records: list[bytes]) -> tuple[str, list[tuple[int, int]]]:
    """Write ``records`` as one archive: its name, and offset and length of each frame."""
    import zstandard

    made = build_dictionary(records)
    raw = made.as_bytes() if made else b""
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True) if made else zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
    name, out = files.create(folder, ".warc.zst")
    with out:
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        at, places = 8 + len(raw), []
        for x in records:
            frame = compressor.compress(x)
            out.write(frame)
            places.append((at, len(frame)))
            at += len(frame)
    return name, places


def read_archive(source) -> Iterator[bytes]:
    """The records of an open archive, in order."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    raw = source.read(size)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    held = b""
    while True:
        frame = reader.decompressobj()
        out = io.BytesIO()
        while not frame.eof:
            chunk = held or source.read(1 << 18)
            if not chunk:
                if out.tell():
                    raise ValueError("a record is cut short")
                return
            out.write(frame.decompress(chunk))
            held = frame.unused_data if frame.eof else b""
        yield out.getvalue()


def write(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, date: str | None = None) -> DataFrame:
    """Archive ``pages(page_id, url, html)`` in ``folder``; returns the written index
    ``(archive, position, offset, length, page_id)``.

    A null html is an empty payload, a null url an empty one. Records are settled first:
    of equal payloads (SHA-1 and size) of at least ``min_revisit`` bytes, the smallest
    ``page_id`` is the response. Rows that repeat an id are archived each, by their own
    payloads; rows that repeat id and payload of a response are responses. A page without
    an id is a revisit if a page with an id has its payload, else a response. ``date``
    is the records' WARC-Date (pages carry no time of their own; by default the time of
    this call). Further columns are ignored; an empty table gives no archives and no rows."""
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = base.withColumn("sha1", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html").cast("long")).withColumn("payload", unit("sha1", "size")).withColumn("own", unit("page_id", "sha1", "size"))
    rows = keyed.where(F.col("size") >= min_revisit).groupBy("own", "page_id", "payload").agg(F.count("*").alias("copies"))
    rows = written(rows.select("own", "page_id", "payload"), "payloads")
    first = written(rows.groupBy("payload").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "first-pages")
    again = written(spread_join(rows, first, "payload").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("own", "first"), "revisits")
    settled = keyed.join(again, "own", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []

        def out() -> pa.RecordBatch:
            name, places = write_archive(folder, [x for _, x in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(held)), pa.array(range(len(held)), pa.int64()), pa.array([x for x, _ in places], pa.int64()), pa.array([x for _, x in places], pa.int64()), pa.array([x for x, _ in held], pa.int64())],
                names=["archive", "position", "offset", "length", "page_id"],
            )

        size = 0
        for batch in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode("utf-8")
                held.append((page_id, record(page_id, url, payload, digest(payload), refers, date)))
                size += len(held[-1][1])
                if size > ARCHIVE_BYTES:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    return written(settled.select("page_id", "url", "html", "first").mapInArrow(run, "archive string, position long, offset long, length long, page_id long"), "warc-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """What the archives that ``index`` names hold, one row per record: ``page_id,
    payload_bytes, payload_digest, record_type, refers_to``. Bodies are checked against
    their digests and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with files.read(folder, name) as source:
                    for raw in read_archive(source):
                        fields, body = parse(raw)
                        sha1 = fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-type"] == "response" and (digest(body) != sha1 or len(body) != int(fields["warc-payload-length"])):
                            raise ValueError(f"a payload in {name} differs from its digest")
                        rows.append((_page(fields["warc-record-id"]), int(fields["warc-payload-length"]), sha1, fields["warc-type"], _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    archives = written(index.select("archive").distinct(), "archives")
    # an archive is a large piece of work behind a small row: one partition each
    archives = archives.repartition(max(1, min(archives.count(), 100_000)), "archive")
    return archives.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read them back."""
    folder = new_path(pages.sparkSession, "warc")
    return read(write(pages, folder), folder)
