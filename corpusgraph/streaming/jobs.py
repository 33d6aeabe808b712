"""The lifecycle jobs as Structured Streaming."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions import vocab
from ..operators.lifecycle import STALE, STATE, admit, fold


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_TIME = 1 << 62  # rows without a time come last and never become final


def _at(row: Row) -> int:
    return NO_TIME if row["at"] is None else row["at"]


class Ordered(StatefulProcessor):
    """The rows of a key in the order of (time, id), in whatever order they arrive.

    ``done`` is what the rows before the watermark have come to, for good; those that it hasn't passed
    wait in a list. When rows arrive, those that have become final are folded into ``done`` and the
    waiting ones replayed on top, so each result holds for all that has arrived. ``keep`` after the last
    time of a key a timer ends its state."""

    value: str
    row: str
    start: tuple

    def __init__(self, keep: float):
        self.keep = int(keep * 1000)

    def pack(self, row: Row) -> tuple:
        """``(time in microseconds, id, ...)`` of an input row."""
        raise NotImplementedError

    def replay(self, value: tuple, rows: list[tuple]) -> tuple[tuple, list]:
        """The value after ``rows``, and the results on the way."""
        raise NotImplementedError

    def results(self, key: tuple, value: tuple, on_the_way: list) -> Iterator[Row]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", f"end long, {self.value}")
        self.waiting = handle.getListState("waiting", self.row)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.done.get() if self.done.exists() else None
        end, value = (held[0], tuple(held[1:])) if held else (0, self.start)
        waiting = sorted([*map(tuple, self.waiting.get() if held else ()), *map(self.pack, rows)], key=lambda x: (x[0], x[1] is None, x[1]))
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        final = next((k for k, x in enumerate(waiting) if x[0] >= mark), len(waiting))
        value, first = self.replay(value, waiting[:final])
        now, rest = self.replay(value, waiting[final:])
        last = max((x[0] for x in waiting if x[0] != NO_TIME), default=0) // 1000
        if last > end:
            if end:
                self.handle.deleteTimer(end + self.keep)
            self.handle.registerTimer(last + self.keep)
            end = last
        self.done.update((end, *value))
        self.waiting.put(waiting[final:]) if waiting[final:] else self.waiting.clear()
        yield from self.results(key, now, first + rest)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.done.clear()
        self.waiting.clear()
        yield from ()

    def close(self) -> None:
        pass


class StatusFold(Ordered):
    value, start = STATE, ("pending", None, 0, 0)
    row = "at long, id long, status string, error_message string"

    def pack(self, row: Row) -> tuple:
        return _at(row), row["id"], row["status"], row["error_message"]

    def replay(self, value: tuple, rows: list[tuple]) -> tuple[tuple, list]:
        return fold([x[2:] for x in rows], *value), []

    def results(self, key: tuple, value: tuple, on_the_way: list) -> Iterator[Row]:
        yield Row(doc_id=key[0], status=value[0], error_message=value[1], applied=value[2], rejected=value[3])


class Throttle(Ordered):
    value, start = "live array<double>", ([],)
    row = "at long, id long, t double"

    def __init__(self, most: int, window: float):
        super().__init__(window)
        self.most, self.window = most, window

    def pack(self, row: Row) -> tuple:
        return _at(row), row["id"], row["t"]

    def replay(self, value: tuple, rows: list[tuple]) -> tuple[tuple, list]:
        flags, live = admit([math.nan if x[2] is None else x[2] for x in rows], list(value[0]), self.most, self.window)
        return (live,), [(*x[1:], *f) for x, f in zip(rows, flags, strict=True)]

    def results(self, key: tuple, value: tuple, on_the_way: list) -> Iterator[Row]:
        for i, t, allowed, wait in on_the_way:
            yield Row(key=key[0], id=i, t=t, allowed=allowed, retry_after=wait)


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    """``rows`` with ``at``, the microseconds of ``ts``, and a watermark on ``clock``: the same time, but after the
    epoch, since a stream's first watermark is the epoch and would make what isn't later late."""
    clock = F.when(F.col("ts").isNotNull(), F.greatest("ts", F.timestamp_millis(F.lit(1))))
    return rows.withColumn("at", F.unix_micros("ts")).withColumn("clock", clock).withWatermark("clock", delay)


def fold_status_stream(events: DataFrame, delay: str = "1 hour", keep_days: float = 30) -> DataFrame:
    """``fold_status`` over a stream, in update mode: each row is the fold of all events that have arrived
    for a document, in the order of (ts, id). Events may be late and out of order by ``delay``; later ones are
    dropped. A document's state ends ``keep_days`` after its last event. Needs the RocksDB state
    store (``run_once`` sets it)."""
    kind = events.schema["doc_id"].dataType.simpleString()
    rows = events.select("doc_id", F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "status", "error_message")
    return _timed(rows, delay).groupBy("doc_id").transformWithState(StatusFold(keep_days * 86_400), f"doc_id {kind}, {STATE}", "update", "eventTime")


def throttle_stream(requests: DataFrame, most: int, window: float, delay: str = "1 hour") -> DataFrame:
    """``throttle`` over a stream, in update mode by (key, id): a request's decision comes at once and again,
    until the watermark has passed it, whenever another of its key arrives. A key's state are ``most`` times and the
    requests within ``delay``; it ends ``window`` after the last one. A request without a time is allowed."""
    kind = requests.schema["key"].dataType.simpleString()
    rows = requests.select("key", F.col("id").cast("long").alias("id"), F.col("t").cast("double").alias("t"))
    rows = rows.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    return _timed(rows, delay).groupBy("key").transformWithState(Throttle(most, window), f"key {kind}, id long, t double, allowed boolean, retry_after long", "update", "eventTime")


class Silence(StatefulProcessor):
    """Documents whose last event is ``minutes`` old, told by timers: no event arrives then."""

    def __init__(self, minutes: float):
        self.gap = int(minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.doc = handle.getValueState("doc", "status string, error_message string, due long, failed boolean")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        status = initialState["status"] or "pending"
        if status not in vocab.TERMINAL:  # without an event it is due at once
            self.doc.update((status, initialState["error_message"], 1, False))
            self.handle.registerTimer(1)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        if not self.doc.exists():
            return
        status, error, due, failed = self.doc.get()
        last = max((r["at"] for r in rows if r["at"] is not None), default=0)
        later = last // 1000 + self.gap + 1 if last else 0  # the first millisecond at which the gap is over
        if later <= due:
            return
        self.handle.deleteTimer(due)
        self.handle.registerTimer(later)
        over = later <= timerValues.getCurrentWatermarkInMs()  # even so it has been silent for too long
        self.doc.update((status, error, later, failed and over))
        if failed and not over:  # it lives
            yield Row(id=key[0], status=status, error_message=error, reconciled=False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        status, error, due, failed = self.doc.get()
        if expiredTimerInfo.getExpiryTimeInMs() == due and not failed:
            self.doc.update((status, error, due, True))
            yield Row(id=key[0], status=vocab.FAILED, error_message=STALE, reconciled=True)

    def close(self) -> None:
        pass


def reconcile_stream(documents: DataFrame, progress: DataFrame, minutes: float = 30, delay: str = "1 hour") -> DataFrame:
    """``reconcile`` as events flow: ``documents(id, status, error_message)`` is what is known at the start,
    ``progress(doc_id, ts)`` the stream. In update mode, ``(id, status, error_message, reconciled)`` comes
    when the watermark is more than ``minutes`` after a document's last event (at once, where there is
    none) and it is in no terminal state; and again, as it was, if an event arrives after all. The clock
    is the watermark: where events may pause, feed it rows without a document."""
    kind = documents.schema["id"].dataType.simpleString()
    known = documents.select(F.col("id").alias("doc_id"), "status", "error_message").groupBy("doc_id")
    rows = progress.select("doc_id", F.col("ts").cast("timestamp").alias("ts"))
    return _timed(rows, delay).groupBy("doc_id").transformWithState(Silence(minutes), f"id {kind}, status string, error_message string, reconciled boolean", "update", "eventTime", initialState=known)


def upload_volume(documents: DataFrame, length: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Documents per user and event-time window (tumbling, or sliding with ``slide``); rows
    later than the watermark are dropped."""
    window = F.window("created_at", length, slide) if slide else F.window("created_at", length)
    return documents.withWatermark("created_at", delay).groupBy("user_id", window.alias("w")).agg(F.count("*").alias("documents")).select("user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "documents")


def latest_progress_stream(events: DataFrame) -> DataFrame:
    """The newest progress row of each document, in update mode."""
    return events.groupBy("doc_id").agg(F.max_by(F.struct("stage", "percent", "message"), "id").alias("row"), F.max("id").alias("id")).select("doc_id", "id", "row.*")


def run_once(stream: DataFrame, path: str, mode: str = "append", upsert_key: str | list[str] | None = None) -> DataFrame:
    """Run ``stream`` over all that is there and return the sink's rows. In update mode the
    last row of each ``upsert_key`` (by batch) stays."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/n={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    writer.foreachBatch(put).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/out")
    if upsert_key:
        keys = [upsert_key] if isinstance(upsert_key, str) else upsert_key
        rows = rows.withColumn("last", F.max("batch").over(Window.partitionBy(*keys))).where("batch = last")
    return rows.select(*stream.columns)
