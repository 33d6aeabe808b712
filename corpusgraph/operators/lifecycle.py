"""Document status, stuck documents, progress and throttling, in batch."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from .ranking import latest

STALE = "Reconciled: stuck in non-terminal state"
STATE = "status string, error_message string, applied long, rejected long"


def step(status: str, error: str | None, target: str, message: str | None) -> tuple[str, str | None, str]:
    """The status and error after one event, and what became of it: applied, no-op or
    rejected. ``pending`` from ``failed`` is a reset; nothing else leaves a terminal state."""
    if target == status:
        return status, error, "no-op"
    if status == vocab.FAILED:
        return ("pending", None, "applied") if target == "pending" else (status, error, "rejected")
    if status == "ready":
        return status, error, "rejected"
    if target == vocab.FAILED:
        return vocab.FAILED, message, "applied"
    if target not in vocab.STATUS_RANK:
        return status, error, "rejected"
    if vocab.STATUS_RANK[target] <= vocab.STATUS_RANK[status]:
        return status, error, "no-op"
    return target, None, "applied"


def fold(events: Iterable[tuple[str, str | None]], status: str = "pending", error: str | None = None, applied: int = 0, rejected: int = 0) -> tuple[str, str | None, int, int]:
    for target, message in events:
        status, error, what = step(status, error, target, message)
        applied, rejected = applied + (what == "applied"), rejected + (what == "rejected")
    return status, error, applied, rejected


def fold_status(events: DataFrame) -> DataFrame:
    """``(doc_id, status, error_message, applied, rejected)`` of ``events(doc_id, id, ts,
    status, error_message)``, folded in the order of (ts, id; null last) from ``pending``. The
    order makes this sequential: one document's events meet in one task, where only the state
    is carried from batch to batch, however many they are."""
    kind = events.schema["doc_id"].dataType.simpleString()
    ordered = events.select("doc_id", "id", "ts", "status", "error_message").repartition("doc_id").sortWithinPartitions("doc_id", F.asc_nulls_last("ts"), F.asc_nulls_last("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, types = None, None, None

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(types)], names=["doc_id", "status", "error_message", "applied", "rejected"])

        for batch in batches:
            types = [batch.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64()]
            found = []
            for doc, target, message in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if state is None or doc != held:
                    if state is not None:
                        found.append((held, *state))
                    held, state = doc, ("pending", None, 0, 0)
                state = fold([(target, message)], *state)
            yield rows(found)
        if state is not None:
            yield rows([(held, *state)])

    return ordered.mapInArrow(run, f"doc_id {kind}, {STATE}")


def fold_status_without_resets(events: DataFrame) -> DataFrame:
    """The same status where no event is ``pending``, by aggregation alone: the first
    terminal event in time, else the highest rank."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in vocab.STATUS_RANK.items() for x in kv]), F.col("status")), F.lit(0))
    terminal = F.col("status").isin(*vocab.TERMINAL)
    return events.groupBy("doc_id").agg(F.coalesce(F.min_by(F.when(terminal, F.col("status")), F.when(terminal, F.struct("ts", "id"))), F.max_by("status", rank)).alias("status"))


def reconcile(documents: DataFrame, progress: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """``documents(id, status, error_message)`` with those that are in no terminal state and
    whose last event is missing or older than ``minutes`` before ``now`` set to failed."""
    last = progress.groupBy(F.col("doc_id").alias("id")).agg(F.max("ts").alias("last_event"))
    joined = documents.join(last, "id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    stuck = ~F.col("status").isin(*vocab.TERMINAL) & (F.col("last_event").isNull() | (F.col("last_event") < now - F.make_dt_interval(mins=F.lit(minutes))))
    return joined.select("id", F.when(stuck, vocab.FAILED).otherwise(F.col("status")).alias("status"), F.when(stuck, STALE).otherwise(F.col("error_message")).alias("error_message"), stuck.alias("reconciled"))


def progress_rows(events: DataFrame) -> DataFrame:
    """``events(id, doc_id, stage, percent, message)`` with defaults and flags."""
    done, failed = F.col("stage") == "complete", F.col("stage") == "error"
    return events.withColumn("percent", F.coalesce("percent", F.lit(0))).withColumn("is_complete", done.cast("int")).withColumn("is_error", failed.cast("int")).withColumn("error_message", F.when(failed, F.col("message")))


def latest_progress(events: DataFrame) -> DataFrame:
    """The last row of each document up to its first complete or error row."""
    rows = progress_rows(events)
    end = rows.where("is_complete = 1 or is_error = 1").groupBy("doc_id").agg(F.min("id").alias("end"))
    return latest(rows.join(end, "doc_id", "left").where("end is null or id <= end"), ["doc_id"], [F.desc("id")]).drop("end")


def admit(times: Iterable[float], live: list[float], most: int, window: float) -> tuple[list[tuple[bool, int]], list[float]]:
    """Sliding-window admission of requests in time order: flags with the seconds to wait
    (0 if allowed), and the hits that are still live. Denied requests don't count."""
    out = []
    for t in times:
        live = [x for x in live if x > t - window]
        if len(live) < most:
            live.append(t)
            out.append((True, 0))
        else:
            out.append((False, max(1, int(window - (t - live[0])) + 1)))
    return out, live


def throttle(requests: DataFrame, most: int, window: float) -> DataFrame:
    """``requests(key, id, t)`` with ``allowed`` and ``retry_after``, replayed per key in the
    order of (t, id; null last). A key's live hits, ``most`` at most, are carried from batch to
    batch."""
    kind = f"key {requests.schema['key'].dataType.simpleString()}, id {requests.schema['id'].dataType.simpleString()}, t double"
    ordered = requests.select("key", "id", F.col("t").cast("double").alias("t")).repartition("key").sortWithinPartitions("key", F.asc_nulls_last("t"), F.asc_nulls_last("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, live = None, None
        for batch in batches:
            flags = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if live is None or key != held:
                    held, live = key, []
                one, live = admit([math.nan if t is None else t], live, most, window)
                flags += one
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in flags], pa.bool_()), pa.array([r for _, r in flags], pa.int64())], names=["key", "id", "t", "allowed", "retry_after"])

    return ordered.mapInArrow(run, f"{kind}, allowed boolean, retry_after long")
