"""Lifecycle jobs, in batch and as streams over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import lifecycle
from ..sources import scratch
from ..streaming import ingest, jobs
from .registry import Tables, query
from .text_queries import split_sql


def _failing(events):
    return events.select("doc_id", "id", "ts", "status", F.when(F.col("status") == "failed", F.lit("boom")).alias("error_message"))


def _stream(t: Tables):
    """The events as a stream with the columns of ``p_progress``."""
    schema = t.events.schema
    raw = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events.parque[t]")
    status = F.expr("case event_type when 'view' then 'document_created' when 'click' then 'indexed' when 'purchase' then 'graphed' when 'signup' then 'ready' else 'failed' end")
    return raw.select(F.col("event_id").alias("id"), F.col("user_id").alias("doc_id"), status.alias("status"), "event_type", "ts", "value")


def _shuffled(events, name: str, batches: int = 4, by: str = "id"):
    """``events`` as a stream of several micro-batches, in which each has events of all times."""
    spark = events.sparkSession
    files = max(2 * batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = scratch.new_path(spark, name)
    events.repartition(files, F.xxhash64(*[x for x in (by, "version") if x in events.columns])).write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(path)


#: Events of the table are out of order by less than this, however they are shuffled.
_DELAY = "40 days"
_RANK = "case status when 'document_created' then 1 when 'indexed' then 2 when 'graphed' then 3 when 'ready' then 4 else 0 end"
_FOLD = """select doc_id, coalesce(arg_min(case when status in ('ready', 'failed') then status end, case when status in ('ready', 'failed') then (ts, id) end),
  arg_max(status, case status when 'document_created' then 1 when 'indexed' then 2 when 'graphed' then 3 else 0 end)) as status from p_progress group by 1"""
_WHOLE_FOLD = f"""with e as (select *, {_RANK} as rank, first_value(case when status in ('ready', 'failed') then status end ignore nulls) over w as ended, max({_RANK}) over w as best from p_progress window w as (partition by doc_id order by ts, id rows between unbounded preceding and 1 preceding)),
  x as (select *, case when ended is not null then case when status = ended then 'no-op' else 'rejected' end when status = 'failed' or rank > coalesce(best, 0) then 'applied' else 'no-op' end as what from e)
  select doc_id, coalesce(arg_min(case when status in ('ready', 'failed') then status end, case when status in ('ready', 'failed') then (ts, id) end), arg_max(status, rank)) as status,
    case when arg_min(case when status in ('ready', 'failed') then status end, case when status in ('ready', 'failed') then (ts, id) end) = 'failed' then 'boom' end as error_message,
    count(case when what = 'applied' then 1 end) as applied, count(case when what = 'rejected' then 1 end) as rejected from x group by 1"""


@query("str1_fold_status", _WHOLE_FOLD)
def fold_status(t: Tables):
    return lifecycle.fold_status(_failing(t.p_progress))


@query("str1_fold_by_aggregation", _FOLD)
def fold_by_aggregation(t: Tables):
    return lifecycle.fold_status_without_resets(t.p_progress)


@query("str1_fold_status_stream", _WHOLE_FOLD)
def fold_status_stream(t: Tables):
    events = _shuffled(_failing(t.p_progress), "events")
    return jobs.run_once(jobs.fold_status_stream(events, _DELAY), scratch.new_path(t.spark, "fold"), "update", "doc_id")


_NOW = "timestamp '2024-01-31 00:00:00'"


@query(
    "str2_reconcile",
    f"""with l as (select doc_id, max(ts) as last_event from p_progress group by 1), d as (select distinct user_id as id, case user_id % 4 when 0 then 'ready' when 1 then 'indexed' when 2 then null else 'failed' end as status from events)
        select id, case when s then 'failed' else status end as status, s as reconciled from (select id, coalesce(status, 'pending') as status, coalesce(status, 'pending') not in ('ready', 'failed') and (last_event is null or last_event < {_NOW} - interval 30 minutes) as s from d left join l on l.doc_id = d.id) x""",
)
def reconcile(t: Tables):
    return lifecycle.reconcile(_known(t), t.p_progress, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).drop("error_message")


def _known(t: Tables):
    return t.events.select(F.col("user_id").alias("id")).distinct().withColumn("status", F.expr("case id % 4 when 0 then 'ready' when 1 then 'indexed' when 2 then null else 'failed' end")).withColumn("error_message", F.lit(None).cast("string"))


@query(
    "str2_reconcile_stream",
    f"""with l as (select doc_id, max(ts) as last_event from p_progress where ts <= {_NOW} group by 1), d as (select distinct user_id as id, case user_id % 4 when 0 then 'ready' when 1 then 'indexed' when 2 then null else 'failed' end as status from events)
        select id, case when s then 'failed' else status end as status, case when s then '{lifecycle.STALE}' end as error_message, s as reconciled from (select id, coalesce(status, 'pending') as status, coalesce(status, 'pending') not in ('ready', 'failed') and (last_event is null or last_event < {_NOW} - interval 30 minutes) as s from d left join l on l.doc_id = d.id) x""",
)
def reconcile_stream(t: Tables):
    """Events up to now in shuffled batches, then the sweep's own time as the last row."""
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    path = scratch.new_path(t.spark, "clock")
    seen = t.p_progress.select("id", "doc_id", F.col("ts").cast("timestamp").alias("ts")).where(F.col("ts") <= now)
    files = max(8, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    seen.repartition(files, F.xxhash64("id")).write.parquet(f"{path}/a")
    t.spark.range(1).select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("doc_id"), (now + F.expr("interval 40 days")).alias("ts")).coalesce(1).write.parquet(f"{path}/b")
    # files are taken as they were written
    stream = t.spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(f"{path}/*")
    swept = jobs.run_once(jobs.reconcile_stream(_known(t), stream, 30, _DELAY), scratch.new_path(t.spark, "sweep"), "update", "id")
    kept = _known(t).join(swept, "id", "left_anti").select("id", F.coalesce("status", F.lit("pending")).alias("status"), "error_message", F.lit(False).alias("reconciled"))
    return kept.unionByName(swept)


def _rows(events):
    stage = F.expr("case event_type when 'signup' then 'complete' when 'error' then 'error' else 'working' end")
    return events.select("id", "doc_id", stage.alias("stage"), F.when(F.col("event_type") != "view", F.floor("value").cast("int")).alias("percent"), F.lit("m").alias("message"))


@query(
    "str3_progress",
    """with p as (select *, case event_type when 'signup' then 'complete' when 'error' then 'error' else 'working' end as stage, case when event_type = 'view' then 0 else floor(value)::int end as percent from p_progress),
       e as (select doc_id, min(id) as e from p where stage in ('complete', 'error') group by 1), r as (select p.*, row_number() over (partition by p.doc_id order by id desc) as k from p left join e on e.doc_id = p.doc_id where e is null or id <= e)
       select doc_id, id, stage, percent::bigint as percent from r where k = 1""",
)
def progress(t: Tables):
    return lifecycle.latest_progress(_rows(t.p_progress)).select("doc_id", "id", "stage", F.col("percent").cast("long").alias("percent"))


@query("str3_latest_progress_stream", "select doc_id, max(id) as id from p_progress group by 1")
def latest_progress_stream(t: Tables):
    return jobs.run_once(jobs.latest_progress_stream(_rows(_stream(t))), scratch.new_path(t.spark, "progress"), "update", "doc_id").select("doc_id", "id")


_THROTTLED = """with recursive n as (select key, id, t, row_number() over (partition by key order by t, id) as k from r_requests),
  r(key, k, live, id, t, allowed, retry_after) as (select distinct key, 0::bigint, []::double[], null::bigint, null::double, true, 0::bigint from n union all
    select key, k, case when len(l) < 3 then list_append(l, t) else l end, id, t, len(l) < 3, case when len(l) < 3 then 0 else greatest(1, floor(86400 - (t - l[1]))::bigint + 1) end
    from (select n.key, n.k, n.id, n.t, list_filter(r.live, lambda x: x > n.t - 86400) as l from r join n on n.key = r.key and n.k = r.k + 1) x)
  select key, id, t, allowed, retry_after from r where k > 0"""


@query("str4_throttle", _THROTTLED)
def throttle(t: Tables):
    return lifecycle.throttle(t.r_requests, 3, 86_400)


@query("str4_throttle_stream", _THROTTLED)
def throttle_stream(t: Tables):
    requests = _shuffled(t.r_requests, "requests")
    return jobs.run_once(jobs.throttle_stream(requests, 3, 86_400, _DELAY), scratch.new_path(t.spark, "throttle"), "update", ["key", "id"])


_INGESTED = rf"""with recursive d as (select id as document_id, user_id, concat('doc ', id, '.md') as title, trim(replace(regexp_replace(case when doc_id % 11 = 5 then '  ' else coalesce(content, '') end, '\n{{3,}}', chr(10) || chr(10), 'g'), chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(13)) as content from t_documents),
  src as (select document_id as id, content from d where content <> ''), {split_sql("src", "length(content) > 500")},
  c as (select id, unnest(range(len(parts))) as part, length(unnest(parts)) as size from f),
  z as (select id, count(*) as chunks, sum(size)::bigint + sum(case when part > 0 then least(before, {vocab.OVERLAP_CHARS}) else 0 end)::bigint as characters from (select *, lag(size) over (partition by id order by part) as before from c) x group by 1)
  select user_id, document_id, case when z.id is null then 'failed' else 'ready' end as status, case when z.id is null then 'blank' end as error_message, case when z.id is not null then title end as title, coalesce(chunks, 0) as chunks, coalesce(characters, 0) as characters, coalesce(chunks, 0) as vectors from d left join z on z.id = d.document_id"""


@query("str5_ingest_stream", _INGESTED)
def ingest_stream(t: Tables):
    """Documents in an older and a newer version, some of them broken by it, in any order."""
    new = t.t_documents.select("user_id", F.col("id").alias("document_id"), F.lit(2).cast("long").alias("version"), F.concat(F.lit("doc "), "id", F.lit(".md")).alias("original_filename"), F.when(F.col("doc_id") % 11 == 5, F.lit("  ")).otherwise(F.col("content")).alias("content"))
    old = new.where(F.xxhash64("document_id") % 3 == 0).withColumn("version", F.lit(1).cast("long")).withColumn("content", F.concat(F.lit("An older text.\n\n"), F.coalesce("content", F.lit(""))))
    docs = _shuffled(new.unionByName(old), "documents", 2, "document_id")
    path = scratch.new_path(t.spark, "ingest")
    store = ingest.target(t.spark, f"{path}/tables", buckets=16)
    ingest.ingest_stream(docs, store, f"{path}/state").awaitTermination()
    per = lambda name, *what: store.read(name).groupBy("user_id", "document_id").agg(*what)
    found = store.read("documents").join(per("chunks", F.count("*").alias("chunks"), F.sum(F.length("content")).alias("characters")), ["user_id", "document_id"], "left").join(per("vectors", F.count("embedding").alias("vectors")), ["user_id", "document_id"], "left")
    return found.fillna(0, ["chunks", "characters", "vectors"]).select("user_id", "document_id", "status", "error_message", "title", "chunks", "characters", "vectors")


@query("str6_upload_volume", "select user_id, <day:ts> as day, count(*) as documents from events group by 1, 2")
def upload_volume(t: Tables):
    rows = t.events.select("user_id", F.col("ts").cast("timestamp").alias("created_at"))
    found = rows.groupBy("user_id", F.window("created_at", "1 day").alias("w")).agg(F.count("*").alias("documents"))
    return found.select("user_id", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "documents")


@query("str6_upload_volume_stream", "select user_id, <day:ts> as day, count(*) as documents from events group by 1, 2")
def upload_volume_stream(t: Tables):
    rows = _stream(t).select(F.col("doc_id").alias("user_id"), F.col("ts").cast("timestamp").alias("created_at"))
    found = jobs.run_once(jobs.upload_volume(rows), scratch.new_path(t.spark, "volume"), "update", ["user_id", "window_start"])
    return found.select("user_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "documents")
