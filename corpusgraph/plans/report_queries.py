"""Dashboards, timelines, tags and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from .graph_queries import RELATED_SQL, TOP_SQL
from .registry import Tables, query


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("rep1_documents_by_month", "select user_id, substring(<day:created_at>, 1, 7) as month, count(*) as documents from g_documents group by 1, 2")
def documents_by_month(t: Tables):
    return reports.documents_by_month(t.g_documents)


@query("rep2_recent_documents", "select user_id, id, <ts:created_at> as created_at, rank from (select *, row_number() over (partition by user_id order by created_at desc, id) as rank from g_documents) x where rank <= 10")
def recent_documents(t: Tables):
    return reports.recent_documents(t.g_documents).select("user_id", "id", _stamp("created_at"), "rank")


_TIMELINE = """c as (select user_id, entity_name as name, count(*) as mention_count from g_mentions group by 1, 2), h as (select e.user_id, e.name, e.type, mention_count, row_number() over (partition by e.user_id order by mention_count desc, e.name) as k from g_entities e join c on c.user_id = e.user_id and c.name = e.name),
  live as (select id, created_at, title from g_documents where file_type <> 'F'), f as (select user_id, entity_name as name, count(distinct document_id) as doc_count, min(created_at) as first_seen, arg_min(document_id, (created_at, document_id)) as first_document from g_mentions join live on id = document_id group by 1, 2),
  tl as (select h.user_id, h.name, h.type, mention_count, coalesce(doc_count, 0) as doc_count, first_seen, first_document from h left join f on f.user_id = h.user_id and f.name = h.name where k <= 500), ranked as (select *, row_number() over (partition by user_id order by first_seen desc nulls last, mention_count desc, name) as rank from tl)"""


def _timeline(t: Tables):
    return reports.entity_timeline(t.g_entities, t.g_mentions, t.g_documents.where("file_type <> 'F'"))


@query("rep3_entity_timeline", f"with {_TIMELINE} select user_id, name, type, mention_count, doc_count, <ts:first_seen> as first_seen, first_document, rank from ranked where rank <= 200")
def entity_timeline(t: Tables):
    return _timeline(t).select("user_id", "name", "type", "mention_count", "doc_count", _stamp("first_seen"), "first_document", "rank")


@query(
    "rep4_visible_curve",
    f"""with {_TIMELINE}, d as (select user_id, cast(first_seen as date) as day from ranked where rank <= 200 and first_seen is not null), s as (select user_id, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from d group by 1)
        select s.user_id, strftime(s.day, '%Y-%m-%d') as day, count(d.day) as visible from s join d on d.user_id = s.user_id and d.day <= s.day group by 1, s.day""",
)
def visible_curve(t: Tables):
    return reports.visible_curve(_timeline(t)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("rep4_date_range", f"with {_TIMELINE} select user_id, strftime(min(first_seen), '%Y-%m-%d') as first_day, strftime(max(first_seen), '%Y-%m-%d') as last_day, greatest(1, date_diff('day', min(cast(first_seen as date)), max(cast(first_seen as date))) + 1) as days from ranked where rank <= 200 and first_seen is not null group by 1")
def date_range(t: Tables):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return reports.date_range(_timeline(t)).select("user_id", day("first_day"), day("last_day"), "days")


def _count(table: str, name: str, what: str = "count(*)") -> str:
    return f"coalesce((select {what} from {table} x where x.user_id = u.user_id), 0) as {name}"


@query(
    "rep5_hero_counts",
    "select u.user_id, " + ", ".join((_count("g_documents", "documents"), _count("g_chunks", "chunks"), _count("g_entities", "entities"), _count("g_relations", "relations"), _count("m_messages", "messages"), _count("g_tags", "tags", "count(distinct tag)"))) + " from (select distinct n_nationkey::bigint as user_id from nation) u",
)
def hero_counts(t: Tables):
    users = t.nation.select(F.col("n_nationkey").cast("long").alias("user_id"))
    return reports.hero_counts(users, documents=t.g_documents, chunks=t.g_chunks, entities=t.g_entities, relations=t.g_relations, messages=t.m_messages, tags=t.g_tags)


_SNIPPET = "case when line = '' then '(empty message)' when length(line) > 80 then concat(substring(line, 1, 77), '...') else line end"


@query(
    "rep6_recent_activity",
    f"""with d as (select user_id, 'document' as kind, id as item_id, title, null::varchar as snippet, created_at, 0 as side, row_number() over (partition by user_id order by created_at desc, id) as k from g_documents),
        m as (select user_id, 'message' as kind, cast(id as varchar) as item_id, conversation_id as title, {_SNIPPET} as snippet, created_at, 1 as side, row_number() over (partition by user_id order by created_at desc, id desc) as k from (select *, replace(trim(content, ' ' || chr(9) || chr(10) || chr(13)), chr(10), ' ') as line from m_messages) x),
        b as (select * from d where k <= 8 union all select * from m where k <= 8), r as (select *, row_number() over (partition by user_id order by created_at desc, side, item_id) as rank from b)
        select user_id, kind, item_id, title, snippet, <ts:created_at> as created_at, rank from r where rank <= 10""",
)
def recent_activity(t: Tables):
    return reports.recent_activity(t.g_documents, t.m_messages).withColumn("created_at", _stamp("created_at"))


@query("rep7_top_entities", "with c as (select user_id, entity_name as name, count(*) as mention_count, count(distinct document_id) as document_count from g_mentions group by 1, 2), r as (select e.user_id, e.name, e.type, mention_count, document_count, row_number() over (partition by e.user_id order by mention_count desc, e.name) as rank from g_entities e join c on c.user_id = e.user_id and c.name = e.name) select * from r where rank <= 10")
def top_entities(t: Tables):
    return reports.top_entities(t.g_entities, t.g_mentions, t.g_chunks)


_CLEAN = r"clean as (select distinct user_id, document_id, lower(trim(regexp_replace(trim(tag), '^(#\s*)+', ''))) as tag from g_tags)"


@query("rep8_tag_cloud", f"with {_CLEAN}, c as (select user_id, tag, count(*) as documents from clean group by 1, 2) select *, row_number() over (partition by user_id order by documents desc, tag) as rank from c")
def tag_cloud(t: Tables):
    return reports.tag_cloud(t.g_tags)


@query(
    "rep9_monthly_growth",
    """with u as (select distinct user_id from g_documents), s as (select user_id, strftime(date '2000-06-01' - to_months(k), '%Y-%m') as month from u, (select unnest(range(6))::int as k) r),
       c as (select user_id, strftime(created_at, '%Y-%m') as month, count(*) as documents from g_documents where created_at >= timestamp '2000-06-15 12:00:00' - interval 6 months and created_at <= timestamp '2000-06-15 12:00:00' group by 1, 2)
       select s.user_id, s.month, coalesce(documents, 0) as documents from s left join c on c.user_id = s.user_id and c.month = s.month""",
)
def monthly_growth(t: Tables):
    return reports.monthly_growth(t.g_documents, t.g_documents, "2000-06-15 12:00:00")


@query("rep10_document_list", f"with {_CLEAN}, r as (select *, row_number() over (partition by user_id order by created_at desc, id) as rank from g_documents where id in (select document_id from clean where tag = 'f')) select r.user_id, id, rank, (select string_agg(tag, ',' order by tag) from clean c where c.document_id = r.id) as tags from r where rank > 5 and rank <= 25")
def document_list(t: Tables):
    return reports.document_list(t.g_documents, t.g_tags, 5, 20, "#F").select("user_id", "id", "rank", F.array_join("tags", ",").alias("tags"))


@query(
    "rep11_document_detail",
    f"""with {_CLEAN}, {RELATED_SQL}, {TOP_SQL}, p0 as (select document_id, count(*) as n, string_agg(other_id, ',' order by rank) as ids from rd where rank <= 5 group by 1),
        e as (select document_id, count(*) as n, string_agg(name, ',' order by rank) as names from y where rank <= 10 group by 1), k as (select document_id, count(*) as n, string_agg(case when ordinal <= 3 then content end, '|' order by ordinal) as x from g_chunks group by 1), t as (select document_id, string_agg(tag, ',' order by tag) as tags from clean group by 1)
        select d.user_id, d.id as document_id, tags, coalesce(k.n, 0) as chunk_count, coalesce(k.x, '') as previews, coalesce(e.n, 0) as top_entities, coalesce(e.names, '') as entities, coalesce(p0.n, 0) as related_documents, coalesce(p0.ids, '') as related from g_documents d left join k on k.document_id = d.id left join e on e.document_id = d.id left join p0 on p0.document_id = d.id left join t on t.document_id = d.id""",
)
def document_detail(t: Tables):
    found = reports.document_detail(t.g_documents, t.g_tags, t.g_chunks, t.g_entities, t.g_mentions)
    return found.select("user_id", "document_id", F.array_join("tags", ",").alias("tags"), "chunk_count", F.array_join("previews", "|").alias("previews"), "top_entities", F.array_join("entities", ",").alias("entities"), "related_documents", F.array_join("related", ",").alias("related"))


@query(
    "rep12_document_chunks",
    """select document_id, chunk_id, ordinal, replace(hierarchy_path, ',', '/') as path, content from g_chunks where document_id in (select id from g_documents where file_type <> 'P')
       union all select concat('no_', id), null, null, null, null from g_documents where file_type = 'P'""",
)
def document_chunks(t: Tables):
    """The chunks of the documents asked for; those that don't exist have a row without a chunk."""
    wanted = t.g_documents.select("user_id", F.when(F.col("file_type") == "P", F.concat(F.lit("no_"), "id")).otherwise(F.col("id")).alias("document_id"))
    rows, missing = reports.document_chunks(wanted, t.g_documents, t.g_chunks)
    found = rows.select("document_id", "chunk_id", "ordinal", F.array_join("path", "/").alias("path"), "content")
    return found.unionByName(missing.select("document_id"), allowMissingColumns=True)


@query(
    "rep13_apply_tags",
    f"""with {_CLEAN} select user_id, document_id, tag, null as reason from clean where tag <> 'f' union select user_id, id, 'new', null from g_documents
        union select user_id, id, ' # ', 'blank' from g_documents union select user_id + 1, id, 'x', 'document' from g_documents""",
)
def apply_tags(t: Tables):
    """The tags after the edits, and the additions that were rejected."""
    ids = t.g_documents.select("user_id", F.col("id").alias("document_id"))
    adds = ids.withColumn("tag", F.lit("## New")).unionByName(ids.withColumn("tag", F.lit(" # "))).unionByName(ids.withColumn("user_id", F.col("user_id") + 1).withColumn("tag", F.lit("x")))
    removes = t.g_tags.withColumn("tag", F.lit("F"))
    kept = reports.apply_tags(t.g_tags, t.g_documents, adds, removes).select("user_id", "document_id", "tag", F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(reports.rejected_tags(adds, t.g_documents))


_LISTED = """l as (select user_id, conversation_id, count(*) as messages, arg_max(content, (created_at, id)) as last_message, max(created_at) as last_activity from m_messages group by 1, 2), listed as (select *, row_number() over (partition by user_id order by last_activity desc, conversation_id) as rank from l)"""


def _listed(t: Tables):
    conversations = t.m_messages.groupBy("user_id", "conversation_id").agg(F.min("created_at").alias("created_at")).withColumn("title", F.concat(F.lit("Talk "), "conversation_id"))
    return reports.conversation_list(conversations, t.m_messages)


@query("rep14_conversation_list", f"with {_LISTED} select user_id, conversation_id, messages, last_message, <ts:last_activity> as last_activity, rank from listed")
def conversation_list(t: Tables):
    return _listed(t).select("user_id", "conversation_id", "messages", "last_message", _stamp("last_activity"), "rank")


@query("rep15_conversation_summary", f"with {_LISTED} select user_id, count(*) as conversations, sum(messages)::bigint as messages, count(case when last_activity >= timestamp '2024-01-05 00:00:00' - interval 7 days then 1 end) as active, count(case when contains(lower(concat_ws(chr(10), concat('Talk ', conversation_id), last_message)), 'the') then 1 end) as matching from listed group by 1")
def conversation_summary(t: Tables):
    return reports.conversation_summary(_listed(t), "2024-01-05 00:00:00", "the")

