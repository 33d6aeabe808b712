"""Conversations, citations and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import chat
from .registry import Tables, query


def _join(col: str):
    return F.array_join(F.transform(col, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")


@query(
    "cht1_history",
    """select id, coalesce(string_agg(x, '|') over (partition by user_id, conversation_id order by created_at, id rows between 9 preceding and 1 preceding), '') as history,
       coalesce(string_agg(x, '|') over (partition by user_id, conversation_id order by created_at, id rows between 4 preceding and 1 preceding), '') as recent from (select *, concat(role, ':', content) as x from m_messages) y""",
)
def history(t: Tables):
    rows = chat.history(t.m_messages)
    return rows.withColumn("recent", chat.last_turns(F.col("history"), 4)).select("id", _join("history").alias("history"), _join("recent").alias("recent"))


_SCORE = "case when ordinal % 3 = 1 then ordinal / 10.0::double end"


def _hits(t: Tables):
    score = F.when(F.col("ordinal") % 3 == 1, F.col("ordinal") / 10.0)
    return t.g_chunks.select("user_id", F.col("document_id").alias("query_id"), "chunk_id", "document_id", "content", "hierarchy_path", F.col("ordinal").alias("rank"), score.alias("relevance_score"))


_BAND = f"case when {_SCORE} is null then 'medium' when {_SCORE} > 1 then 'medium' when {_SCORE} >= 0.7 then 'high' when {_SCORE} >= 0.4 then 'medium' else 'low' end"


@query("cht2_citation_context", f"""select document_id as query_id, string_agg(concat('[Context ', ordinal, '] (from: Order ', document_id, ')', case when {_SCORE} is null then '' else concat(' (relevance: ', {_BAND}, ')') end, chr(10), content), chr(10) || chr(10) order by ordinal) as context from g_chunks where ordinal <= 8 group by 1""")
def citation_context(t: Tables):
    return chat.citations(_hits(t), t.g_documents)[1].select("query_id", "context")


@query("cht2_citation_sources", f"select chunk_id, document_id, concat('Order ', document_id) as title, content, ordinal as number, replace(hierarchy_path, ',', '/') as path, false as truncated, {_SCORE} as relevance_score, {_BAND} as quality from g_chunks where ordinal <= 8")
def citation_sources(t: Tables):
    return chat.citations(_hits(t), t.g_documents)[0].select("chunk_id", "document_id", "title", "content", "number", F.array_join("path", "/").alias("path"), "truncated", "relevance_score", "quality")


@query("cht3_quality", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when l_discount * 12 > 1 then 'medium' when l_discount * 12 >= 0.7 then 'high' when l_discount * 12 >= 0.4 then 'medium' else 'low' end as quality from lineitem")
def quality(t: Tables):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", text.quality(F.col("l_discount") * 12).alias("quality"))


@query(
    "cht4_citation_coverage",
    """select id, round(least(1.0, len(list_filter(list_distinct(list_transform(regexp_extract_all(content, '\\[([0-9]+)\\]', 1), lambda x: try_cast(x as int))), lambda x: x between 1 and 3)) / 3.0), 6)::double as coverage from m_messages""",
)
def citation_coverage(t: Tables):
    return t.m_messages.select("id", F.round(text.citation_coverage(F.col("content"), F.lit(3)), 6).alias("coverage"))


_FACTS = """r as (select user_id, source as query_id, row_number() over (partition by user_id, source order by target, relation_type) as position, source, relation_type, target from g_relations),
  f as (select user_id, query_id, string_agg(concat('(', source, ') -[', relation_type, ']-> (', target, ')'), ' ; ' order by position) as facts, list(target) as shown from r where position <= 15 group by 1, 2),
  facts as (select e.user_id, e.name as query_id, case when f.facts is null then concat('Related Entities: ', e.name, ', lonely') else concat('Related Knowledge Graph Facts: ', f.facts, chr(10), chr(10), 'Related Entities: lonely') end as facts from g_entities e left join f on f.user_id = e.user_id and f.query_id = e.name)"""


def _facts(t: Tables):
    from ..operators.ranking import ranked

    relations = ranked(t.g_relations, ["user_id", "source"], ["target", "relation_type"], "position").withColumn("query_id", F.col("source"))
    names = t.g_entities.select("user_id", F.col("name").alias("query_id"), F.posexplode(F.array("name", F.lit("lonely"))).alias("position", "name"))
    return chat.graph_facts(relations, names)


@query("cht5_graph_facts", f"with {_FACTS} select user_id, query_id, facts from facts")
def graph_facts(t: Tables):
    return _facts(t)


@query(
    "cht6_prompts",
    f"with {_FACTS} select user_id, query_id, concat('C: about ', query_id, chr(10), chr(10), facts, ' :C', chr(10), chr(10), 'Cite.') as prompt from facts",
)
def prompts(t: Tables):
    facts = _facts(t)
    contexts = facts.select("user_id", "query_id", F.concat(F.lit("about "), "query_id").alias("context"), F.lit(False).alias("compare"))
    return chat.prompts(contexts, facts, "Cite.", "C: {context}{facts} :C{citations}{comparison}")


@query("cht7_sources", "select id as message_id, conversation_id as chunk_id, turn::bigint as rank from m_messages")
def sources(t: Tables):
    rows = t.m_messages.select(F.col("id").alias("message_id"), F.col("conversation_id").alias("chunk_id"), F.explode(F.array(F.col("turn"), F.col("turn") + 5)).alias("rank"))
    return chat.message_sources(rows)


@query("cht7_feedback", "select id as message_id, case when turn % 2 = 0 then 'down' else 'up' end as rating from m_messages")
def feedback(t: Tables):
    even = F.col("turn") % 2 == 0
    rows = t.m_messages.select(F.col("id").alias("message_id"), "user_id", "created_at", F.posexplode(F.array(F.lit("up"), F.when(even, "down").otherwise("up"), F.lit("meh"))).alias("k", "rating"))
    rows = rows.withColumn("created_at", F.col("created_at") + F.make_dt_interval(mins=F.col("k")))
    rows = rows.unionByName(rows.withColumn("user_id", F.col("user_id") + 1)).drop("k")
    return chat.message_feedback(rows, t.m_messages).select("message_id", "rating")


@query(
    "cht8_delete_conversations",
    """with x as (select * from m_messages where conversation_id not like '%1') select distinct 'conversation' as what, null as id, conversation_id as key from x union all select 'message', id, conversation_id from x
       union all select 'source', id, concat('c', id) from x union all select 'feedback', id, 'up' from x where role = 'assistant'""",
)
def delete_conversations(t: Tables):
    """What is left of conversations, messages, sources and feedback; the deletions of others are ignored."""
    messages = t.m_messages
    conversations = messages.select("user_id", "conversation_id").distinct()
    ids = conversations.where("conversation_id like '%1'").unionByName(conversations.select((F.col("user_id") + 1).alias("user_id"), "conversation_id"))
    sources = messages.select(F.col("id").alias("message_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"))
    feedback = messages.where("role = 'assistant'").select(F.col("id").alias("message_id"), F.lit("up").alias("rating"))
    out = chat.delete_conversations(ids, conversations, messages, sources, feedback)
    rows = lambda what, df, i, key: df.select(F.lit(what).alias("what"), i.cast("long").alias("id"), F.col(key).alias("key"))
    left = rows("conversation", out["conversations"], F.lit(None), "conversation_id").unionByName(rows("message", out["messages"], F.col("id"), "conversation_id"))
    return left.unionByName(rows("source", out["sources"], F.col("message_id"), "chunk_id")).unionByName(rows("feedback", out["feedback"], F.col("message_id"), "rating"))
