"""Extraction and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vocab
from ..operators import extract, graph
from ..sources import scratch
from .registry import Tables, query

_TYPES = "('" + "','".join(vocab.ENTITY_TYPES) + "')"

# -- extraction ------------------------------------------------------------------------


def _answers(t: Tables):
    """Model answers made from the chunks: objects, arrays, prose and broken JSON in turn."""
    part = F.col("l_partkey").cast("string")
    entity = F.concat(F.lit('{"name": " '), part, F.lit('", "type": "PART"}'))
    other = F.lit('{"name": "Supplier", "type": "ORG", "description": "d"}')
    relation = F.concat(F.lit('{"source": "'), part, F.lit('", "target": "Supplier", "relation_type": "is part of"}'))
    body = F.concat(F.lit('{"entities": ['), entity, F.lit(", "), other, F.lit(', {"name": " "}], "relations": ['), relation, F.lit("]}"))
    kind = F.col("ordinal") % 4
    answer = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Sure: ["), entity, F.lit("] done"))).when(kind == 2, F.lit("nothing to report")).otherwise(F.concat(F.lit("Here {"), part))
    return t.g_chunks.select("user_id", "chunk_id", "document_id", "ordinal", answer.alias("response"))


@query(
    "ext1_rule_entities",
    r"""with hits as (select user_id, id as chunk_id, unnest(regexp_extract_all(content, '[A-Z][a-z]+\s+[A-Z][a-z]+')) as name, 'PERSON' as type, 1 as pattern_no from t_documents
       union all select user_id, id, unnest(regexp_extract_all(content, '(?:China|USA|UK|Japan|Germany|France|Canada|Australia)')), 'LOCATION', 6 from t_documents
       union all select user_id, id, unnest(regexp_extract_all(content, '(?:19|20)\d{2}(?:-\d{2})?')), 'TIME', 8 from t_documents
       union all select user_id, id, unnest(regexp_extract_all(content, '(?:Google|Apple|Microsoft|Amazon|Facebook|Meta|Tencent|Alibaba|ByteDance)[\w\s]*')), 'ORGANIZATION', 3 from t_documents)
       select chunk_id, name, arg_min(type, pattern_no) as type, min(pattern_no)::bigint as pattern_no from hits group by 1, 2""",
)
def rule_entities(t: Tables):
    return extract.rule_entities(t.t_documents.withColumnRenamed("id", "chunk_id")).select("chunk_id", "name", "type", "pattern_no")


@query(
    "ext2_parse_extraction",
    """select chunk_id, case ordinal % 4 when 0 then concat(' ', l_partkey, ':PART:|Supplier:ORG:d') when 1 then concat(' ', l_partkey, ':PART:') else '' end as entities,
       case when ordinal % 4 = 0 then concat(l_partkey, '>PART_OF>Supplier') else '' end as relations from g_chunks""",
)
def parse_extraction(t: Tables):
    parsed = extract.parse_extraction(_answers(t))
    entity = lambda e: F.concat(e["name"], F.lit(":"), e["type"], F.lit(":"), F.coalesce(e["description"], F.lit("")))
    relation = lambda r: F.concat_ws(">", r["source"], r["relation_type"], r["target"])
    return parsed.select("chunk_id", F.array_join(F.transform("entities", entity), "|").alias("entities"), F.array_join(F.transform("relations", relation), "|").alias("relations"))


_LABEL = "case ordinal % 6 when 0 then 'is part of' when 1 then 'works-at' when 2 then 'USES' when 3 then '位于' when 4 then 'betrays' else '' end"


@query("ext3_relation_types", "select chunk_id, case ordinal % 6 when 0 then 'PART_OF' when 1 then 'WORKS_AT' when 2 then 'USES' when 3 then 'LOCATED_IN' else 'RELATED_TO' end as relation_type from g_chunks")
def relation_types(t: Tables):
    return t.g_chunks.select("chunk_id", text.normalize_relation_type(F.expr(_LABEL)).alias("relation_type"))


@query("ext4_local_relations", "select chunk_id, cast(l_partkey as varchar) as source, 'Supplier' as target, 'PART_OF' as relation_type from g_chunks where ordinal % 4 = 0")
def local_relations(t: Tables):
    return extract.local_relations(extract.parse_extraction(_answers(t))).drop("user_id")


def _rule(t: Tables):
    return t.g_chunks.select("user_id", "chunk_id", "document_id", "ordinal", F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("name"), F.lit("PART").alias("type"))


@query("ext5_combine_entities", "select chunk_id, case when ordinal % 2 = 0 then upper(concat('Part ', l_partkey)) else concat('Part ', l_partkey) end as name, case when ordinal % 2 = 0 then 'model' end as description from g_chunks")
def combine_entities(t: Tables):
    model = _rule(t).where("ordinal % 2 = 0").withColumn("name", F.upper("name")).withColumn("description", F.lit("model"))
    return extract.combine_entities(_rule(t), model).select("chunk_id", "name", "description")


@query("ext6_unique_entities", "select document_id, arg_min(case when ordinal % 2 = 0 then upper(concat('Part ', l_partkey)) else concat('Part ', l_partkey) end, ordinal) as name, min(ordinal) as ordinal from g_chunks group by document_id, l_partkey")
def unique_entities(t: Tables):
    rows = _rule(t).withColumn("name", F.when(F.col("ordinal") % 2 == 0, F.upper("name")).otherwise(F.col("name")))
    return extract.unique_entities(rows).select("document_id", "name", "ordinal")


@query("ext7_parse_answers", """select chunk_id, case when ordinal % 2 = 0 then concat(content, '|b|c') else '' end as names, case ordinal % 3 when 0 then 'chitchat' else 'fact_retrieval' end as intent, case when ordinal % 2 = 0 then 0.5 else 0.0 end::double as faithfulness, case when ordinal % 2 = 0 then 1.0 else 0.25 end::double as correctness from g_chunks""")
def parse_answers(t: Tables):
    even = F.col("ordinal") % 2 == 0
    names = F.when(even, F.concat(F.lit('Names: ["'), "content", F.lit('", "b", " c ", "d"]'))).otherwise(F.lit("none"))
    intent = F.when(F.col("ordinal") % 3 == 0, F.lit('x {"intent": "chitchat"} y')).when(F.col("ordinal") % 3 == 1, F.lit('{"intent": "sing"}')).otherwise(F.lit("?"))
    judge = F.when(even, F.lit('{"claims": [{"supported": true}, {"supported": false}], "correctness": 7}')).otherwise(F.lit("no"))
    found = extract.parse_judgement(judge, F.lit(0.25))
    return t.g_chunks.select("chunk_id", F.array_join(extract.parse_names(names, 3), "|").alias("names"), extract.parse_intent(intent).alias("intent"), found["faithfulness"].alias("faithfulness"), found["correctness"].alias("correctness"))


def _rows(tables: dict, columns: dict):
    """The rows of several tables as ``what, user_id, a, b, c``."""
    out = None
    for what, own in columns.items():
        held = [F.col(x) for x in own] + [F.lit(None).cast("string")] * (3 - len(own))
        part = tables[what].select(F.lit(what).alias("what"), "user_id", *(x.alias(y) for x, y in zip(held, "abc", strict=True)))
        out = part if out is None else out.unionByName(part)
    return out


# -- graph -----------------------------------------------------------------------------


def _chunk_entities(t: Tables):
    """Mentions with types of even parts only, an update per document date."""
    typed = F.col("l_partkey") % 2 == 0
    return t.g_chunks.select("user_id", "chunk_id", F.col("l_partkey").cast("string").alias("name"), F.when(typed, F.concat(F.lit("T"), F.col("l_partkey").cast("string"))).alias("type"), F.when(typed, F.col("chunk_id")).alias("description"), F.struct("created_at", "chunk_id").alias("updated_at"))


@query(
    "grf1_build_graph",
    """select 'owns' as what, user_id, id as a, null as b, null as c from g_documents union all select 'contains', user_id, document_id, chunk_id, null from g_chunks
       union all select 'next', user_id, chunk_id, next_chunk_id, null from g_chunks where next_chunk_id is not null union all select distinct 'mentions', user_id, chunk_id, entity_name, null from g_mentions
       union all select 'entities', user_id, entity_name, case when entity_name::bigint % 2 = 0 then concat('T', entity_name) end, null from (select distinct user_id, entity_name from g_mentions) y
       union all select 'relations', user_id, source, relation_type, target from g_relations""",
)
def build_graph(t: Tables):
    g = graph.build_graph(t.g_documents, t.g_chunks, _chunk_entities(t), t.g_relations)
    return _rows(g, {"owns": ("document_id",), "contains": ("document_id", "chunk_id"), "next": ("from_chunk", "to_chunk"), "mentions": ("chunk_id", "entity_name"), "entities": ("name", "type"), "relations": ("source", "relation_type", "target")})


_TERMS = "terms as (select distinct user_id, unnest([substring(name, 1, 2), substring(name, 2, 3), name, concat(name, '0')]) as term from g_entities)"


@query("grf2_search_entities", f"with {_TERMS}, h as (select t.user_id, term, name, type, row_number() over (partition by t.user_id, term order by name) as rank from g_entities e join terms t on e.user_id = t.user_id where contains(lower(name), lower(term))) select * from h where rank <= 20")
def search_entities(t: Tables):
    name, entities = F.col("name"), scratch.written(t.g_entities, "entities")
    terms = entities.select("user_id", F.explode(F.array(F.substring(name, 1, 2), F.substring(name, 2, 3), name, F.concat(name, F.lit("0")))).alias("term"))
    return graph.search_entities(entities, terms)


HOPS_SQL = """both_ as (select user_id, source as a, target as b, relation_type, concat_ws('|', source, relation_type, target) as edge from g_relations union all select user_id, target, source, relation_type, concat_ws('|', source, relation_type, target) from g_relations),
  one as (select e.user_id, e.name as centre, b as "end", 1 as hops, [relation_type] as types, [edge] as used from g_entities e join both_ s on e.user_id = s.user_id and e.name = s.a),
  two as (select o.user_id, o.centre, s.b as "end", 2 as hops, list_append(o.types, s.relation_type) as types, list_append(o.used, s.edge) as used from one o join both_ s on o.user_id = s.user_id and o."end" = s.a where s.edge <> o.used[1]),
  paths as (select *, row_number() over (partition by user_id, centre order by hops, "end", types, used) as rank from (select * from one union all select * from two) u)"""


@query("grf3_related_entities", f"""with {HOPS_SQL} select distinct user_id, centre as source, unnest(types) as relation_type, "end" as target from paths where rank <= 100""")
def related_entities(t: Tables):
    centres = t.g_entities.select("user_id", F.col("name").alias("centre")).distinct()
    return graph.related_entities(centres, t.g_relations, 2)[1]


@query("grf4_entities_from_chunks", "select distinct user_id, name, type, description from g_entities where (user_id, name) in (select (user_id, entity_name) from g_mentions where chunk_id like '%\\_1' escape '\\')")
def entities_from_chunks(t: Tables):
    return graph.entities_from_chunks(t.g_chunks.where("ordinal = 1").select("user_id", "chunk_id"), t.g_mentions, t.g_entities)


_COUNTS = "c as (select user_id, entity_name as name, count(*) as mention_count, count(distinct document_id) as document_count from g_mentions group by 1, 2), e as (select user_id, name, type, mention_count, document_count, row_number() over (partition by user_id order by mention_count desc, name) as rank from g_entities join c using (user_id, name))"


@query("grf5_entity_mentions", f"with {_COUNTS} select * from e")
def entity_mentions(t: Tables):
    return graph.entity_mentions(t.g_entities, t.g_mentions, t.g_chunks)


TOP_SQL = "x as (select user_id, document_id, entity_name as name, count(*) as mentions from g_mentions group by 1, 2, 3), y as (select x.*, type, row_number() over (partition by x.user_id, document_id order by mentions desc, name) as rank from x join g_entities using (user_id, name))"


@query("grf6_doc_entities", f"with {TOP_SQL} select user_id, document_id, name, type, mentions, rank from y where rank <= 10")
def doc_entities(t: Tables):
    return graph.doc_entities(t.g_entities, t.g_mentions)


RELATED_SQL = """f as (select distinct user_id, document_id, entity_name from g_mentions), p as (select a.user_id, a.document_id, b.document_id as other_id, count(*) as shared from f a join f b on a.user_id = b.user_id and a.entity_name = b.entity_name and a.document_id <> b.document_id group by 1, 2, 3),
  rd as (select p.user_id, p.document_id, other_id, shared, title, row_number() over (partition by p.user_id, p.document_id order by shared desc, title, other_id) as rank from p join g_documents d on d.id = other_id)"""


@query("grf7_related_documents", f"with {RELATED_SQL} select * from rd where rank <= 5")
def related_documents(t: Tables):
    return graph.related_documents(t.g_documents, t.g_mentions)


@query(
    "grf8_entity_detail",
    """with c as (select user_id, entity_name as name, count(distinct chunk_id) as chunk_count, count(distinct document_id) as document_count, min(created_at) as first_seen from g_mentions join (select id, created_at from g_documents) d on d.id = document_id group by 1, 2),
       r as (select user_id, name, count(*) as related_count from (select user_id, source as name from g_relations union all select user_id, target from g_relations) u group by 1, 2)
       select e.user_id, e.name, e.type, chunk_count, document_count, <ts:first_seen> as first_seen, coalesce(related_count, 0) as related_count from g_entities e join c on e.user_id = c.user_id and e.name = c.name left join r on r.user_id = e.user_id and r.name = e.name""",
)
def entity_detail(t: Tables):
    detail, _ = graph.entity_detail(t.g_entities, t.g_mentions, t.g_relations, t.g_documents, t.g_chunks)
    return detail.withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss"))


@query(
    "grf8_neighbours",
    """with o as (select user_id, source as name, target as other, relation_type from g_relations union select user_id, target, source, relation_type from g_relations),
       x as (select o.*, e.type, row_number() over (partition by o.user_id, o.name order by other, relation_type) as rank from o join g_entities e on e.user_id = o.user_id and e.name = o.other) select * from x where rank <= 50""",
)
def neighbours(t: Tables):
    return graph.neighbours(t.g_entities, t.g_relations)


@query(
    "grf9_graph_view",
    """with n as (select user_id, name, type, row_number() over (partition by user_id order by name) as rank from g_entities), e as (select *, row_number() over (partition by user_id order by source, target, relation_type) as rank from g_relations)
       select 'edge' as part, user_id, source as name, relation_type as type, target, rank from e where rank <= 2000 and (user_id, source) in (select (user_id, name) from n where rank <= 500) and (user_id, target) in (select (user_id, name) from n where rank <= 500)
       union all select 'node', user_id, name, type, null, rank from n where rank <= 500""",
)
def graph_view(t: Tables):
    nodes, edges = graph.graph_view(t.g_entities, t.g_relations)
    edges = edges.select(F.lit("edge").alias("part"), "user_id", F.col("source").alias("name"), F.col("relation_type").alias("type"), "target", "rank")
    return edges.unionByName(nodes.select(F.lit("node").alias("part"), "user_id", "name", "type", F.lit(None).cast("string").alias("target"), "rank"))


_CATEGORY = "case " + " ".join("when " + " or ".join(f"contains(lower(type), '{w}')" for w in words) + f" then '{name}'" for name, words in vocab.CATEGORIES.items()) + " else 'other' end"


@query(
    "grf10_entity_categories",
    f"""with x as (select user_id, type, count(*) as n from g_entities group by 1, 2), c as (select user_id, {_CATEGORY} as category, type, n from x), r as (select *, row_number() over (partition by user_id, category order by n desc, type) as k from c)
        select user_id, category, sum(n)::bigint as entities, string_agg(case when k <= 2 then type end, ',' order by k) as top_types from r group by 1, 2""",
)
def entity_categories(t: Tables):
    return graph.entity_categories(t.g_entities)


_PATCH = "patches as (select user_id, name, case length(name) % 3 when 0 then 'person' when 1 then 'planet' end as type, case when name like '%1' then '' when name like '%2' then 'new' end as description from g_entities where name like '1%' union all select distinct user_id, 'nobody', null, 'x' from g_documents)"


def _patches(t: Tables):
    n = F.length("name") % 3
    some = t.g_entities.where("name like '1%'").select("user_id", "name", F.when(n == 0, "person").when(n == 1, "planet").alias("type"), F.when(F.col("name").endswith("1"), "").when(F.col("name").endswith("2"), "new").alias("description"))
    return some.unionByName(t.g_documents.select("user_id").distinct().select("user_id", F.lit("nobody").alias("name"), F.lit(None).cast("string").alias("type"), F.lit("x").alias("description")))


@query(
    "grf11_update_entities",
    f"""with {_PATCH}, good as (select * from patches where type is null or upper(type) in {_TYPES}) select e.user_id, e.name, coalesce(upper(g.type), e.type) as type, case when g.description is null then e.description else nullif(g.description, '') end as description from g_entities e left join good g on g.user_id = e.user_id and g.name = e.name""",
)
def update_entities(t: Tables):
    return graph.update_entities(t.g_entities, _patches(t))[0]


@query("grf11_rejected_edits", f"with {_PATCH} select user_id, name, 'type' as reason from patches where upper(type) not in {_TYPES} union all select user_id, name, 'unknown' from patches where name = 'nobody'")
def rejected_edits(t: Tables):
    return graph.update_entities(t.g_entities, _patches(t))[1]


@query(
    "grf12_delete_entities",
    """select 'mentions' as what, user_id, chunk_id as a, entity_name as b, null as c from g_mentions where entity_name not like '%7' union all select 'relations', user_id, source, relation_type, target from g_relations where source not like '%7' and target not like '%7'
       union all select 'entities', user_id, name, type, null from g_entities where name not like '%7' union all select 'deleted', user_id, name, '1', null from g_entities where name like '%7' union all select distinct 'deleted', user_id, 'nobody', '0', null from g_documents""",
)
def delete_entities(t: Tables):
    keys = t.g_entities.where("name like '%7'").select("user_id", "name").unionByName(t.g_documents.select("user_id", F.lit("nobody").alias("name")).distinct())
    out = graph.delete_entities(keys, t.g_entities, t.g_mentions, t.g_relations)
    out["deleted"] = out["deleted"].withColumn("deleted", F.col("deleted").cast("string"))
    return _rows(out, {"mentions": ("chunk_id", "entity_name"), "relations": ("source", "relation_type", "target"), "entities": ("name", "type"), "deleted": ("name", "deleted")})


_MERGE = """pairs as (select e.user_id, e.name as source, cast(e.name::bigint + 1 as varchar) as target from g_entities e where e.name like '%5' and (e.user_id, cast(e.name::bigint + 1 as varchar)) in (select (user_id, name) from g_entities)),
  moved as (select r.user_id, coalesce(a.target, r.source) as s, coalesce(b.target, r.target) as t, relation_type, a.target is not null or b.target is not null as changed from g_relations r left join pairs a on a.user_id = r.user_id and a.source = r.source left join pairs b on b.user_id = r.user_id and b.source = r.target)"""


def _merged(t: Tables):
    pairs = t.g_entities.where("name like '%5'").select("user_id", F.col("name").alias("source"), (F.col("name").cast("long") + 1).cast("string").alias("target"))
    return graph.merge_entities(pairs, t.g_entities, t.g_mentions.drop("document_id"), t.g_relations)


@query("grf13_merge_entities", f"with {_MERGE} select distinct user_id, s as source, t as target, relation_type from moved where not changed or s <> t")
def merge_entities(t: Tables):
    return _merged(t)["relations"]


@query("grf13_merged_mentions", f"with {_MERGE} select distinct m.user_id, chunk_id, coalesce(p.target, entity_name) as entity_name from g_mentions m left join pairs p on p.user_id = m.user_id and p.source = m.entity_name")
def merged_mentions(t: Tables):
    return _merged(t)["mentions"]


_DELETE = "gone as (select id from g_documents where file_type = 'P' or id like '%3'), kept as (select * from g_mentions where document_id not in (select id from gone)), orphans as (select distinct user_id, entity_name from g_mentions where document_id in (select id from gone) and (user_id, entity_name) not in (select (user_id, entity_name) from kept))"


@query(
    "grf14_delete_documents",
    f"""with {_DELETE} select 'documents' as what, user_id, id as a, null as b, null as c from g_documents where id not in (select id from gone) union all select 'chunks', user_id, document_id, chunk_id, null from g_chunks where document_id not in (select id from gone)
        union all select 'mentions', user_id, chunk_id, entity_name, null from kept union all select 'orphans', user_id, entity_name, null, null from orphans
        union all select 'entities', user_id, name, type, null from g_entities where (user_id, name) not in (select (user_id, entity_name) from orphans)
        union all select 'relations', user_id, source, relation_type, target from g_relations where (user_id, source) not in (select (user_id, entity_name) from orphans) and (user_id, target) not in (select (user_id, entity_name) from orphans)""",
)
def delete_documents(t: Tables):
    ids = t.g_documents.where("file_type = 'P' or id like '%3'").select("user_id", F.col("id").alias("document_id"))
    out = graph.delete_documents(ids, t.g_documents, t.g_chunks, t.g_mentions, t.g_entities, t.g_relations)
    return _rows(out, {"documents": ("id",), "chunks": ("document_id", "chunk_id"), "mentions": ("chunk_id", "entity_name"), "orphans": ("name",), "entities": ("name", "type"), "relations": ("source", "relation_type", "target")})


_GONE = "select c_nationkey from customer where c_acctbal < 0"


@query(
    "grf15_purge_users",
    f"""with x as (select 'documents' as what, user_id, id as key, null as a, null as b from g_documents union all select 'mentions', user_id, chunk_id, entity_name, null from g_mentions union all select 'relations', user_id, source, relation_type, target from g_relations)
        select 'kept ' || what as what, user_id, key, a, b, 1 as n from x where user_id not in ({_GONE}) union all select 'gone ' || what, user_id, null, null, null, count(*) from x where user_id in ({_GONE}) group by 1, 2""",
)
def purge_users(t: Tables):
    """The rows that stay, and of those that go how many each user has."""
    users = t.customer.where("c_acctbal < 0").select(F.col("c_nationkey").cast("long").alias("user_id")).distinct()
    tables = {"documents": t.g_documents.select("user_id", "id"), "mentions": t.g_mentions.select("user_id", "chunk_id", "entity_name"), "relations": t.g_relations.select("user_id", "source", "relation_type", "target")}
    none = F.lit(None).cast("string")
    out = None
    for name, kept in graph.purge_users(users, tables).items():
        cols = [*map(F.col, kept.columns[1:]), none, none][:3]
        rows = kept.select(F.lit(f"kept {name}").alias("what"), "user_id", *(c.alias(x) for c, x in zip(cols, ("key", "a", "b"), strict=True)), F.lit(1).cast("long").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    for name, gone in graph.purge_users(users, tables, dry_run=True).items():
        out = out.unionByName(gone.select(F.lit(f"gone {name}").alias("what"), "user_id", *(none.alias(x) for x in ("key", "a", "b")), "n"))
    return out
