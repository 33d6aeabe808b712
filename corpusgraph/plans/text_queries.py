"""Sources, sinks, text preparation and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import segment, text, vocab
from ..operators import chunking
from ..sources import scratch, tables
from .registry import Tables, query


@query(
    "src1_file_intake",
    """select path, ext as extension, case when ext not in ('pdf','docx','doc','txt','md','markdown') then 'extension' when octet_length(encode(content)) > 20000 then 'size'
       when ext in ('pdf','doc','docx') then 'content' when ext in ('txt','md','markdown') and trim(content, ' ' || chr(9) || chr(10) || chr(13)) = '' then 'blank' end as reason
       from (select concat('/in/', cast(doc_id as varchar), '.', case doc_id % 7 when 0 then 'PDF' when 1 then 'docx' when 2 then 'exe' when 3 then 'txt' when 4 then 'md' when 5 then 'markdown' else 'TXT' end) as path,
       case doc_id % 7 when 0 then 'pdf' when 1 then 'docx' when 2 then 'exe' when 3 then 'txt' when 4 then 'md' when 5 then 'markdown' else 'txt' end as ext, text as content from documents) x""",
)
def file_intake(t: Tables):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("PDF", "docx", "exe", "txt", "md", "markdown", "TXT")]), (F.col("doc_id") % 7 + 1).cast("int"))
    files = t.documents.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return tables.classify_files(files, max_bytes=20_000).select("path", "extension", "reason")


@query(
    "src2_clean_markdown",
    """select document_id, trim(replace(regexp_replace(content, '\\n{3,}', chr(10) || chr(10), 'g'), chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(13)) as content,
       coalesce(nullif(trim(regexp_extract(content, '(?m)^# +([^\\n]+)$', 1), ' ' || chr(9) || chr(13)), ''), title) as title from t_markdown""",
)
def clean_markdown(t: Tables):
    return tables.clean_markdown(t.t_markdown.withColumnRenamed("title", "original_filename")).select("document_id", "content", "title")


@query("src3_load_tables", "select id, user_id, title, 'pending' as status, <ts:created_at> as created_at, <ts:created_at> as updated_at from g_documents")
def load_tables(t: Tables):
    folder = scratch.new_path(t.spark, "tables")
    t.g_documents.select("id", "user_id", "title", "original_filename", "file_type", F.col("created_at").cast("timestamp").alias("created_at")).write.parquet(f"{folder}/documents.parquet")
    docs = tables.load_tables(t.spark, folder, ("documents",))["documents"]
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return docs.select("id", "user_id", "title", "status", stamp("created_at"), stamp("updated_at"))


@query(
    "src4_read_gold",
    """select cast(item_id as varchar) as id, text as query, case when item_id % 3 = 0 then 'REPLACE_WITH_ID' else concat('c', cast(item_id as varchar)) end as expected,
       concat('from ', cast(item_id as varchar)) as comment, item_id % 3 = 0 as skipped from benchmark""",
)
def read_gold(t: Tables):
    folder = scratch.new_path(t.spark, "gold")
    name = F.when(F.col("item_id") % 3 == 0, F.lit("REPLACE_WITH_ID")).otherwise(F.concat(F.lit("c"), F.col("item_id").cast("string")))
    case = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.array(name).alias("expected_chunk_ids"), F.array(F.lit("from"), F.col("item_id").cast("string")).alias("_comment"))
    # a file for every 32 cases, as an array
    files = t.benchmark.groupBy(F.floor(F.col("item_id") / 32).alias("file")).agg(F.to_json(F.collect_list(case)).alias("value"))
    files.write.partitionBy("file").text(folder)
    cases, skipped = tables.read_gold(t.spark, folder)
    rows = cases.withColumn("skipped", F.lit(False)).unionByName(skipped.withColumn("skipped", F.lit(True)))
    return rows.select("id", "query", F.array_join("expected_chunk_ids", ",").alias("expected"), F.col("metadata")["_comment"].alias("comment"), "skipped")


_UPSERT = """select chunk_id, content, case when exists_new then 'new' else 'old' end as side from (select chunk_id, content, length(content) % 2 = 0 as exists_new from g_chunks) x"""


@query("snk1_upsert_chunks", _UPSERT)
def upsert_chunks(t: Tables):
    old = t.g_chunks.select("chunk_id", "content", F.lit("old").alias("side"), F.col("created_at").alias("updated_at"))
    new = old.where(F.length("content") % 2 == 0).withColumn("side", F.lit("new"))
    return tables.upsert_chunks(new, old).select("chunk_id", "content", "side")


@query(
    "snk2_rebuild_vectors",
    """select chunk_id, case when ordinal % 4 = 0 then 'missing' else 'ready' end as state, case when ordinal % 4 <> 0 then replace(hierarchy_path, ',[', ', [') end as hierarchy_path from g_chunks
       union all select concat('gone_', id), 'stale', null from g_documents""",
)
def rebuild_vectors(t: Tables):
    chunks = t.g_chunks.withColumn("content", F.concat_ws(" ", "chunk_id", "content"))
    cache = chunks.where(F.col("ordinal") % 4 != 0).select(F.md5("content").alias("text_hash"), F.array(F.lit(1.0)).alias("embedding"), F.lit("m").alias("model"))
    store = t.g_documents.select(F.concat(F.lit("gone_"), "id").alias("chunk_id")).unionByName(chunks.where(F.col("ordinal") % 4 != 0).select("chunk_id"))
    ready, missing, stale = tables.rebuild_vectors(chunks, cache, "m", store)
    none = F.lit(None).cast("string")
    return ready.select("chunk_id", F.lit("ready").alias("state"), "hierarchy_path").unionByName(missing.select("chunk_id", F.lit("missing").alias("state"), none.alias("hierarchy_path"))).unionByName(stale.select("chunk_id", F.lit("stale").alias("state"), none.alias("hierarchy_path")))


_LINES = "lines as (select document_id, user_id, unnest(string_split(content, chr(10))) as raw, unnest(range(len(string_split(content, chr(10))))) as line from t_markdown)"
_HEADS = (
    _LINES
    + r""", heads as (select document_id, user_id, line, length(regexp_extract(trim(raw), '^(#{1,6})\s+(.+)$', 1)) as level, trim(regexp_extract(trim(raw), '^(#{1,6})\s+(.+)$', 2)) as title
       from lines where regexp_matches(trim(raw), '^(#{1,6})\s+(.+)$'))"""
)


@query("chk1_parse_headers", f"with {_HEADS} select user_id, document_id, line, level, title from heads")
def parse_headers(t: Tables):
    return chunking.parse_headers(t.t_markdown).withColumn("line", F.col("line").cast("long")).withColumn("level", F.col("level").cast("long"))


_SECTIONS = f"""with {_HEADS}, cut as (select *, lead(line) over w as next_line, max(case when level = 1 then line end) over (w rows between unbounded preceding and 1 preceding) as p1,
       arg_max(title, case when level = 1 then line end) over (w rows between unbounded preceding and 1 preceding) as t1 from heads window w as (partition by document_id order by line)),
       whole as (select document_id, string_split(content, chr(10)) as ls from t_markdown)
       select document_id, line as start_line, coalesce(next_line, len(ls)) - 1 as end_line, level, case when level = 2 and p1 is not null then concat(t1, ' > ', title) else title end as path,
       trim(array_to_string(ls[line + 1 : coalesce(next_line, len(ls))], chr(10)), ' ' || chr(10)) as content from cut join whole using (document_id)
       union all select document_id, 0, min(line) - 1, 0, 'Introduction', trim(array_to_string(any_value(ls)[1 : min(line)], chr(10)), ' ' || chr(10)) from heads join whole using (document_id) group by document_id
         having min(line) > 0 and trim(array_to_string(any_value(ls)[1 : min(line)], chr(10)), ' ' || chr(10)) <> ''
       union all select document_id, 0, len(ls) - 1, 0, 'Document', trim(array_to_string(ls, chr(10)), ' ' || chr(10)) from whole where document_id not in (select document_id from heads) and trim(array_to_string(ls, chr(10)), ' ' || chr(10)) <> ''"""


@query("chk2_sections", _SECTIONS)
def sections(t: Tables):
    return chunking.sections(t.t_markdown).select("document_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.col("level").cast("long").alias("level"), F.array_join("path", " > ").alias("path"), "content")


@query("chk3_whole_and_intro", f"select document_id, path, length(content) as n from ({_SECTIONS}) x where level = 0")
def whole_and_intro(t: Tables):
    return chunking.sections(t.t_markdown).where("level = 0").select("document_id", F.array_join("path", " > ").alias("path"), F.length("content").cast("long").alias("n"))


def split_sql(source: str, longer: str) -> str:
    """Parts ``f(id, parts)`` of the texts ``source(id, content)``: those with ``longer`` are split, the others whole."""
    return rf"""p as (select id, unnest(regexp_split_to_array(content, '\n\s*\n')) as p, unnest(range(len(regexp_split_to_array(content, '\n\s*\n')))) as i from {source} where {longer}),
       u as (select id, i, unnest(case when length(p) > 500 then string_split(regexp_replace(p, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)) else [p] end) as x,
         unnest(range(case when length(p) > 500 then len(string_split(regexp_replace(p, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1))) else 1 end)) as j, case when length(p) > 500 then ' ' else chr(10) || chr(10) end as gap, length(p) > 500 as long from p),
       n as (select *, row_number() over (partition by id order by i, j) as k, count(*) over (partition by id) as total from u),
       r(id, k, open, parts) as (select id, 0::bigint, '', []::varchar[] from (select distinct id from n) z union all
         select r.id, n.k, case when not (long and j = 0) and length(open) + length(gap) + length(x) <= 500 then case when open <> '' then open || gap || x else x end else x end,
           case when (not (long and j = 0) and length(open) + length(gap) + length(x) <= 500) or open = '' then parts else list_append(parts, open) end from r join n on n.id = r.id and n.k = r.k + 1),
       f as (select id, case when open <> '' then list_append(parts, open) else parts end as parts from r join (select distinct id, total from n) t using (id) where r.k = t.total
         union all select id, [content] from {source} where not ({longer}) and content <> '')"""


@query("chk4_split_text", f"with recursive {split_sql('t_documents', 'length(content) > 500')} select id, unnest(range(len(parts))) as part, unnest(parts) as content from f")
def split_text(t: Tables):
    parts = t.t_documents.select("id", F.posexplode_outer(chunking.split_text("content")).alias("part", "content")).where("part is not null")
    return parts.withColumn("part", F.col("part").cast("long"))


@query("chk5_add_overlap", "select document_id, ordinal, case when ordinal = 1 then content else concat(right(lag(content) over (partition by document_id order by ordinal), 10), content) end as content from g_chunks")
def add_overlap(t: Tables):
    parts = t.g_chunks.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]).alias("parts"))
    return parts.select("document_id", F.posexplode(chunking.add_overlap(F.col("parts"), 10)).alias("ordinal", "content")).withColumn("ordinal", (F.col("ordinal") + 1).cast("long"))


_TRIM = "trim({0}, ' ' || chr(10))"
_CHUNKS = f"""with recursive {_HEADS}, cut as (select *, lead(line) over w as next_line, max(case when level = 1 then line end) over (w rows between unbounded preceding and 1 preceding) as p1,
       arg_max(title, case when level = 1 then line end) over (w rows between unbounded preceding and 1 preceding) as t1 from heads window w as (partition by document_id order by line)),
     whole as (select user_id, document_id, string_split(content, chr(10)) as ls from t_markdown),
     sec as (select *, concat(document_id, case kind when 'intro' then ':a' else ':b' end, lpad(start_line::varchar, 9, '0')) as id from (
       select w.user_id, document_id, line as start_line, coalesce(next_line, len(ls)) - 1 as end_line, level, case when level = 2 and p1 is not null then [t1, title] else [title] end as path, case when level = 2 then p1 end as parent_line, 'section' as kind,
         {_TRIM.format("array_to_string(ls[line + 1 : coalesce(next_line, len(ls))], chr(10))")} as content from cut join whole w using (document_id)
       union all select w.user_id, document_id, 0, first - 1, 0, ['Introduction'], null, 'intro', {_TRIM.format("array_to_string(ls[1 : first], chr(10))")} from (select document_id, min(line) as first from heads group by 1 having min(line) > 0) h join whole w using (document_id)
       union all select user_id, document_id, 0, len(ls) - 1, 0, ['Document'], null, 'document', {_TRIM.format("array_to_string(ls, chr(10))")} from whole where document_id not in (select document_id from heads)) z where content <> ''),
     {split_sql("sec", "length(content) > 500 and kind <> 'intro'")},
     b as (select id, len(parts) as n, unnest(range(len(parts))) as part, unnest(parts) as body from f),
     c as (select s.*, b.n, part, case when part = 0 then body else concat(right(lag(body) over (partition by b.id order by part), {vocab.OVERLAP_CHARS}), body) end as body,
       case when part > 0 or (kind = 'document' and b.n > 1) then concat(b.id, '_', lpad(part::varchar, 6, '0')) else b.id end as chunk_id from b join sec s on s.id = b.id),
     e as (select document_id, start_line, arg_max(chunk_id, part) as ancestor from c where kind = 'section' group by 1, 2)
     select c.user_id, c.document_id, chunk_id, row_number() over w as ordinal, body as content, level, array_to_string(case when part > 0 and kind = 'section' then list_append(path, '[Part ' || (part + 1) || ']') else path end, ' > ') as path,
       array_to_string(case when part > 0 and kind = 'section' then list_append(path, '[Part ' || (part + 1) || ']') else path end, ',') as hierarchy_path,
       case when part = 0 or kind <> 'section' then ancestor when part = 1 then c.id else concat(c.id, '_', lpad((part - 1)::varchar, 6, '0')) end as parent_id,
       lag(chunk_id) over w as prev_chunk_id, lead(chunk_id) over w as next_chunk_id, c.start_line, end_line
       from c left join e on e.document_id = c.document_id and e.start_line = c.parent_line window w as (partition by c.document_id order by case kind when 'intro' then 0 else 1 end, c.start_line, part)"""


@query("chk6_chunk_documents", _CHUNKS)
def chunk_documents(t: Tables):
    found = chunking.chunk_documents(t.t_markdown).withColumn("path", F.array_join("path", " > "))
    return found.withColumns({x: F.col(x).cast("long") for x in ("level", "start_line", "end_line")})


@query("chk7_next_links", "select user_id, prev_chunk_id as from_chunk, chunk_id as to_chunk from g_chunks where prev_chunk_id is not null")
def next_links(t: Tables):
    return chunking.next_links(t.g_chunks)


@query("txt1_tokens", r"select id, len(x) as n, md5(array_to_string(x, ' ')) as digest from (select id, regexp_extract_all(lower(content), '[\p{L}\p{N}]{2,}') as x from t_documents) y")
def tokens(t: Tables):
    return t.t_documents.select("id", text.tokens(F.col("content")).alias("x")).select("id", F.size("x").cast("long").alias("n"), F.md5(F.array_join("x", " ")).alias("digest"))


@query("txt1_word_tokens")
def word_tokens(t: Tables):
    """Passages without their spaces, cut again into words of the passages."""
    low = F.lower(F.coalesce("text", F.lit("")))
    counts = t.benchmark.select(F.explode(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = {r.w: r.n for r in counts.limit(segment.MOST_WORDS).collect()}
    tokens = segment.word_tokens(words or {"a": 1}, run="[a-z]+", least=1)
    return t.benchmark.select("item_id", F.array_join(tokens(F.regexp_replace(low, "[^a-z]+", "")), " ").alias("words"))


@query("txt2_token_set", r"select id, len(list_distinct(regexp_extract_all(lower(content), '[A-Za-z0-9_]+'))) as n from t_documents")
def token_set(t: Tables):
    return t.t_documents.select("id", F.size(text.token_set(F.col("content"))).cast("long").alias("n"))


@query("txt3_normalize_tag", r"select document_id, nullif(lower(trim(regexp_replace(trim(tag), '^(#\s*)+', ''))), '') as tag from g_tags")
def normalize_tag(t: Tables):
    return t.g_tags.select("document_id", text.normalize_tag(F.col("tag")).alias("tag"))


@query("txt4_split_path", "select chunk_id, replace(hierarchy_path, ',', '/') as path from g_chunks")
def split_path(t: Tables):
    return t.g_chunks.select("chunk_id", F.array_join(text.split_path(F.col("hierarchy_path")), "/").alias("path"))


@query("txt5_section_key", "select chunk_id, replace(hierarchy_path, ',[Part 2]', '') as section from g_chunks")
def section_key(t: Tables):
    return t.g_chunks.select("chunk_id", text.section_key(F.col("hierarchy_path")).alias("section"))


@query(
    "txt6_clip",
    r"""select id, case when length(content) > 240 then concat(rtrim(substring(content, 1, 240), ' ' || chr(9) || chr(10)), '…') else content end as clipped,
       case when line = '' then '(empty message)' when length(line) > 80 then concat(substring(line, 1, 77), '...') else line end as snippet
       from (select id, content, replace(trim(content, ' ' || chr(9) || chr(10) || chr(13)), chr(10), ' ') as line from t_documents) x""",
)
def clip(t: Tables):
    return t.t_documents.select("id", text.clip(F.col("content"), 240).alias("clipped"), text.activity_snippet(F.col("content")).alias("snippet"))


@query("txt7_to_day", "select id, <day:created_at> as day from g_documents")
def to_day(t: Tables):
    n = F.col("id").cast("long") % 3
    written = F.when(n == 0, F.date_format("created_at", "yyyy-MM-dd")).when(n == 1, F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"))
    return t.g_documents.select("id", F.date_format(text.to_day(written), "yyyy-MM-dd").alias("day"))
