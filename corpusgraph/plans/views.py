"""The data model over the driver's tables: the same views in Spark and in DuckDB.

``VIEWS`` has each view's SQL with a few words that differ between the two engines
filled in, so that both read one definition.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..sources.scratch import few, written

# Documents that hold a passage have its inner words (five of them, from the second on) side by side, as only the
# first and the last may be parts of words there; passages without inner words meet all documents. DuckDB takes all pairs (see ``_gold``).
_PASSAGES = """select item_id, least(size(x) - 2, 5) as n, xxhash64(array_join(slice(x, 2, least(size(x) - 2, 5)), ' ')) as w from (select item_id, split(text, '[ \\n\\t]+') as x from {benchmark}) z where size(x) > 2"""
SPARK = {
    "text": "string", "day": "date_format({0}, 'yyyy-MM-dd')", "ntz": "timestamp_ntz", "digits": "regexp_extract({0}, '[0-9]+', 0)",
    "ts": "date_format({0}, 'yyyy-MM-dd HH:mm:ss')", "epoch": "cast(unix_micros(cast({0} as timestamp)) / 1000000 as double)", "real": "double",
    "shift": "cast({0} as timestamp_ntz) + make_dt_interval(0, {1}, {2}, 0)", "holds": "contains({0}, {1})",
    "markdown": "array_join(transform(split({0}, '\\n'), (x, i) -> case when (i + 1) % 15 = 0 then concat('# ', x) when (i + 1) % 5 = 0 then concat('## ', x) else x end), '\\n\\n')",
}
DUCK = {
    "anchored": "(select item_id, doc_id from benchmark, documents) a",
    "text": "varchar", "day": "strftime({0}, '%Y-%m-%d')", "ntz": "timestamp", "digits": "regexp_extract({0}, '[0-9]+')",
    "ts": "strftime({0}, '%Y-%m-%d %H:%M:%S')", "epoch": "epoch({0})", "real": "double",
    "shift": "cast({0} as timestamp) + to_hours({1}) + to_minutes({2})", "holds": "contains({0}, {1})",
    "markdown": "array_to_string(list_transform(string_split({0}, chr(10)), lambda x, i: case when i % 15 = 0 then concat('# ', x) when i % 5 = 0 then concat('## ', x) else x end), concat(chr(10), chr(10)))",
}

VIEWS = {
    "g_documents": """select cast(o_orderkey as <text>) as id, cast(c_nationkey as bigint) as user_id, concat('Order ', cast(o_orderkey as <text>)) as title,
        concat('order_', cast(o_orderkey as <text>), '.md') as original_filename, o_orderstatus as file_type, o_orderdate as created_at, o_orderpriority as priority
        from orders join customer on o_custkey = c_custkey""",
    "g_chunks": """select *, concat(document_id, '_', cast(ordinal as <text>)) as chunk_id,
        case when ordinal > 1 then concat(document_id, '_', cast(ordinal - 1 as <text>)) end as prev_chunk_id,
        case when ordinal < n then concat(document_id, '_', cast(ordinal + 1 as <text>)) end as next_chunk_id
        from (select d.id as document_id, d.user_id, d.created_at, l_partkey, concat('Section ', l_returnflag, case when l_linestatus = 'F' then ',[Part 2]' else '' end) as hierarchy_path,
        concat('Part ', cast(l_partkey as <text>), ' of supplier ', cast(l_suppkey as <text>), ' ', l_returnflag, l_linestatus) as content,
        cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) as bigint) as ordinal,
        cast(count(*) over (partition by l_orderkey) as bigint) as n
        from lineitem join g_documents d on cast(l_orderkey as <text>) = d.id) x""",
    "g_entities": """select distinct c.user_id, cast(p_partkey as <text>) as name, p_type as type, p_name as description from part join g_chunks c on c.l_partkey = p_partkey""",
    "g_mentions": """select user_id, document_id, chunk_id, cast(l_partkey as <text>) as entity_name from g_chunks""",
    "g_relations": """select distinct user_id, source, target, case (a + b) % 12 <cases> end as relation_type from
        (select user_id, cast(l_partkey as <text>) as source, l_partkey as a, lead(l_partkey) over (partition by document_id order by ordinal) as b,
        cast(lead(l_partkey) over (partition by document_id order by ordinal) as <text>) as target from g_chunks) x where b is not null and a <> b""",
    "g_tags": """select document_id, user_id, tag from (select id as document_id, user_id, priority as tag from g_documents union all select id, user_id, concat('# ', file_type) from g_documents) x""",
    "t_documents": """select cast(doc_id as <text>) as id, cast(<digits:source> as bigint) % 5 as user_id, concat('Doc ', cast(doc_id as <text>)) as title, text as content, doc_id from documents""",
    "t_markdown": """select id as document_id, user_id, title, <markdown:content> as content from t_documents""",
    "v_vectors": """select cast(vec_id as <text>) as chunk_id, vec_id, vec_id % 5 as user_id, cast(label as <text>) as document_id, embedding from embeddings""",
    "v_queries": """select vec_id as query_id, vec_id % 5 as user_id, embedding from embeddings where vec_id % 20 = 0""",
    "q_queries": """select item_id as query_id, item_id % 5 as user_id, text as query_text from benchmark""",
    "q_gold": """select g.item_id as case_id, cast(h.doc_id as <text>) as chunk_id from <anchored> join benchmark g on a.item_id = g.item_id join documents h on a.doc_id = h.doc_id where <holds:h.text, g.text>""",
    "m_messages": """select conv_id * 1000 + turn as id, cast(conv_id as <text>) as conversation_id, conv_id % 5 as user_id, role,
        case when role = 'assistant' then concat(text, ' [', cast(turn % 4 + 1 as <text>), '] [99]') else text end as content,
        <shift:timestamp '2024-01-01 00:00:00', cast(conv_id as int), cast(turn as int)> as created_at, turn from conversations""",
    "p_progress": """select event_id as id, user_id as doc_id, case event_type when 'view' then 'document_created' when 'click' then 'indexed' when 'purchase' then 'graphed'
        when 'signup' then 'ready' else 'failed' end as status, event_type, ts, value from events""",
    "r_requests": """select event_id as id, user_id as key, <epoch:ts> as t from events""",
}
_CASES = " ".join(f"when {i} then '{x}'" for i, x in enumerate(vocab.RELATION_TYPES))


def words(sql: str, dialect: dict[str, str]) -> str:
    """``sql`` with ``<name>`` and ``<name:arg, arg>`` in the words of an engine."""
    sql = sql.replace("<cases>", _CASES)

    def put(m: re.Match) -> str:
        args, depth, parts = m[2] or "", 0, [""]
        for c in args:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                parts.append("")
            else:
                parts[-1] += c
        return dialect[m[1]].format(*(x.strip() for x in parts))

    return re.sub(r"<(\w+)(?::((?:[^<>]|<(?!\w))+))?>", put, sql)


def needed(sql: str) -> list[str]:
    """The views that ``sql`` names, those they name first."""
    found: list[str] = []

    def walk(x: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", x) and name not in found:
                walk(VIEWS[name])
                if name not in found:
                    found.append(name)

    walk(sql)
    return found


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it names in front."""
    own = ", ".join(f"{name} as ({words(VIEWS[name], DUCK)})" for name in needed(sql))
    body = words(sql, DUCK).strip()
    if not own:
        return body
    return f"with recursive {own}, {body[15:].lstrip()}" if body.lower().startswith("with recursive ") else f"with {own}, {body[5:].lstrip()}" if body.lower().startswith("with ") else f"with {own} {body}"


_BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``q_gold``. Passages and the pairs found by their inner words go to where the documents lie, and no text moves."""
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    passages = few(written(spark.sql(_PASSAGES, benchmark=benchmark), "passages"))
    words = documents.select("doc_id", F.split("text", "[ \\n\\t]+").alias("x"))
    cut = F.expr("explode(transform(sequence(1, size(x) - n + 1), i -> xxhash64(array_join(slice(x, i, n), ' '))))").alias("w")
    runs = words.join(F.broadcast(passages.select("n").distinct()), F.expr("size(x) >= n")).select("doc_id", "n", cut)
    short = benchmark.where(F.size(F.split("text", "[ \\n\\t]+")) <= 2).select("item_id")
    pairs = runs.join(passages, ["n", "w"]).select("item_id", "doc_id").distinct().unionByName(F.broadcast(short).crossJoin(documents.select("doc_id")))
    asked = few(written(benchmark.select("item_id", F.col("text").alias("passage")), "asked"), 100_000)
    found = documents.select("doc_id", "text").join(few(written(pairs, "anchored")), "doc_id").join(asked, "item_id").where(F.contains("text", "passage"))
    return written(found.select(F.col("item_id").alias("case_id"), F.col("doc_id").cast("string").alias("chunk_id")), "gold")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the driver, as a DataFrame. Nothing is registered."""
    if name in _BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in _OWN:
        return _OWN[name](spark, sf_dir)
    sql = _OWN_SQL[name]() if name in _OWN_SQL else words(VIEWS[name], SPARK)
    inner = {x: view(spark, sf_dir, x) for x in [*_BASE, *VIEWS] if x != name and re.search(rf"(?:from|join)\s+{x}\b", sql)}
    return spark.sql(re.sub(r"\b(from|join)\s+(" + "|".join(inner) + r")\b", lambda m: f"{m[1]} {{{m[2]}}}" + ("" if re.match(r"\s+(?:\w)\s+(?:on|join|where|$)", sql[m.end() :]) else f" as {m[2]}"), sql), **inner)


def _line_order() -> str:
    """Lines of an order with its user, joined by the numeric key that their window is dealt by, too."""
    return """lineitem join (select o_orderkey, cast(o_orderkey as string) as id, cast(c_nationkey as bigint) as user_id, o_orderdate as created_at from orders join customer on o_custkey = c_custkey) d on l_orderkey = d.o_orderkey"""


def _rewritten(name: str, old: str, new: str) -> str:
    sql = words(VIEWS[name], SPARK)
    assert old in sql, name
    return sql.replace(old, new)


def _steps(order: str = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice") -> str:
    """The lines of ``g_relations`` without the chunks: the next part of an order by the order of its lines."""
    after = f"lead(l_partkey) over (partition by l_orderkey order by {order})"
    return f"(select d.user_id, cast(l_partkey as string) as source, l_partkey as a, {after} as b, cast({after} as string) as target from {_line_order()}) x"


#: Views that Spark makes in another way than their SQL says, with the same rows: fewer and narrower shuffles.
_OWN = {"q_gold": _gold}
_OWN_SQL = {
    "g_chunks": lambda: _rewritten("g_chunks", "lineitem join g_documents d on cast(l_orderkey as string) = d.id", _line_order()),
    "g_relations": lambda: re.sub(r"\(select user_id, cast.* x where", lambda _: f"{_steps()} where", words(VIEWS["g_relations"], SPARK), flags=re.S),
    "g_entities": lambda: """select c.user_id, cast(p_partkey as string) as name, p_type as type, p_name as description from (select distinct p_partkey, p_type, p_name from part) p
        join (select distinct cast(c_nationkey as bigint) as user_id, l_partkey from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey) c on c.l_partkey = p_partkey""",
}
