"""The operators as queries over the driver's tables, and DuckDB SQL where it can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, langid, merkle, mixing, near_dedup, packing, pii, quality, token_shards, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(remainder(3) != 1).select("doc_id", "text", "lang"))
    return langid.predict(docs, model).select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.shards(table(spark, sf_dir, "documents")).select("slot", "shard", "doc_id", "start", "n_tokens", "ids_crc32", "byte_offset")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False).drop("bucket")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(remainder(5) != 0)
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    return found.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), when=remainder(7) == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_top_k": op2_top_k,
    "op3_token_shards": op3_token_shards,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_divergence": op11_divergence,
    "op12_contamination": op12_contamination,
    "op13_merkle": op13_merkle,
}

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_TOP_K = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
  p as (select q.vec_id as query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::bigint as score from v q join v d on q.vec_id <> d.vec_id and len(q.v) = len(d.v) where q.vec_id % 50 = 0),
  r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5"""

_WARC = """with p as (select page_id, encode(coalesce(html, '')) as body, sha1(coalesce(html, '')) as hex from pages),
  b as (select *, array_to_string(list_transform(range(40), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', substr(hex, i::int + 1, 1))]), '') as bits from p),
  f as (select hex, min(page_id) as first from p group by hex)
select page_id, octet_length(body)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: case when substr(bits, (5 * i + j + 1)::int, 1) = '1' then (16 >> j::int) else 0 end))::int, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from b join f on b.hex = f.hex"""

_QUALITY = f"""with d as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
  w as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as i from d),
  g as (select doc_id, i, concat_ws(' ', word, lead(word, 1) over o, lead(word, 2) over o, lead(word, 3) over o, lead(word, 4) over o) as gram, lead(word, 4) over o as fifth from w window o as (partition by doc_id order by i)),
  twice as (select doc_id, gram from g where fifth is not null group by 1, 2 having count(*) > 1),
  covered as (select distinct g.doc_id, g.i + k as i from g join twice t on g.doc_id = t.doc_id and g.gram = t.gram, (select unnest(range(5)) as k) r where fifth is not null),
  again as (select doc_id, count(*) as n from covered group by 1),
  l as (select doc_id, source, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))) as line from d),
  dup as (select doc_id, count(*) - count(distinct line) as n from l group by 1),
  norm as (select doc_id, source, translate(array_to_string(regexp_extract_all(line, '{_WORD}'), ' '), '{_UPPER}', '{_LOWER}') as line, len(regexp_extract_all(line, '{_WORD}')) as n from l),
  lw as (select doc_id, source, line, sum(n) as n from norm group by 1, 2, 3),
  m0 as (select d.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(dup.n, 0) as n_dup_lines, coalesce(again.n, 0) as n_repeat_words from d left join dup using (doc_id) left join again using (doc_id)),
  m as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m0),
  common as (select source, line from lw group by 1, 2 having count(*) > 10),
  held as (select lw.*, m.n_words from lw join common c on lw.source is not distinct from c.source and lw.line = c.line join m on m.doc_id = lw.doc_id where not base_failed),
  k1 as (select *, min(doc_id) over (partition by source, line) as keeper from held),
  d1 as (select doc_id, 100 * sum(case when keeper <> doc_id then n else 0 end) > 70 * any_value(n_words) as depleted from k1 group by 1),
  k2 as (select h.*, first_value(h.doc_id) over (partition by h.source, h.line order by depleted, h.doc_id) as keeper from held h join d1 using (doc_id)),
  lost as (select doc_id, sum(case when keeper <> doc_id then n else 0 end)::bigint as n, bool_or(keeper = doc_id) as keeps from k2 group by 1)
select m.*, coalesce(lost.n, 0) as n_removed_words, not base_failed and (coalesce(keeps, false) or 100 * coalesce(lost.n, 0) <= 70 * n_words) as kept from m left join lost using (doc_id)"""

_NEAR = f"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') as ws from documents),
  s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i::int + 1 : i::int + 5], ' ')) end) as x from d),
  e as (select doc_id, len(x) as n, unnest(x) as x from s),
  p as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as both_ from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
  links as (select a, b from p where 100 * both_ >= 85 * (na + nb - both_)),
  step as (select a, b from links union all select b, a from links),
  reach(doc_id, to_id) as (select doc_id, doc_id from d union select r.doc_id, s.b from reach r join step s on r.to_id = s.a),
  c as (select doc_id, min(to_id) as component_id from reach group by 1)
select s.doc_id, len(x)::bigint as n_shingles, component_id, s.doc_id = component_id as kept from s join c on s.doc_id = c.doc_id"""

_TERMS = r"regexp_extract_all({0}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
_DIVERGENCE = f"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as text from documents),
  w as (select r, lang, source, unnest({_TERMS.format("text")}) as term from d),
  t as (select lang, term, count(*) as total from w group by 1, 2 having count(distinct r) >= 3),
  v as (select g.lang, count(term) as v, coalesce(sum(total), 0)::hugeint as n from (select distinct lang from d) g left join t on t.lang = g.lang group by 1),
  c as (select w.lang, w.source, w.term, count(*) as n from w join t on t.lang = w.lang and t.term = w.term group by 1, 2, 3),
  g as (select x.lang, x.source, coalesce(sum(c.n), 0)::hugeint as n from (select distinct lang, source from d) x left join c on c.lang = x.lang and c.source = x.source group by 1, 2),
  p as (select g.lang, g.source, t.term, coalesce(c.n, 0) as count, (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.n + v.v))::bigint as p, (1 + (1000000000::hugeint * (t.total + 1)) // (v.n + v.v))::bigint as q
    from g join v on v.lang = g.lang join t on t.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = t.term),
  pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
  every as (select a.lang, a.source, b.source as item from g a join g b on a.lang = b.lang and a.source <> b.source),
  x as (select e.lang, e.source, 'pair' as part, e.item, coalesce(value, 0) as value from every e left join pairs s on s.lang = e.lang and s.source = e.source and s.item = e.item
    union all select lang, source, 'term', term, ((p - q) * (p - q)) // q from p where count > 0 and p > q),
  r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from x)
select * from r where part = 'pair' or rank <= 200"""

_WINDOWS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CONTAMINATION = f"""with d as (select row_number() over () as r, doc_id, {_WINDOWS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as ws from documents),
  i as (select item_id, {_WINDOWS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as ws from benchmark),
  g as (select distinct item_id, least(len(ws), 10) as w, unnest(case when len(ws) = 0 then [] else list_transform(range(greatest(len(ws) - 9, 1)), lambda k: array_to_string(ws[k::int + 1 : k::int + 10], ' ')) end) as gram from i),
  s as (select r, w, unnest(range(1, len(ws) - w + 2)) as pos, unnest(list_transform(range(1, len(ws) - w + 2), lambda k: array_to_string(ws[k::int : k::int + w::int - 1], ' '))) as gram from d, (select distinct w from g) x where len(ws) >= w),
  found as (select r, pos, s.w, item_id from s join g on s.w = g.w and s.gram = g.gram),
  hit as (select r, count(distinct pos + k) as n from (select r, pos, unnest(range(w)) as k from (select distinct r, pos, w from found) z) y group by 1),
  named as (select r, count(distinct item_id) as n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from found group by 1)
select doc_id, len(ws) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(named.n, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated from d left join hit on hit.r = d.r left join named on named.r = d.r"""

_FIELD = "coalesce(octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar, '-')"
_LEAF = " || ".join(_FIELD.format(x) for x in ("doc_id", "source", "lang", "n_chars", "text"))
_CHANGED = _LEAF.replace("n_chars", "(n_chars + 1)")
_CRC32 = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: list_concat([ord(c)::bigint], list_transform(range(8), lambda k: -1::bigint))))),
    lambda x, y: case when y >= 0 then xor(x, y) when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end), 4294967295)"""
_MERKLE = f"""with recursive e as (select row_number() over () as r, doc_id, lang, sha256({_LEAF}) as leaf, case when {_CRC32} % 7 = 0 then sha256({_CHANGED}) end as changed from documents),
  d as (select *, dense_rank() over (order by lang nulls first) - 1 as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from e),
  low(tree, lvl, i, n, h) as (select tree, 0, pos, count(*) over (partition by tree), leaf from d
    union all select tree, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from low where n > 1 group by tree, lvl, i // 2, n),
  top(lvl, i, n, h) as (select 0, tree, count(*) over (), h from low where n = 1
    union all select lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from top where n > 1 group by lvl, i // 2, n),
  steps as (select r, v.lvl, case when s.h is null then '-' when (pos >> v.lvl) % 2 = 1 then 'L' || s.h else 'R' || s.h end as x from d join (select distinct tree, lvl from low where n > 1) v on v.tree = d.tree left join low s on s.tree = d.tree and s.lvl = v.lvl and s.i = xor(pos >> v.lvl, 1)
    union all select r, 1000 + v.lvl, case when s.h is null then '-' when (tree >> v.lvl) % 2 = 1 then 'L' || s.h else 'R' || s.h end from d, (select distinct lvl from top where n > 1) v left join top s on s.lvl = v.lvl and s.i = xor(tree >> v.lvl, 1)),
  w as (select r, list(x order by lvl) as xs from steps group by 1),
  f as (select d.*, low.h as subroot, top.h as root, sha256(coalesce(array_to_string(list_transform(xs, lambda x: substr(x, 2)), ''), '')) as proof_sha256,
    list_reduce(list_concat([coalesce(changed, leaf)], coalesce(xs, [])), lambda a, x: case when x = '-' then sha256(a) when x[1] = 'L' then sha256(substr(x, 2) || a) else sha256(a || substr(x, 2)) end) as folded_root
    from d join low on low.tree = d.tree and low.n = 1 join top on top.n = 1 left join w on w.r = d.r)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from f"""

#: Tokenization, trained models, span positions and Newton steps are beyond SQL.
ORACLES: dict[str, str] = {"op2_top_k": _TOP_K, "op4_warc": _WARC, "op5_quality": _QUALITY, "op8_near_duplicates": _NEAR, "op11_divergence": _DIVERGENCE, "op12_contamination": _CONTAMINATION, "op13_merkle": _MERKLE}
