"""Entities and relations: rules, parsing of model answers, merging and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab
from .ranking import latest

ENTITY = "array<struct<name:string,type:string,description:string>>"
RELATION = "array<struct<source:string,target:string,relation_type:string>>"


def rule_entities(chunks: DataFrame, patterns=vocab.ENTITY_PATTERNS) -> DataFrame:
    """``(user_id, chunk_id, name, type, pattern_no)``: each distinct match once per chunk,
    under the first pattern that finds it."""
    def found(i: int, type_: str, pattern: str) -> Column:
        matches = F.regexp_extract_all("content", F.lit("(?U)" + pattern), F.lit(0))
        return F.transform(matches, lambda x: F.struct(x.alias("name"), F.lit(type_).alias("type"), F.lit(i).cast("long").alias("pattern_no")))

    hits = F.flatten(F.array(*[found(i, t, p) for i, (t, p) in enumerate((t, p) for t, own in patterns.items() for p in own)]))
    rows = chunks.where("content is not null").select("user_id", "chunk_id", F.explode(hits).alias("x")).select("user_id", "chunk_id", "x.*")
    return rows.groupBy("user_id", "chunk_id", "name").agg(F.min_by("type", "pattern_no").alias("type"), F.min("pattern_no").alias("pattern_no"))


def parse_extraction(responses: DataFrame, col: str = "response") -> DataFrame:
    """``responses`` with ``entities`` and ``relations``. Whichever of ``{`` and ``[`` comes
    first picks the shape (an array holds entities only); what doesn't parse gives none.
    Items without a name, or without both ends, are dropped; relation types are normalised."""
    answer = F.coalesce(F.col(col), F.lit(""))
    brace, bracket = F.instr(answer, "{"), F.instr(answer, "[")
    is_object = (brace > 0) & ((bracket == 0) | (brace < bracket))
    parsed = F.when(is_object, F.from_json(text.greedy_object(answer), f"entities {ENTITY}, relations {RELATION}"))
    listed = F.from_json(text.greedy_array(answer), ENTITY)
    good = lambda x: text.blank_to_null(x).isNotNull()
    entities = F.coalesce(parsed["entities"], F.when(~is_object | parsed["relations"].isNull(), listed), F.expr(f"cast(array() as {ENTITY})"))
    relations = F.coalesce(parsed["relations"], F.expr(f"cast(array() as {RELATION})"))
    return responses.withColumn("entities", F.filter(entities, lambda e: e.isNotNull() & good(e["name"]))).withColumn(
        "relations",
        F.transform(F.filter(relations, lambda r: r.isNotNull() & good(r["source"]) & good(r["target"])), lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"), text.normalize_relation_type(r["relation_type"]).alias("relation_type"))),
    )


def local_relations(parsed: DataFrame) -> DataFrame:
    """``(user_id, chunk_id, source, target, relation_type)`` of parsed answers: stripped
    names, no self-relations, both ends among the same chunk's entities."""
    names = F.transform("entities", lambda e: text.strip(e["name"]))
    rows = parsed.select("user_id", "chunk_id", names.alias("names"), F.explode("relations").alias("r"))
    ends = rows.select("user_id", "chunk_id", "names", text.strip(F.col("r.source")).alias("source"), text.strip(F.col("r.target")).alias("target"), F.coalesce(F.col("r.relation_type"), F.lit("MENTIONS")).alias("relation_type"))
    return ends.where((F.col("source") != F.col("target")) & F.array_contains("names", F.col("source")) & F.array_contains("names", F.col("target"))).drop("names")


def combine_entities(rule: DataFrame, model: DataFrame) -> DataFrame:
    """One row per chunk and (lower-case name, type); a model row replaces a rule row."""
    both = rule.select("user_id", "chunk_id", "name", "type", F.lit(None).cast("string").alias("description"), F.lit(1).alias("priority")).unionByName(model.select("user_id", "chunk_id", "name", F.coalesce("type", F.lit("OTHER")).alias("type"), "description", F.lit(0).alias("priority")))
    return latest(both.withColumn("low", F.lower("name")), ["user_id", "chunk_id", "low", "type"], ["priority", "name"]).drop("low", "priority")


def unique_entities(chunk_entities: DataFrame) -> DataFrame:
    """One row per document and (lower-case name, type): the first spelling in chunk order.
    ``(user_id, document_id, ordinal, name, type, ...)``."""
    first = chunk_entities.groupBy("user_id", "document_id", F.lower("name").alias("low"), "type").agg(F.min(F.struct("ordinal", "name")).alias("first"))
    return first.select("user_id", "document_id", F.col("first.name").alias("name"), "type", F.col("first.ordinal").alias("ordinal"))


def parse_names(answer: Column, most: int | None = None) -> Column:
    """The strings of the array in an answer, stripped, without blanks; none if it doesn't
    parse."""
    found = F.filter(F.transform(F.coalesce(F.from_json(text.greedy_array(answer), "array<string>"), F.array().cast("array<string>")), text.strip), lambda x: x.isNotNull() & (x != ""))
    return F.slice(found, 1, most) if most else found


def parse_intent(answer: Column) -> Column:
    """One of the three question kinds; else fact retrieval."""
    found = F.get_json_object(text.greedy_object(answer), "$.intent")
    return F.when(found.isin(*vocab.INTENTS), found).otherwise(vocab.INTENTS[0])


def parse_judgement(answer: Column, keyword_coverage: Column) -> Column:
    """A struct of faithfulness (supported share of the claims), hallucination and three
    scores within [0, 1]; a missing correctness is the keyword coverage."""
    parsed = F.from_json(text.greedy_object(answer), "claims array<struct<supported:boolean>>, answer_relevance double, citation_accuracy double, correctness double")
    claims = F.filter(F.coalesce(parsed["claims"], F.array().cast("array<struct<supported:boolean>>")), lambda c: c["supported"].isNotNull())
    faith = F.when(F.size(claims) > 0, F.size(F.filter(claims, lambda c: c["supported"])) / F.size(claims)).otherwise(0.0)
    bound = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))
    return F.struct(faith.alias("faithfulness"), F.round(1 - faith, 4).alias("hallucination"), bound(parsed["answer_relevance"]).alias("answer_relevance"), bound(parsed["citation_accuracy"]).alias("citation_accuracy"), bound(F.coalesce(parsed["correctness"], keyword_coverage)).alias("correctness"))
