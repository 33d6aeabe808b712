"""Dashboards, timelines, tags and listings per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .graph import doc_entities, entity_mentions, related_documents
from .ranking import ranked, top


def documents_by_month(documents: DataFrame) -> DataFrame:
    return documents.where("created_at is not null").groupBy("user_id", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("documents"))


def recent_documents(documents: DataFrame, limit: int = 10) -> DataFrame:
    return top(documents, ["user_id"], [F.desc("created_at"), "id"], limit)


def entity_timeline(entities: DataFrame, mentions: DataFrame, documents: DataFrame, most: int = 500, keep: int = 200) -> DataFrame:
    """The ``most`` mentioned entities with the first live document that mentions them:
    newest first, then by mentions and name, the first ``keep``. Without a live document
    ``first_seen`` is null and ``doc_count`` 0; the mentions stay."""
    counts = mentions.groupBy("user_id", F.col("entity_name").alias("name")).agg(F.count("*").alias("mention_count"))
    head = top(entities.select("user_id", "name", "type").join(counts, ["user_id", "name"], "left").fillna(0, ["mention_count"]), ["user_id"], [F.desc("mention_count"), "name"], most).drop("rank")
    live = mentions.select("user_id", F.col("entity_name").alias("name"), "document_id").distinct().join(documents.select("user_id", F.col("id").alias("document_id"), "created_at", "title"), ["user_id", "document_id"])
    first = live.groupBy("user_id", "name").agg(F.count("*").alias("doc_count"), F.min(F.struct("created_at", "document_id", "title")).alias("first"))
    rows = head.join(first, ["user_id", "name"], "left").select("user_id", "name", "type", "mention_count", F.coalesce("doc_count", F.lit(0)).alias("doc_count"), F.col("first.created_at").alias("first_seen"), F.col("first.document_id").alias("first_document"), F.col("first.title").alias("first_title"))
    return top(rows, ["user_id"], [F.desc_nulls_last("first_seen"), F.desc("mention_count"), "name"], keep)


def visible_curve(timeline: DataFrame) -> DataFrame:
    """For each day of a user's range: entities first seen by then. ``first_seen`` is a
    date; nulls are left out. A running sum over the days stands for the range join."""
    days = timeline.where("first_seen is not null").groupBy("user_id", F.to_date("first_seen").alias("day")).agg(F.count("*").alias("new"))
    spine = days.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("user_id", F.explode(F.sequence("a", "b")).alias("day"))
    running = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(days, ["user_id", "day"], "left").select("user_id", "day", F.sum(F.coalesce("new", F.lit(0))).over(running).alias("visible"))


def visible_at(timeline: DataFrame, day: Column) -> DataFrame:
    """Entities of the timeline first seen on or before a date."""
    return timeline.where(F.to_date("first_seen") <= day)


def date_range(timeline: DataFrame) -> DataFrame:
    """First and last date of each user and the number of days, at least 1."""
    span = timeline.where("first_seen is not null").groupBy("user_id").agg(F.min(F.to_date("first_seen")).alias("first_day"), F.max(F.to_date("first_seen")).alias("last_day"))
    return span.withColumn("days", F.greatest(F.lit(1), F.date_diff("last_day", "first_day") + 1).cast("long"))


def hero_counts(users: DataFrame, **tables: DataFrame) -> DataFrame:
    """Rows of each table per user, one column for each, 0 where there are none. ``tags``
    counts distinct tags."""
    out = users.select("user_id").distinct()
    for name, t in tables.items():
        n = F.count_distinct("tag") if name == "tags" else F.count("*")
        out = out.join(t.groupBy("user_id").agg(n.alias(name)), "user_id", "left")
    return out.fillna(0, list(tables))


def recent_activity(documents: DataFrame, messages: DataFrame, each: int = 8, keep: int = 10) -> DataFrame:
    """One feed of a user's newest documents and messages, documents first on ties."""
    docs = top(documents, ["user_id"], [F.desc("created_at"), "id"], each).select("user_id", F.lit("document").alias("kind"), F.col("id").cast("string").alias("item_id"), F.coalesce(F.nullif("title", F.lit("")), "original_filename").alias("title"), F.lit(None).cast("string").alias("snippet"), "created_at", F.lit(0).alias("side"))
    said = top(messages, ["user_id"], [F.desc("created_at"), F.desc("id")], each).select("user_id", F.lit("message").alias("kind"), F.col("id").cast("string").alias("item_id"), F.col("conversation_id").alias("title"), text.activity_snippet(F.col("content")).alias("snippet"), "created_at", F.lit(1).alias("side"))
    return top(docs.unionByName(said), ["user_id"], [F.desc("created_at"), "side", "item_id"], keep).drop("side")


def top_entities(entities: DataFrame, mentions: DataFrame, chunks: DataFrame, limit: int = 10) -> DataFrame:
    return entity_mentions(entities, mentions, chunks, limit)


def tag_cloud(tags: DataFrame, contains: str | None = None, limit: int | None = None) -> DataFrame:
    """Documents per normalised tag, most first; blank tags don't count."""
    clean = tags.withColumn("tag", text.normalize_tag(F.col("tag"))).where("tag is not null").select("user_id", "document_id", "tag").distinct()
    if contains:
        clean = clean.where(F.contains(F.col("tag"), F.lit(contains.lower())))
    counts = clean.groupBy("user_id", "tag").agg(F.count("*").alias("documents"))
    return top(counts, ["user_id"], [F.desc("documents"), "tag"], limit) if limit else ranked(counts, ["user_id"], [F.desc("documents"), "tag"])


def monthly_growth(documents: DataFrame, users: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """The last ``months`` calendar months up to ``as_of`` of every user, gaps as 0; only
    documents of the last ``months`` months count."""
    end = F.lit(as_of).cast("timestamp_ntz")
    spine = users.select("user_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(months - 1)))).select("user_id", F.date_format(F.add_months(F.trunc(F.lit(as_of).cast("date"), "month"), -F.col("k")), "yyyy-MM").alias("month"))
    since = F.expr(f"timestamp_ntz '{as_of}' - interval {months} months")
    return spine.join(documents_by_month(documents.where((F.col("created_at") >= since) & (F.col("created_at") <= end))), ["user_id", "month"], "left").fillna(0, ["documents"])


def document_list(documents: DataFrame, tags: DataFrame, offset: int = 0, limit: int = 20, tag: str | None = None) -> DataFrame:
    """A page of each user's documents, newest first, with their tags in order."""
    clean = tags.withColumn("tag", text.normalize_tag(F.col("tag"))).where("tag is not null").distinct()
    rows = documents
    if tag and tag.strip():
        wanted = clean.where(F.col("tag") == text.normalize_tag(F.lit(tag))).select("user_id", F.col("document_id").alias("id"))
        rows = rows.join(wanted, ["user_id", "id"], "left_semi")
    page = ranked(rows, ["user_id"], [F.desc("created_at"), "id"]).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    held = clean.groupBy("user_id", F.col("document_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return page.join(held, ["user_id", "id"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def document_detail(documents: DataFrame, tags: DataFrame, chunks: DataFrame, entities: DataFrame, mentions: DataFrame, preview: int = 400) -> DataFrame:
    """Per document: tags, number of chunks, the first three chunks, its top entities and its
    related documents by rank (``entities``, ``related``), and how many of them there are."""
    key = ["user_id", "document_id"]
    counts = chunks.groupBy(*key).agg(F.count("*").alias("chunk_count"))
    first = top(chunks, key, ["ordinal"], 3).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", text.clip(F.col("content"), preview).alias("x")))), lambda s: s["x"]).alias("previews"))
    held = tags.withColumn("tag", text.normalize_tag(F.col("tag"))).where("tag is not null").groupBy(*key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    listed = lambda col: F.transform(F.array_sort(F.collect_list(F.struct("rank", col))), lambda s: s[col])
    named = doc_entities(entities, mentions).groupBy(*key).agg(F.count("*").alias("top_entities"), listed("name").alias("entities"))
    near = related_documents(documents, mentions).groupBy(*key).agg(F.count("*").alias("related_documents"), listed("other_id").alias("related"))
    out = documents.withColumnRenamed("id", "document_id")
    for t in (counts, first, held, named, near):
        out = out.join(t, key, "left")
    none = F.array().cast("array<string>")
    return out.fillna(0, ["chunk_count", "top_entities", "related_documents"]).withColumns({x: F.coalesce(x, none) for x in ("tags", "previews", "entities", "related")})


def document_chunks(requests: DataFrame, documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of the requested ``(user_id, document_id)`` in order, with their path; and the
    requests for documents that don't exist."""
    known = documents.select("user_id", F.col("id").alias("document_id"))
    rows = chunks.join(requests, ["user_id", "document_id"], "left_semi").withColumn("path", text.split_path(F.col("hierarchy_path")))
    return rows, requests.join(known, ["user_id", "document_id"], "left_anti")


def apply_tags(tags: DataFrame, documents: DataFrame, adds: DataFrame, removes: DataFrame) -> DataFrame:
    """``tags`` after the removals and the additions; blank tags and documents of others are
    rejected, repeats change nothing."""
    key = ["user_id", "document_id", "tag"]
    clean = lambda t: t.withColumn("tag", text.normalize_tag(F.col("tag"))).where("tag is not null").select(*key).distinct()
    owned = clean(adds).join(documents.select("user_id", F.col("id").alias("document_id")), ["user_id", "document_id"], "left_semi")
    return clean(tags).join(clean(removes), key, "left_anti").unionByName(owned).distinct()


def rejected_tags(adds: DataFrame, documents: DataFrame) -> DataFrame:
    """The additions that ``apply_tags`` rejects, with the ``reason``: ``blank`` or ``document`` (unknown, or of another user)."""
    known = documents.select("user_id", F.col("id").alias("document_id")).withColumn("known", F.lit(True))
    joined = adds.join(known, ["user_id", "document_id"], "left").select("user_id", "document_id", "tag", F.when(text.normalize_tag(F.col("tag")).isNull(), "blank").when(F.col("known").isNull(), "document").alias("reason"))
    return joined.where("reason is not null").distinct()


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Each conversation with its number of messages and its last one, latest first."""
    last = messages.groupBy("user_id", "conversation_id").agg(F.count("*").alias("messages"), F.max_by("content", F.struct("created_at", "id")).alias("last_message"), F.max("created_at").alias("last_activity"))
    rows = conversations.join(last, ["user_id", "conversation_id"], "left").fillna(0, ["messages"])
    return ranked(rows, ["user_id"], [F.desc(F.coalesce("last_activity", "created_at")), "conversation_id"])


def conversation_summary(listed: DataFrame, as_of: str, keyword: str = "", days: int = 7) -> DataFrame:
    """Per user: conversations, messages, those active in the last ``days`` and those whose
    title or last message has the keyword in any case."""
    since = F.expr(f"timestamp_ntz '{as_of}' - interval {days} days")
    hit = F.contains(F.lower(F.concat_ws("\n", "title", "last_message")), F.lit(keyword.lower()))
    active = F.coalesce("last_activity", "created_at") >= since
    return listed.groupBy("user_id").agg(F.count("*").alias("conversations"), F.sum("messages").alias("messages"), F.count_if(active).alias("active"), F.count_if(hit).alias("matching"))
