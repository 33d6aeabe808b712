"""The property graph as tables: building, reading, traversal and curation.

Entities are keyed by (user_id, name), mentions by (user_id, chunk_id, entity_name),
relations by (user_id, source, target, relation_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..sources.scratch import few, written
from .ranking import ranked, top

REL = ["user_id", "source", "target", "relation_type"]


def build_graph(documents: DataFrame, chunks: DataFrame, chunk_entities: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """``owns, contains, next, mentions, entities, relations``. Of an entity's rows the
    newest type wins and the newest description that isn't null; a mentioned name without
    an upsert is an entity without type; a relation stays if both ends are entities, with
    the properties of all its rows, later ones first."""
    from .chunking import next_links

    mentions = chunk_entities.select("user_id", "chunk_id", F.col("name").alias("entity_name")).distinct()
    typed = chunk_entities.where("type is not null").groupBy("user_id", "name").agg(
        F.max_by("type", "updated_at").alias("type"), F.max_by("description", F.when(F.col("description").isNotNull(), F.col("updated_at"))).alias("description")
    )
    named = mentions.select("user_id", F.col("entity_name").alias("name")).distinct()
    entities = typed.join(named, ["user_id", "name"], "full_outer")
    ends = entities.select("user_id", "name")
    kept = relations.join(ends.withColumnRenamed("name", "source"), ["user_id", "source"], "left_semi").join(ends.withColumnRenamed("name", "target"), ["user_id", "target"], "left_semi")
    if "properties" in relations.columns:
        items = F.array_sort(F.flatten(F.collect_list(F.transform(F.map_entries("properties"), lambda e: F.struct(e["key"].alias("key"), F.col("updated_at").alias("at"), e["value"].alias("value"))))))
        last = F.aggregate(items, F.expr("cast(map() as map<string,string>)"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))
        kept = kept.groupBy(*REL).agg(last.alias("properties"))
    else:
        kept = kept.select(*REL).distinct()
    return {
        "owns": documents.select("user_id", F.col("id").alias("document_id")).distinct(),
        "contains": chunks.select("user_id", "document_id", "chunk_id").distinct(),
        "next": next_links(chunks),
        "mentions": mentions,
        "entities": entities,
        "relations": kept,
    }


def _grams(low: Column, size: int) -> Column:
    """All pieces of ``size`` characters; null where there are none."""
    return F.when(F.length(low) >= size, F.transform(F.sequence(F.lit(1), F.length(low) - size + 1), lambda i: F.substring(low, i, F.lit(size))))


def names_containing(names: DataFrame, terms: DataFrame, size: int = 3) -> DataFrame:
    """``names(user_id, name, ...)`` with each distinct ``term`` of ``terms(user_id, term)`` that
    the name contains in any case. A term finds its candidates by the rarest of its pieces of
    ``size`` characters (all of a shorter term), so names and terms of a tenant never meet as
    pairs; candidates are then verified. An empty term is in every name, a null one in none."""
    low, asked = F.lower("name"), terms.select("user_id", "term").distinct()
    # names are cut into pieces of those sizes only that a term has
    sizes = sorted(r[0] for r in asked.where("term is not null").select(F.least(F.length(F.lower("term")), F.lit(size))).distinct().collect())
    pieces = F.flatten(F.filter(F.array(*(_grams(low, n) if n else F.array(F.lit("")) for n in sizes or [0])), lambda x: x.isNotNull()))
    parts = asked.select("user_id", "term", F.explode(F.array_distinct(F.coalesce(_grams(F.lower("term"), size), F.array(F.lower("term"))))).alias("gram"))
    held = names.select("*", F.explode(F.array_distinct(pieces)).alias("gram")).join(parts.select("user_id", "gram").distinct(), ["user_id", "gram"], "left_semi")
    counts = held.groupBy("user_id", "gram").agg(F.count("*").alias("n"))
    rarest = parts.join(counts, ["user_id", "gram"], "left").groupBy("user_id", "term").agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
    return held.join(rarest, ["user_id", "gram"]).where(F.contains(F.lower("name"), F.lower("term"))).drop("gram")


#: Terms of at most so many characters are equal to a piece of each name that contains them.
PIECE = 8


def search_entities(entities: DataFrame, terms: DataFrame, limit: int = 20) -> DataFrame:
    """``(user_id, term, name, type, rank)``: names that contain a term of ``terms(user_id,
    term)`` in any case, by name.

    Names are cut into pieces of the lengths that terms have, and each piece keeps its first ``limit`` names, in each
    range of names before any shuffle; terms meet pieces by equality. Terms of more than ``PIECE`` characters
    find their names by their rarest piece of that length (``names_containing``)."""
    low, length = F.lower("name"), F.length(F.lower("term"))
    names = entities.select("user_id", "name", "type")
    asked = terms.where("term is not null").select("user_id", "term")
    sizes = sorted(r[0] for r in asked.select(F.least(length, F.lit(PIECE + 1))).distinct().collect())
    places = names.repartitionByRange("user_id", "name").select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1)))).alias("at"))
    cut = places.select("*", F.explode(F.array(*[F.lit(n) for n in sizes if n <= PIECE]).cast("array<int>")).alias("n")).where(F.col("at") + F.col("n") - 1 <= F.length(low))
    # of equal pieces of a name the first one counts
    pieces = cut.withColumn("gram", F.substring(low, F.col("at"), F.col("n"))).where(F.expr("locate(gram, lower(name)) = at")).select("user_id", "name", "type", "gram")
    cut = top(pieces, ["user_id", "gram"], ["name"], limit)
    cols = ["user_id", "term", "name", "type", "rank"]
    found = cut.join(asked.where(length <= PIECE).distinct().withColumn("gram", F.lower("term")), ["user_id", "gram"]).select(*cols)
    if sizes and sizes[-1] > PIECE:
        found = found.unionByName(top(names_containing(names, asked.where(length > PIECE), PIECE), ["user_id", "term"], ["name"], limit).select(*cols))
    return found


def related_entities(centres: DataFrame, relations: DataFrame, depth: int = 2, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Paths of 1 to ``depth`` relations (1 to 3; else 2) from ``centres(user_id, centre)``
    in either direction, no edge used twice. Rows ``(user_id, centre, hops, end, types)``,
    at most ``limit`` per centre by (hops, end, types); a centre without edges has one row
    without end. Edges report every type on a path as ``(user_id, source = centre,
    relation_type, target = end)``.

    A node's edges are first cut to the ``limit`` that come first (and as many as a path may have used
    already) and kept as one sorted list, so a hub is no larger than any other node and a path goes on
    along its list. Fewer hops come first, so each hop is cut to what a centre still lacks, and a centre
    that has all its rows goes no further."""
    depth = depth if depth in (1, 2, 3) else 2
    if depth == 2:
        cut = _two_hops(centres, relations, limit)
        found = cut.select("user_id", F.col("centre").alias("source"), F.explode("types").alias("relation_type"), F.col("end").alias("target")).distinct()
        return centres.select("user_id", "centre").join(cut, ["user_id", "centre"], "left"), found
    edges = relations.select(*REL).withColumn("edge", F.concat_ws("|", "source", "relation_type", "target"))
    both = edges.select("user_id", F.col("source").alias("a"), F.col("target").alias("b"), "relation_type", "edge").unionByName(edges.where("source <> target").select("user_id", F.col("target").alias("a"), F.col("source").alias("b"), "relation_type", "edge"))
    first = top(both, ["user_id", "a"], ["b", "relation_type", "edge"], limit + depth - 1)
    lists = first.groupBy("user_id", "a").agg(F.array_sort(F.collect_list(F.struct("b", "relation_type", "edge"))).alias("out"))
    if depth > 1:
        lists = written(lists, "adjacency")
    none = F.expr("cast(array() as array<string>)")
    front = centres.select("user_id", "centre", F.col("centre").alias("a"), none.alias("types"), none.alias("used"), F.lit(0).cast("long").alias("had"))
    group = Window.partitionBy("user_id", "centre")
    paths = None
    for hop in range(1, depth + 1):
        step = front.join(lists, ["user_id", "a"])
        ahead = F.slice(F.filter("out", lambda x: ~F.array_contains("used", x["edge"])), 1, limit)
        step = step.select("user_id", "centre", "types", "used", "had", F.explode(ahead).alias("x"))
        step = step.select("user_id", "centre", F.col("x.b").alias("a"), F.concat("types", F.array("x.relation_type")).alias("types"), F.concat("used", F.array("x.edge")).alias("used"), "had")
        found = top(step, ["user_id", "centre"], ["a", "types", "used"], limit).where(F.col("rank") <= limit - F.col("had"))
        found = found.withColumn("had", F.col("had") + F.count("*").over(group)).withColumn("hops", F.lit(hop).cast("long")).drop("rank")
        if hop < depth:
            found = written(found, "hop")
            front = found.where(F.col("had") < limit).drop("hops")
        paths = found if paths is None else paths.unionByName(found)
    cut = paths.select("user_id", "centre", "hops", F.col("a").alias("end"), "types")
    rows = centres.select("user_id", "centre").join(cut, ["user_id", "centre"], "left")
    found = cut.select("user_id", F.col("centre").alias("source"), F.explode("types").alias("relation_type"), F.col("end").alias("target")).distinct()
    return rows, found


def _two_hops(centres: DataFrame, relations: DataFrame, limit: int) -> DataFrame:
    """The paths of ``related_entities`` of depth 2, one shuffle of lists instead of one of paths for each hop.

    A node sends its list along its edges, each time without that edge, and to itself; what reaches a centre is
    all it needs. Lists of up to ``limit`` edges are whole, so their own edges tell where they go; hubs' edges are read
    again. A node with ``limit`` edges has all its rows and is sent nothing."""
    edges = relations.select(*REL)
    # an edge of a node is known by its other end, its type and its direction
    side = lambda a, b, ahead: edges.where(ahead | (F.col("source") != F.col("target"))).select("user_id", F.col(a).alias("a"), F.struct(F.col(b).alias("b"), "relation_type", ahead.alias("ahead")).alias("x"))
    both = written(side("source", "target", F.lit(True)).unionByName(side("target", "source", F.lit(False))), "edges")
    lists = written(top(both, ["user_id", "a"], ["x"], limit + 1).groupBy("user_id", "a").agg(F.sort_array(F.collect_list("x")).alias("out")), "adjacency")
    hubs = written(lists.where(F.size("out") >= limit), "hubs")
    more = few(hubs.where(F.size("out") > limit), 10_000)
    whole = lists.where(F.size("out") <= limit).select("user_id", "out", F.explode("out").alias("x"))
    sent = whole.unionByName(both.join(more, ["user_id", "a"]).select("user_id", "out", "x"))
    full = few(hubs.select("user_id", F.col("a").alias("centre")))
    plain = lambda col: F.transform(col, lambda x: F.struct(x["b"].alias("end"), x["relation_type"].alias("type")))
    others = F.slice(F.filter("out", lambda y: ~y.eqNullSafe(F.col("x"))), 1, limit)
    second = sent.select("user_id", F.col("x.b").alias("centre"), F.lit(2).alias("hops"), F.col("x.relation_type").alias("via"), plain(others).alias("items")).where(F.size("items") > 0)
    second = second.join(full, ["user_id", "centre"], "left_anti")
    first = lists.select("user_id", F.col("a").alias("centre"), F.lit(1).alias("hops"), F.lit(None).cast("string").alias("via"), plain(F.slice("out", 1, limit)).alias("items"))
    reached = first.unionByName(second).join(centres.select("user_id", "centre").distinct(), ["user_id", "centre"], "left_semi")
    types = lambda y: F.when(F.col("hops") == 1, F.array(y["type"])).otherwise(F.array("via", y["type"]))
    paths = F.transform("items", lambda y: F.struct(F.col("hops").cast("long").alias("hops"), y["end"].alias("end"), types(y).alias("types")))
    every = reached.select("user_id", "centre", paths.alias("p")).groupBy("user_id", "centre").agg(F.slice(F.sort_array(F.flatten(F.collect_list("p"))), 1, limit).alias("p"))
    return every.select("user_id", "centre", F.explode("p").alias("p")).select("user_id", "centre", "p.hops", "p.end", "p.types")


def entities_from_chunks(ids: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct entities that ``ids(user_id, chunk_id)`` mention; a null description is
    empty."""
    names = mentions.join(ids, ["user_id", "chunk_id"], "left_semi").select("user_id", F.col("entity_name").alias("name")).distinct()
    return names.join(entities.select("user_id", "name", "type", "description"), ["user_id", "name"], "left").withColumn("description", F.coalesce("description", F.lit("")))


def entity_mentions(entities: DataFrame, mentions: DataFrame, chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """``user_id, name, type, mention_count, document_count`` with ``rank`` by count, then
    name; entities without mentions count 0. Counts are aggregated before any join, so a
    popular entity never gathers its chunks in one place."""
    facts = mentions.join(chunks.select("user_id", "chunk_id", "document_id"), ["user_id", "chunk_id"], "left") if "document_id" not in mentions.columns else mentions
    per_document = facts.groupBy("user_id", F.col("entity_name").alias("name"), "document_id").agg(F.count("*").alias("n"))
    counts = per_document.groupBy("user_id", "name").agg(F.sum("n").alias("mention_count"), F.count("document_id").alias("document_count"))
    found = entities.select("user_id", "name", F.coalesce("type", F.lit("Unknown")).alias("type")).join(counts, ["user_id", "name"], "left").fillna(0, ["mention_count", "document_count"])
    order = [F.desc("mention_count"), "name"]
    return top(found, ["user_id"], order, limit) if limit else ranked(found, ["user_id"], order)


def doc_entities(entities: DataFrame, mentions: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` most mentioned entities of each document: ``mentions(user_id,
    document_id, chunk_id, entity_name)``."""
    counts = mentions.groupBy("user_id", "document_id", F.col("entity_name").alias("name")).agg(F.count("*").alias("mentions"))
    typed = counts.join(entities.select("user_id", "name", "type"), ["user_id", "name"], "left").withColumn("type", F.coalesce("type", F.lit("Unknown")))
    return top(typed, ["user_id", "document_id"], [F.desc("mentions"), "name"], limit)


#: An entity in more documents of a user than this is heavy: no pairs are made of its documents.
HEAVY = 500


def related_documents(documents: DataFrame, mentions: DataFrame, limit: int = 5, heavy: int = HEAVY) -> DataFrame:
    """The ``limit`` other documents of the user with the most distinct entities in common; ties by title
    (the id where there is none), then id.

    Documents that share an entity of at most ``heavy`` documents are joined as pairs (each once, and mirrored), and
    their heavy entities compared as sets. Documents that share heavy entities alone are compared
    by their sets of them, of which only as many documents as a result can hold come into question (see ``_heavy_only``)."""
    facts = mentions.select("user_id", "document_id", "entity_name").distinct()
    titles = documents.select("user_id", F.col("id").alias("other_id"), F.coalesce(F.nullif("title", F.lit("")), "id").alias("title"))
    order = [F.desc("shared"), "title", "other_id"]
    counts = facts.groupBy("user_id", "entity_name").agg(F.count("*").alias("df")).where(F.col("df") > heavy)
    common = written(counts, "common")
    if common.isEmpty():
        both = _pairs(facts).select("user_id", "document_id", "other_id", F.col("light").alias("shared"))
        return top(both.join(titles, ["user_id", "other_id"]), ["user_id", "document_id"], order, limit)
    facts = written(facts, "facts")
    held = facts.join(F.broadcast(common) if common.count() <= 1_000_000 else common, ["user_id", "entity_name"])
    sets = written(held.groupBy("user_id", "document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "entity_name"))), lambda x: x["entity_name"]).alias("held")), "sets")
    light = written(_pairs(facts.join(common.drop("df"), ["user_id", "entity_name"], "left_anti")), "light")
    own = sets.select("user_id", "document_id", F.col("held").alias("a"))
    other = sets.select("user_id", F.col("document_id").alias("other_id"), F.col("held").alias("b"))
    more = F.coalesce(F.size(F.array_intersect("a", "b")), F.lit(0))
    near = light.join(own, ["user_id", "document_id"], "left").join(other, ["user_id", "other_id"], "left").select("user_id", "document_id", "other_id", (F.col("light") + F.when(F.col("a").isNull() | F.col("b").isNull(), 0).otherwise(more)).alias("shared"))
    every = near.join(titles, ["user_id", "other_id"]).unionByName(_heavy_only(sets, titles, limit))
    best = every.where("document_id <> other_id").groupBy("user_id", "document_id", "other_id", "title").agg(F.max("shared").alias("shared"))
    return top(best, ["user_id", "document_id"], order, limit).select("user_id", "other_id", "document_id", "shared", "title", "rank")


def _pairs(facts: DataFrame) -> DataFrame:
    """Pairs of documents with the number of entities they share, in both directions."""
    left, right = facts.withColumnRenamed("document_id", "a"), facts.withColumnRenamed("document_id", "b")
    pairs = left.join(right, ["user_id", "entity_name"]).where("a < b").groupBy("user_id", "a", "b").agg(F.count("*").alias("light"))
    return pairs.select("user_id", F.col("a").alias("document_id"), F.col("b").alias("other_id"), "light").unionByName(pairs.select("user_id", F.col("b").alias("document_id"), F.col("a").alias("other_id"), "light"))


def _heavy_only(sets: DataFrame, titles: DataFrame, limit: int, probe: int = 16, part: int = 1024) -> DataFrame:
    """``(user_id, document_id, other_id, title, shared)``: for each document at least the ``limit`` others that share
    the most heavy entities with it, by (shared, title, id).

    Documents with the same set are alike to all others but for their title, so a set is represented by its first
    ``limit + 1`` documents, and sets are compared instead of documents. A first look at a few large sets of each
    entity tells how many entities the last of the results shares at least (``least``); a set that
    shares so many holds one of the first ``size - least + 1`` entities of the other, rarest first, so only
    those are joined, the sets of an entity in parts of bounded size."""
    key = ["user_id", "set_id"]
    named = sets.withColumn("set_id", F.md5(F.to_json("held")))
    listed = written(named.select(*key, F.col("document_id").alias("other_id")).join(titles, ["user_id", "other_id"]), "listed")
    first = written(top(listed, key, ["title", "other_id"], limit + 1).drop("rank"), "first")
    size = listed.groupBy(*key).agg(F.count("*").alias("n"))
    kinds = written(named.groupBy(*key).agg(F.first("held").alias("held")).join(size, key, "left").fillna(0, ["n"]), "kinds")
    other = kinds.select("user_id", F.col("set_id").alias("other_set"), F.col("held").alias("b"), F.col("n").alias("m"))
    entries = written(other.select("user_id", "other_set", "b", "m", F.explode("b").alias("entity_name")), "entries")
    shared = F.size(F.array_intersect("held", "b")).cast("long").alias("shared")
    mine = kinds.select(*key, "held", "n", F.explode("held").alias("entity_name"))
    looked = mine.join(top(entries, ["user_id", "entity_name"], [F.desc("m"), "other_set"], probe).drop("rank"), ["user_id", "entity_name"]).select(*key, "other_set", "m", shared).distinct()
    looked = looked.unionByName(kinds.select(*key, F.col("set_id").alias("other_set"), F.col("n").alias("m"), F.size("held").cast("long").alias("shared"))).distinct()
    so_far = F.sum("m").over(Window.partitionBy(*key).orderBy(F.desc("shared"), "other_set"))
    # the limit + 1 documents so far include the document itself
    least = looked.withColumn("documents", so_far).where(F.col("documents") > limit).groupBy(*key).agg(F.max("shared").alias("least"))
    bound = kinds.join(least, key, "left").withColumn("least", F.coalesce("least", F.lit(1).cast("long")))
    prefix = bound.select(*key, "held", "least", F.explode(F.slice("held", F.lit(1), (F.size("held") - F.col("least") + 1).cast("int"))).alias("entity_name"))
    parts = written(entries.groupBy("user_id", "entity_name").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")), "parts")
    dealt = entries.join(parts, ["user_id", "entity_name"]).withColumn("part", F.pmod(F.xxhash64("other_set"), F.col("parts")))
    asked = prefix.join(parts, ["user_id", "entity_name"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    met = asked.join(dealt.select("user_id", "entity_name", F.col("part").cast("long").alias("part"), "other_set", "b"), ["user_id", "entity_name", "part"]).select(*key, "other_set", "least", shared).where("shared >= least").distinct()
    reps = first.withColumnRenamed("set_id", "other_set")
    chosen = top(met.join(reps, ["user_id", "other_set"]), key, [F.desc("shared"), "title", "other_id"], limit + 1).select(*key, "other_id", "title", "shared")
    return named.select(*key, "document_id").join(chosen, key).select("user_id", "document_id", "other_id", "title", "shared")


def neighbours(entities: DataFrame, relations: DataFrame, limit: int = 50) -> DataFrame:
    """Distinct neighbours of each entity over relations in both directions."""
    out = relations.select("user_id", F.col("source").alias("name"), F.col("target").alias("other"), "relation_type").union(relations.select("user_id", "target", "source", "relation_type"))
    other = entities.select("user_id", F.col("name").alias("other"), "type")
    found = out.join(other, ["user_id", "other"], "left").select("user_id", "name", "other", F.coalesce("type", F.lit("OTHER")).alias("type"), F.coalesce("relation_type", F.lit("RELATES_TO")).alias("relation_type")).distinct()
    return top(found, ["user_id", "name"], ["other", "relation_type"], limit)


def entity_detail(entities: DataFrame, mentions: DataFrame, relations: DataFrame, documents: DataFrame, chunks: DataFrame, samples: int = 5, preview: int = 240) -> tuple[DataFrame, DataFrame]:
    """Per entity: distinct chunks and documents, incident relations and the first date;
    and its first ``samples`` chunks with a preview."""
    facts = mentions.select("user_id", "document_id", "chunk_id", F.col("entity_name").alias("name")).distinct()
    dated = facts.groupBy("user_id", "name", "document_id").agg(F.count("*").alias("n")).join(documents.select("user_id", F.col("id").alias("document_id"), "created_at"), ["user_id", "document_id"], "left")
    counts = dated.groupBy("user_id", "name").agg(F.sum("n").alias("chunk_count"), F.count("*").alias("document_count"), F.min("created_at").alias("first_seen"))
    ends = relations.select("user_id", F.col("source").alias("name")).unionByName(relations.where("source <> target").select("user_id", F.col("target").alias("name"))).groupBy("user_id", "name").agg(F.count("*").alias("related_count"))
    detail = entities.select("user_id", "name", "type").join(counts, ["user_id", "name"], "left").join(ends, ["user_id", "name"], "left").fillna(0, ["chunk_count", "document_count", "related_count"])
    first = top(facts, ["user_id", "name"], ["chunk_id"], samples)
    return detail, first.join(chunks.select("user_id", "chunk_id", text.clip(F.col("content"), preview).alias("preview")), ["user_id", "chunk_id"])


def graph_view(entities: DataFrame, relations: DataFrame, max_nodes: int = 500, max_edges: int = 2000) -> tuple[DataFrame, DataFrame]:
    """The first entities by name and, of the first relations, those between them."""
    nodes = top(entities.select("user_id", "name", "type"), ["user_id"], ["name"], max_nodes)
    names = nodes.select("user_id", "name")
    edges = top(relations.select(*REL), ["user_id"], ["source", "target", "relation_type"], max_edges)
    edges = edges.join(names.withColumnRenamed("name", "source"), ["user_id", "source"], "left_semi").join(names.withColumnRenamed("name", "target"), ["user_id", "target"], "left_semi")
    return nodes, edges


def entity_categories(entities: DataFrame) -> DataFrame:
    """Entities per category, with the two most frequent raw types."""
    types = entities.groupBy("user_id", F.coalesce("type", F.lit("ENTITY")).alias("type")).agg(F.count("*").alias("n")).withColumn("category", text.category(F.col("type")))
    totals = types.groupBy("user_id", "category").agg(F.sum("n").alias("entities"))
    first = top(types, ["user_id", "category"], [F.desc("n"), "type"], 2).groupBy("user_id", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "type"))), lambda x: x["type"]), ",").alias("top_types"))
    return totals.join(first, ["user_id", "category"])


def update_entities(entities: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``entities`` with ``patches(user_id, name, type, description)`` applied, and the
    patches that were rejected with a reason. Null leaves a field as it is, an empty
    description clears it, a type is upper-cased and must be known."""
    clean = patches.withColumn("new_type", F.upper("type"))
    known = F.col("new_type").isNull() | F.col("new_type").isin(*vocab.ENTITY_TYPES)
    bad = clean.where(~known).select("user_id", "name", F.lit("type").alias("reason"))
    good = clean.where(known)
    lost = good.join(entities, ["user_id", "name"], "left_anti").select("user_id", "name", F.lit("unknown").alias("reason"))
    joined = entities.join(good.select("user_id", "name", "new_type", F.col("description").alias("new_description")), ["user_id", "name"], "left")
    description = F.when(F.col("new_description").isNull(), F.col("description")).otherwise(F.nullif("new_description", F.lit("")))
    return joined.withColumn("type", F.coalesce("new_type", "type")).withColumn("description", description).drop("new_type", "new_description"), bad.unionByName(lost)


def _without(relations: DataFrame, names: DataFrame) -> DataFrame:
    return relations.join(names.withColumnRenamed("name", "source"), ["user_id", "source"], "left_anti").join(names.withColumnRenamed("name", "target"), ["user_id", "target"], "left_anti")


def delete_entities(keys: DataFrame, entities: DataFrame, mentions: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """The three tables without ``keys(user_id, name)``, and ``deleted`` (0 or 1 each)."""
    keys = keys.select("user_id", "name").distinct()
    found = keys.join(entities.select("user_id", "name").distinct().withColumn("n", F.lit(1)), ["user_id", "name"], "left")
    return {
        "entities": entities.join(keys, ["user_id", "name"], "left_anti"),
        "mentions": mentions.join(keys.withColumnRenamed("name", "entity_name"), ["user_id", "entity_name"], "left_anti"),
        "relations": _without(relations, keys),
        "deleted": found.select("user_id", "name", F.coalesce("n", F.lit(0)).cast("long").alias("deleted")),
    }


def final_targets(pairs: DataFrame, rounds: int = 20) -> DataFrame:
    """``pairs(user_id, source, target)`` with chains followed to their end; pairs on or into a cycle
    are left out. A source of several pairs takes the smallest target."""
    step = pairs.where("source <> target").groupBy("user_id", "source").agg(F.min("target").alias("target"))
    now = step
    for _ in range(rounds):  # doubling: chains of up to 2 ** rounds pairs
        ahead = now.select("user_id", F.col("source").alias("target"), F.col("target").alias("next"))
        moved = now.join(ahead, ["user_id", "target"], "left")
        if moved.where("next is not null").isEmpty():
            return now
        now = written(moved.select("user_id", "source", F.coalesce("next", "target").alias("target")).where("source <> target"), "targets")
    return now.join(now.select("user_id", F.col("source").alias("target")), ["user_id", "target"], "left_anti")


def merge_entities(pairs: DataFrame, entities: DataFrame, mentions: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """Each source entity merged into its (final) target: mentions and relations are
    re-pointed and made distinct, relations between the two are dropped, the source goes.
    Pairs whose ends don't both exist are ignored. ``counts`` has the rows touched."""
    names = entities.select("user_id", "name")
    valid = final_targets(pairs).join(names.withColumnRenamed("name", "source"), ["user_id", "source"], "left_semi").join(names.withColumnRenamed("name", "target"), ["user_id", "target"], "left_semi")
    to = valid.select("user_id", F.col("source").alias("name"), F.col("target").alias("into"))
    moved = mentions.join(to.withColumnRenamed("name", "entity_name"), ["user_id", "entity_name"], "left")
    rewritten = moved.withColumn("entity_name", F.coalesce("into", "entity_name"))
    out = relations.select(*REL).join(to.select("user_id", F.col("name").alias("source"), F.col("into").alias("s2")), ["user_id", "source"], "left").join(to.select("user_id", F.col("name").alias("target"), F.col("into").alias("t2")), ["user_id", "target"], "left")
    new_source, new_target = F.coalesce("s2", "source"), F.coalesce("t2", "target")
    changed = F.col("s2").isNotNull() | F.col("t2").isNotNull()
    kept = out.where(~changed | (new_source != new_target)).select("user_id", new_source.alias("source"), new_target.alias("target"), "relation_type").distinct()
    touched = (
        to.select("user_id", "name", F.lit("deleted").alias("what"))
        .unionByName(mentions.join(to.withColumnRenamed("name", "entity_name"), ["user_id", "entity_name"]).select("user_id", F.col("entity_name").alias("name"), F.lit("mentions_rewritten").alias("what")))
        .unionByName(out.where("s2 is not null").where(new_source != new_target).select("user_id", F.col("source").alias("name"), F.lit("outgoing").alias("what")))
        .unionByName(out.where("t2 is not null").where(new_source != new_target).select("user_id", F.col("target").alias("name"), F.lit("incoming").alias("what")))
    )
    counts = touched.groupBy("user_id", "name", "what").agg(F.count("*").alias("n"))
    return {"entities": entities.join(to, ["user_id", "name"], "left_anti"), "mentions": rewritten.drop("into").distinct(), "relations": kept, "counts": counts}


def delete_documents(ids: DataFrame, documents: DataFrame, chunks: DataFrame, mentions: DataFrame, entities: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """All tables without ``ids(user_id, document_id)``. Entities that only those documents
    mentioned go with their relations; entities that others mention too keep everything."""
    ids = ids.select("user_id", "document_id").distinct()
    gone = chunks.join(ids, ["user_id", "document_id"], "left_semi").select("user_id", "chunk_id")
    left = mentions.join(gone, ["user_id", "chunk_id"], "left_anti")
    named = mentions.join(gone, ["user_id", "chunk_id"], "left_semi").select("user_id", F.col("entity_name").alias("name")).distinct()
    orphans = named.join(left.select("user_id", F.col("entity_name").alias("name")), ["user_id", "name"], "left_anti")
    return {
        "documents": documents.join(ids.withColumnRenamed("document_id", "id"), ["user_id", "id"], "left_anti"),
        "chunks": chunks.join(ids, ["user_id", "document_id"], "left_anti"),
        "mentions": left,
        "entities": entities.join(orphans, ["user_id", "name"], "left_anti"),
        "relations": _without(relations, orphans),
        "orphans": orphans,
    }


def purge_users(users: DataFrame, tables: dict[str, DataFrame], dry_run: bool = False) -> dict[str, DataFrame]:
    """Every table without the rows of ``users(user_id)``; a dry run gives, for each table,
    the number of rows of each user that would go."""
    users = users.select("user_id").distinct()
    if dry_run:
        return {name: t.join(users, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n")) for name, t in tables.items()}
    return {name: t.join(users, "user_id", "left_anti") for name, t in tables.items()}
