"""Incremental ingestion: a micro-batch of documents becomes rows of all tables, or none of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..operators.chunking import chunk_documents
from ..operators.extract import rule_entities
from ..operators.graph import build_graph
from ..operators.ranking import latest
from ..operators.vectors import embed, feature_hashing
from ..sources.scratch import written
from ..sources.store import KEY, Store
from ..sources.tables import clean_markdown

SCHEMAS = {
    "documents": "user_id long, document_id string, version long, title string, status string, error_message string",
    "chunks": "user_id long, document_id string, chunk_id string, ordinal long, content string, level int, hierarchy_path string, parent_id string, prev_chunk_id string, next_chunk_id string",
    "vectors": "user_id long, document_id string, chunk_id string, embedding array<float>",
    "chunk_entities": "user_id long, document_id string, chunk_id string, name string, type string",
}


def target(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    """The tables that ``ingest`` fills."""
    return Store(spark, path, SCHEMAS, buckets)


def prepared(docs: DataFrame, model: str = "hash", dim: int = 64, embedder=feature_hashing, max_bytes: int = vocab.MAX_BYTES) -> dict[str, DataFrame]:
    """The rows of ``docs(user_id, document_id, version, original_filename, content)`` in all tables. A document
    that is blank, too large or without a vector for each chunk has failed: it has a row in
    ``documents`` that says why, and no others."""
    why = F.when(text.strip(F.coalesce("content", F.lit(""))) == "", "blank").when(F.octet_length("content") > max_bytes, "size")
    known = docs.withColumn("reason", why)
    clean = clean_markdown(known.where("reason is null"))
    chunks = written(chunk_documents(clean.select(*KEY, "content")), "chunks")
    cache = chunks.sparkSession.createDataFrame([], "text_hash string, embedding array<float>, model string")
    vectors = written(embed(chunks.select(*KEY, "chunk_id", "content"), "content", cache, model, dim, embedder)[0].select(*KEY, "chunk_id", "embedding"), "vectors")
    broken = written(vectors.where("embedding is null").select(*KEY).distinct(), "broken")
    whole = lambda df: df.join(broken, KEY, "left_anti")
    titles = clean.select(*KEY, "title")
    docs_ = known.select(*KEY, "version", "reason").join(titles, KEY, "left").join(broken.withColumn("no_vector", F.lit("embedding")), KEY, "left")
    error = F.coalesce("reason", "no_vector")
    entities = rule_entities(chunks).join(chunks.select(*KEY, "chunk_id"), ["user_id", "chunk_id"])
    return {
        "documents": docs_.select(*KEY, "version", "title", F.when(error.isNull(), "ready").otherwise(vocab.FAILED).alias("status"), error.alias("error_message")),
        "chunks": whole(chunks),
        "vectors": whole(vectors),
        "chunk_entities": whole(entities).select(*KEY, "chunk_id", "name", "type"),
    }


def ingest(batch: DataFrame, name: str, store: Store, **options) -> list[int]:
    """One micro-batch into ``store``; returns the buckets it rewrote. Of a document's rows in the batch the
    highest version counts; one that isn't newer than the stored document changes nothing, so neither a repeated batch
    nor the order of batches matters. All tables change in one commit."""
    own = latest(batch.where("document_id is not null and user_id is not null"), KEY, [F.desc_nulls_last("version"), F.desc_nulls_last(F.xxhash64("content"))])
    held = store.read("documents").select(*KEY, F.col("version").alias("stored"))
    fresh = written(own.join(held, KEY, "left").where("stored is null or version > stored").drop("stored"), "fresh")
    return store.commit(name, fresh, prepared(fresh, **options))


def graph_of(store: Store) -> dict[str, DataFrame]:
    """The graph of what is stored (see ``build_graph``)."""
    chunks = store.read("chunks")
    named = store.read("chunk_entities").withColumn("description", F.lit(None).cast("string")).withColumn("updated_at", F.lit(0))
    none = chunks.sparkSession.createDataFrame([], "user_id long, source string, target string, relation_type string")
    return build_graph(store.read("documents").where("status = 'ready'").withColumnRenamed("document_id", "id"), chunks, named, none)


def ingest_stream(docs: DataFrame, store: Store, checkpoint: str, **options):
    """A stream of documents into ``store``, batch by batch. After a failure the same batch is given again under the
    same name: it is either committed, and skipped, or not there at all."""
    return docs.writeStream.foreachBatch(lambda batch, number: ingest(batch, f"{checkpoint}#{number}", store, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
