"""Reading files, tables and gold cases; writing chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..operators.ranking import latest, unused

SCHEMAS = {
    "users": "id long, username string, created_at timestamp",
    "documents": "id string, user_id long, title string, file_path string, original_filename string, file_type string, status string, error_message string, created_at timestamp, updated_at timestamp",
    "chunks": "chunk_id string, document_id string, user_id long, content string, hierarchy_path string, level int, prev_chunk_id string, next_chunk_id string, created_at timestamp, ordinal long, start_line int, end_line int, parent_id string, path array<string>",
    "embedding_cache": "text_hash string, text string, embedding array<float>, model string, created_at timestamp",
    "conversations": "id string, user_id long, title string, created_at timestamp",
    "messages": "id long, conversation_id string, role string, content string, created_at timestamp",
    "message_sources": "message_id long, chunk_id string, rank int",
    "message_feedback": "message_id long, user_id long, conversation_id string, rating string, note string, created_at timestamp",
    "document_tags": "document_id string, user_id long, tag string, created_at timestamp",
    "progress_history": "id long, doc_id string, user_id long, stage string, message string, percent int, is_complete int, is_error int, error_message string, entity_count int, relation_count int, created_at timestamp",
    "chunk_vectors": "chunk_id string, content string, embedding array<float>, user_id string, document_id string, hierarchy_level string, hierarchy_path string, prev_chunk_id string, next_chunk_id string",
    "entities": "user_id long, name string, type string, description string, updated_at timestamp",
    "mentions": "user_id long, chunk_id string, entity_name string",
    "relations": "user_id long, source string, target string, relation_type string, properties map<string,string>, updated_at timestamp",
    "next_links": "user_id long, from_chunk string, to_chunk string",
    "queries": "user_id long, query_id string, variant_no int, query_text string, embedding array<float>",
}
GOLD = "id string, query string, expected_chunk_ids array<string>, expected_keywords array<string>, expected_answer string, difficulty string, tags array<string>, metadata map<string,string>, _comment string"


def load_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    """Parquet tables with their fixed schemas. Columns that older files lack are null; a
    null document status reads as pending and a null change time as the creation time."""
    found = {name: spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet") for name in names}
    if "documents" in found:
        found["documents"] = found["documents"].withColumn("status", F.coalesce("status", F.lit("pending"))).withColumn("updated_at", F.coalesce("updated_at", "created_at"))
    return found


def classify_files(files: DataFrame, max_bytes: int = vocab.MAX_BYTES) -> DataFrame:
    """``files(path, content)`` with ``extension``, ``text`` and ``reason`` (null: taken in):
    the extension must be known, the size within the limit, the first bytes must fit the
    extension, and a text must not be blank. Bytes that aren't UTF-8 are left out."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring("content", 1, 8))
    pdf = F.contains(F.hex(F.substring("content", 1, 1024)), F.lit("25504446"))
    office = head.startswith("504B0304") | head.startswith("504B0506") | (head == "D0CF11E0A1B11AE1")
    plain = ext.isin("txt", "md", "markdown")
    body = F.when(plain, F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")))
    rows = files.withColumn("extension", ext).withColumn("text", body)
    bad = (
        F.when(~ext.isin(*vocab.EXTENSIONS), "extension")
        .when(F.octet_length("content") > max_bytes, "size")
        .when((ext == "pdf") & ~pdf | ext.isin("doc", "docx") & ~office, "content")
        .when(plain & (text.strip(F.col("text")) == ""), "blank")
    )
    return rows.withColumn("reason", bad)


def read_files(spark: SparkSession, path: str, max_bytes: int = vocab.MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Accepted files and rejected ones with a reason, from a folder and those below it."""
    rows = classify_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), max_bytes)
    return rows.where("reason is null").drop("reason", "content"), rows.where("reason is not null").select("path", "extension", "reason")


def clean_markdown(df: DataFrame, col: str = "content", filename: str = "original_filename") -> DataFrame:
    """``df`` with a cleaned text and a ``title``: its first top-level heading or the file
    name. Runs of blank lines shrink before CR LF becomes LF, so CRLF runs stay."""
    clean = text.strip(F.regexp_replace(F.regexp_replace(F.col(col), "\n{3,}", "\n\n"), "\r\n", "\n"))
    title = F.nullif(text.strip(F.regexp_extract(F.col(col), r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    return df.withColumn(col, clean).withColumn("title", F.coalesce(title, F.col(filename)))


def read_gold(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Cases, one JSON file each, and those skipped as placeholders. A comment joins the
    metadata (a list of lines with spaces), missing lists are empty."""
    raw = spark.read.schema(GOLD).json(folder, multiLine=True, recursiveFileLookup=True)
    lines = F.from_json("_comment", "array<string>")
    comment = F.when(F.col("_comment").startswith("["), F.array_join(lines, " ")).otherwise(F.col("_comment"))
    none = F.array().cast("array<string>")
    held = F.coalesce("metadata", F.expr("cast(map() as map<string,string>)"))
    cases = raw.withColumn("metadata", F.when(comment.isNotNull(), F.map_concat(F.map_filter(held, lambda k, _: k != "_comment"), F.create_map(F.lit("_comment"), comment))).otherwise(held)).drop("_comment")
    for name in ("expected_chunk_ids", "expected_keywords", "tags"):
        cases = cases.withColumn(name, F.coalesce(name, none))
    holder = F.exists("expected_chunk_ids", lambda x: x.startswith("REPLACE_WITH"))
    return cases.where(~holder), cases.where(holder)


def upsert_chunks(new: DataFrame, existing: DataFrame, keep: str = "new", order: str = "updated_at") -> DataFrame:
    """One row per chunk id: the newest (``keep="new"``) or the oldest row."""
    side = unused(existing.select("*", *(F.lit(0).alias(x) for x in new.columns if x not in existing.columns)), "side")
    rows = existing.withColumn(side, F.lit(0)).unionByName(new.withColumn(side, F.lit(1)), allowMissingColumns=True)
    newest = keep == "new"
    return latest(rows, ["chunk_id"], [F.desc(side), F.desc(order)] if newest else [F.asc(side), F.asc(order)]).drop(side)


def rebuild_vectors(chunks: DataFrame, cache: DataFrame, model: str, store: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vector rows of the chunks whose text is in the cache, the chunks that miss it, and the
    ids in the store that no longer belong there. Blank chunks are left out."""
    filled = chunks.where(F.trim(F.coalesce("content", F.lit(""))) != "").withColumn("text_hash", F.md5("content"))
    known = cache.where(F.col("model") == model).dropDuplicates(["text_hash"]).select("text_hash", "embedding")
    joined = filled.join(known, "text_hash", "left")
    ready = joined.where("embedding is not null").withColumn("hierarchy_path", F.array_join(text.split_path(F.col("hierarchy_path")), ", ")).drop("text_hash")
    return ready, joined.where("embedding is null").select("user_id", "chunk_id"), store.select("chunk_id").join(ready, "chunk_id", "left_anti")


def write_table(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Parquet in folders by a hash of user and document, so no user fills one alone."""
    key = [x for x in ("user_id", "document_id") if x in df.columns]
    df.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(path)
