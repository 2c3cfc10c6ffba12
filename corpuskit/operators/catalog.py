"""Listings and statistics over documents, chunks and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskit import runtime
from corpuskit.functions import text as X
from corpuskit.operators.retrieval import COLLECTIONS

# --- fixed values -----------------------------------------------------------
SUPPORTED_EXTENSIONS = (".md", ".json", ".txt", ".docx", ".pptx", ".pdf", ".xlsx", ".xls")
# -----------------------------------------------------------------------------


def filter_supported_ext(files: DataFrame, path: str = "path") -> DataFrame:
    """Files whose extension can be read, with the extension in lower case."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return files.withColumn("extension", suffix).filter(F.col("extension").isin(*SUPPORTED_EXTENSIONS))


def with_chunk_count(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    return docs.join(counts, "document_id", "left").withColumn(
        "chunk_count", F.coalesce("chunk_count", F.lit(0).cast("long"))
    )


def document_listing(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Public columns of the documents, per user newest first."""
    public = ["title", "domain", "size", "chunk_count", "created_at", "summary", "status", "is_published"]
    listed = with_chunk_count(docs, chunks).select("user_id", F.col("document_id").alias("id"), *public)
    return listed.orderBy("user_id", F.desc("created_at"), F.desc("id"))


def document_outline(chunks: DataFrame, group_limit: int = runtime.GROUP_ROW_LIMIT) -> DataFrame:
    """Title and summary of every chunk that has text; numbers count the blank ones too."""
    numbered = runtime.ranked(chunks, ["document_id"], [F.asc("chunk_id")], "position", group_limit)
    untitled = F.concat(F.lit("Section "), F.col("position").cast("string"))
    return numbered.filter(X.strip(F.col("content")) != "").select(
        "document_id",
        "position",
        F.coalesce(F.nullif("chunk_title", F.lit("")), untitled).alias("title"),
        X.snippet(F.col("content"), 160).alias("summary"),
    )


def list_user_documents(docs: DataFrame, n: int = 10) -> DataFrame:
    """Newest ``n`` documents of each user."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("document_id"))
    summary = F.substring(F.coalesce("summary", F.lit("")), 1, 160)
    return (
        docs.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select(
            "user_id",
            "rank",
            "document_id",
            "title",
            F.coalesce(F.nullif(summary, F.lit("")), F.lit("暂无摘要")).alias("snippet"),
            F.lit(1.0).alias("score"),
        )
    )


def user_document_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("user_id").agg(
        F.count("*").alias("count"), F.count_if(F.col("status") == "ready").alias("ready_count")
    )


def collection_stats(chunks: DataFrame) -> DataFrame:
    """Rows per collection and in total; empty collections count 0."""
    is_in = [F.count_if(F.col("collection") == name).alias(name) for name in COLLECTIONS]
    counts = chunks.agg(*is_in, F.count("*").alias("total"))
    names = [*COLLECTIONS, "total"]
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return counts.selectExpr(f"stack({len(names)}, {pairs}) AS (collection, count)")


def list_knowledge(
    chunks: DataFrame, collection: str | None = None, domain: str | None = None, limit: int | None = None
) -> DataFrame:
    """Chunks with a one-line preview, sorted by collection, title and id."""
    if collection:
        chunks = chunks.filter(F.col("collection") == collection)
    if domain:
        chunks = chunks.filter(F.col("domain") == domain)
    title = F.coalesce(F.nullif("title_path", F.lit("")), F.nullif("title", F.lit("")), F.lit("-"))
    listed = chunks.select(
        "collection", "chunk_id", title.alias("title"), "domain", X.preview(F.col("content"), 100).alias("preview")
    ).orderBy("collection", "title", "chunk_id")
    return listed.limit(limit) if limit else listed


def jobs_by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("count"))
