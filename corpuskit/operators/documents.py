"""Documents: sections, chunks, keywords, summaries and the ingest of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskit import runtime
from corpuskit.functions import text as X
from corpuskit.operators import chunking as K
from corpuskit.sources.readers import JSON_DOC, section_path

NO_TEXT_SUMMARY = "Document parsed successfully, but no text content was extracted."


def window_chunks(docs: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """Fixed windows of ``size`` characters that overlap by ``overlap``; one row per window.

    The text is cut once into pieces of ``size - overlap`` characters, so the work is linear in
    its length. A window is a piece with the head of the next one (``overlap <= size / 2``).
    """
    K.check_overlap(size, overlap)
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(.{{1,{size - overlap}}})"), F.lit(1))
    windows = F.transform(
        F.col("_pieces"),
        lambda p, i: F.concat(p, F.substring(F.coalesce(F.get("_pieces", i + 1), F.lit("")), 1, overlap)),
    )
    kept = [c for c in docs.columns if c != text]
    return (
        docs.select(*kept, pieces.alias("_pieces"))
        .select(*kept, F.posexplode(windows).alias("chunk_index", "content"))
        .withColumn("chunk_index", F.col("chunk_index").cast("long"))
    )


def document_summary(docs: DataFrame, chunks: DataFrame, size: int = 500) -> DataFrame:
    """Summary from the first two chunks of each document."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    first = chunks.select("document_id", "chunk_index", "content")
    first = first.withColumn("_r", F.row_number().over(order)).filter("_r <= 2")
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", X.strip(F.col("content")).alias("c")))), lambda s: s.c),
        "\n\n",
    )
    summaries = first.groupBy("document_id").agg(F.substring(X.strip(text), 1, size).alias("summary"))
    return docs.join(summaries, "document_id", "left").withColumn(
        "summary", F.coalesce("summary", F.lit(NO_TEXT_SUMMARY))
    )


def split_markdown_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per section of Markdown documents that has text, in document order."""
    kept = [c for c in docs.columns if c != text]
    found = docs.select(*kept, F.posexplode(K.sections_column(F.col(text))).alias("section_index", "s"))
    return found.select(*kept, F.col("section_index").cast("long").alias("section_index"), "s.title_path", "s.content")


def chunk_text(
    docs: DataFrame, text: str = "text", size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP
) -> DataFrame:
    """One row per chunk of a text, cut at separators, with code fences and tables kept whole."""
    kept = [c for c in docs.columns if c != text]
    found = docs.select(*kept, F.posexplode(K.chunks_column(F.col(text), size, overlap)).alias("chunk_index", "content"))
    return found.withColumn("chunk_index", F.col("chunk_index").cast("long"))


def extract_keywords(chunks: DataFrame, text: str = "content", n: int = K.MAX_KEYWORDS) -> DataFrame:
    """Add the top keywords of each text."""
    return chunks.withColumn("keywords", K.keywords_column(F.col(text), n))


def _parsed(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunks of Markdown (``.md``), JSON (``.json``) and plain text documents with title, path and index.

    A JSON document is cut into its sections, and its own domain and type go before the given ones.
    """
    rest = [c for c in docs.columns if c not in ("text", "extension")]
    is_markdown = F.col("extension") == ".md"
    markdown = split_markdown_sections(docs.filter(is_markdown).drop("extension")).withColumn(
        "title", F.col("title_path")
    )
    markdown = markdown.select(
        *rest,
        "title_path",
        "title",
        "section_index",
        F.posexplode(K.chunks_column(F.col("content"), size, overlap)).alias("part_index", "content"),
    )
    is_json = F.col("extension") == ".json"
    own = docs.filter(is_json).withColumn("_json", F.from_json("text", JSON_DOC))
    own = own.withColumns({c: F.coalesce(f"_json.{c}", c) for c in ("domain", "doc_type") if c in rest})
    sections = own.select(*rest, F.col("_json.title").alias("_title"), F.posexplode("_json.sections").alias("_at", "s"))
    path = section_path(F.col("_title"), F.col("s.heading"))
    sections = sections.filter(F.coalesce("s.content", F.lit("")) != "").select(
        *rest,
        path.alias("title_path"),
        path.alias("title"),
        F.col("_at").cast("long").alias("section_index"),
        F.posexplode(K.chunks_column(F.col("s.content"), size, overlap)).alias("part_index", "content"),
    )
    plain = docs.filter(~F.coalesce(is_markdown | is_json, F.lit(False))).select(
        *rest,
        F.col("doc_id").alias("title_path"),
        F.lit(0).cast("long").alias("section_index"),
        F.posexplode(K.chunks_column(F.col("text"), size, overlap)).alias("part_index", "content"),
    )
    name = F.concat("doc_id", F.lit(" - 片段 "), (F.col("part_index") + 1).cast("string"))
    return markdown.unionByName(sections).unionByName(plain.withColumn("title", name))


def chunk_id(columns: list[str]) -> Column:
    """Stable id of a chunk: owner, source, document within the source, section and part, as far as the rows have them.

    The parts are written as JSON, so no two lists of parts give one text.
    """
    parts = [c for c in ("user_id", "source", "doc_id", "doc_key", "section_index", "part_index") if c in columns]
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def ingest_corpus(docs: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """Knowledge chunks of documents: doc_id, text, extension, domain, doc_type, source.

    Markdown is cut into sections first; other text is chunked as a whole. Ids are stable, so a
    repeated ingest replaces its chunks.
    """
    parsed = extract_keywords(_parsed(docs, size, overlap))
    parsed = parsed.withColumn("chunk_id", chunk_id(parsed.columns))
    return parsed.withColumn("tags", F.array().cast("array<string>"))


def ingest_json_sections(sections: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """Knowledge chunks of the sections that ``scan_json_docs`` reads."""
    kept = [c for c in sections.columns if c != "content"]
    parts = sections.select(
        *kept, F.posexplode(K.chunks_column(F.col("content"), size, overlap)).alias("part_index", "content")
    )
    found = extract_keywords(parts.withColumn("title", F.col("title_path")))
    return found.withColumn("chunk_id", chunk_id(found.columns)).drop("doc_key")


def ingest_user_documents(docs: DataFrame, size: int = 600, overlap: int = 120) -> tuple[DataFrame, DataFrame]:
    """Uploaded documents (document_id, title, text, extension, ...) as (documents, chunks).

    Blank chunks are dropped. A document whose parse gives nothing is chunked as plain text. A
    document without text is marked as failed.
    """
    named = docs.withColumn("doc_id", F.col("document_id").cast("string"))
    source = named.filter("text IS NOT NULL").select("document_id", "doc_id", "text", "extension", F.col("title").alias("name"))
    parsed = _parsed(source, size, overlap).withColumn("content", X.strip(F.col("content")))
    untitled = F.concat("name", F.lit(" - Chunk "), (F.col("part_index") + 1).cast("string"))
    label = F.coalesce(F.nullif("title_path", F.lit("")), F.nullif("title", F.lit("")), untitled)
    found = parsed.filter("content <> ''").select(
        "document_id", "section_index", "part_index", F.substring(label, 1, 255).alias("chunk_title"), "content"
    )
    lost = source.join(found.select("document_id").distinct(), "document_id", "left_anti")
    parts = lost.select(
        "document_id", "name", F.posexplode(K.chunks_column(X.strip(F.col("text")), size, overlap)).alias("part_index", "content")
    )
    fallback = parts.filter(X.strip(F.col("content")) != "").select(
        "document_id",
        F.lit(0).cast("long").alias("section_index"),
        "part_index",
        F.substring("name", 1, 255).alias("chunk_title"),
        X.strip(F.col("content")).alias("content"),
    )
    order = [F.asc("section_index"), F.asc("part_index")]
    chunks = runtime.ranked(found.unionByName(fallback), ["document_id"], order, "_rank")
    chunks = chunks.select("document_id", (F.col("_rank") - 1).alias("chunk_index"), "chunk_title", "content")
    failed = F.col("text").isNull()
    listed = document_summary(docs.withColumn("failed", failed).drop("text", "extension"), chunks)
    documents = listed.withColumns(
        {
            "status": F.when(F.col("failed"), "failed").otherwise("ready"),
            "summary": F.when(F.col("failed"), "Parsing failed: text is missing").otherwise(F.col("summary")),
        }
    ).drop("failed")
    return documents, chunks


def rows_to_markdown_table(rows: DataFrame, group: str, row_index: str = "row_index", cells: str = "cells") -> DataFrame:
    """Markdown lines of tables: (group, row_index, part, line), to be read in that order.

    Rows without any filled cell are left out. The separator follows the first row. Lines stay
    rows, so a table of any size is spread over tasks.
    """
    filled = rows.filter(F.exists(cells, lambda c: X.strip(F.coalesce(c, F.lit(""))) != ""))
    clean = F.transform(cells, lambda c: F.regexp_replace(X.strip(F.coalesce(c, F.lit(""))), "\n", " "))
    line = F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))
    body = filled.select(group, row_index, F.lit(0).alias("part"), line.alias("line"))
    firsts = filled.groupBy(group).agg(F.min(F.struct(F.col(row_index).alias("at"), F.size(cells).alias("n"))).alias("f"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("f.n")), " | "), F.lit(" |"))
    rules = firsts.select(group, F.col("f.at").alias(row_index), F.lit(1).alias("part"), rule.alias("line"))
    return body.unionByName(rules)
