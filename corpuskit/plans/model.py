"""Model tables derived from the driver tables, in Spark and in DuckDB SQL.

Every table covers all source rows and whole texts. ``with_sql`` puts the CTEs that a query
needs in front of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit import runtime
from corpuskit.operators.documents import document_summary, window_chunks

SQL_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
EPOCH = 1_704_067_200
CHUNK_SIZE, CHUNK_STEP = 600, 480

SQL: dict[str, str] = {
    # documents: the newest document has the highest id
    "raw_docs": """
        SELECT doc_id AS document_id, doc_id % 10 AS user_id, source AS domain, lang,
               'doc ' || doc_id AS title, text, doc_id AS newest, true AS is_published
        FROM documents""",
    "chunks": f"""
        SELECT document_id, document_id * 100000 + i AS chunk_id, i AS chunk_index,
               domain || ' > ' || lang AS chunk_title, substring(text, i * 480 + 1, 600) AS content
        FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / 480.0) AS BIGINT))) AS i FROM raw_docs)""",
    "summaries": f"""
        SELECT document_id, substring(trim(string_agg(trim(content, {SQL_WS}), chr(10) || chr(10)
               ORDER BY chunk_index), {SQL_WS}), 1, 500) AS summary
        FROM chunks WHERE chunk_index < 2 GROUP BY document_id""",
    "docs": "SELECT d.*, s.summary FROM raw_docs d JOIN summaries s USING (document_id)",
    "candidates": """
        SELECT c.*, d.user_id, d.domain, d.newest, d.title AS document_title, d.summary,
               d.title || chr(10) || d.summary || chr(10) || c.chunk_title || chr(10) || c.content AS search_text
        FROM chunks c JOIN docs d USING (document_id)""",
    "queries": "SELECT item_id AS query_id, item_id % 10 AS user_id, text AS query_text FROM benchmark",
    "messages": """
        SELECT conv_id AS session_id, conv_id * 100 + turn AS message_id, turn, role, text AS content,
               conv_id % 10 AS user_id FROM conversations""",
}


def with_sql(names: str, body: str) -> str:
    """``WITH`` the named model tables (in order, separated by blanks) in front of ``body``."""
    tables = ", ".join(f"{n} AS ({SQL[n]})" for n in names.split())
    return f"WITH {tables} {body}"


DOC_SQL = "raw_docs chunks summaries docs candidates queries"


def sql_tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9_]{{2,}}')"


def sql_md5_bucket(text: str) -> str:
    """md5 modulo 384 from the four 32-bit words of the digest (2**32 = 256 modulo 384)."""
    words = [f"('0x' || substr(md5({text}), {1 + 8 * i}, 8))::BIGINT" for i in range(4)]
    return f"((256 * ({words[0]} + {words[1]} + {words[2]}) + {words[3]}) % 384)"


def sql_features(source: str, key: str, text: str) -> str:
    """(key, bucket, weight): hashed 3-grams and words of a text, counted per bucket."""
    grams = (
        f"SELECT {key}, unnest(list_transform(range(1, len(cs) - 1), lambda i: cs[i] || cs[i+1] || cs[i+2])) AS g "
        f"FROM (SELECT {key}, regexp_extract_all({text}, '(?s).') AS cs FROM {source})"
    )
    words = (
        f"SELECT {key}, w AS g FROM (SELECT {key}, unnest(regexp_split_to_array({text}, '\\s+')) AS w FROM {source}) "
        "WHERE w <> ''"
    )
    return (
        f"SELECT {key}, {sql_md5_bucket('g')} AS bucket, CAST(sum(n) AS DOUBLE) AS weight FROM "
        f"(SELECT {key}, g, count(*) AS n FROM ({grams} UNION ALL {words}) GROUP BY ALL) GROUP BY ALL"
    )


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; the text tables, whose rows are costly to process, use all cores."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return runtime.spread(df) if name in ("documents", "pages") else df


def raw_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"),
        (F.col("doc_id") % 10).alias("user_id"),
        F.col("source").alias("domain"),
        "lang",
        F.concat(F.lit("doc "), F.col("doc_id")).alias("title"),
        "text",
        F.timestamp_seconds(F.col("doc_id") + EPOCH).alias("created_at"),
        F.lit(True).alias("is_published"),
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    windows = window_chunks(raw_docs(spark, sf), "text", CHUNK_SIZE, CHUNK_SIZE - CHUNK_STEP)
    return windows.select(
        "document_id",
        (F.col("document_id") * 100_000 + F.col("chunk_index")).alias("chunk_id"),
        "chunk_index",
        F.concat_ws(" > ", "domain", "lang").alias("chunk_title"),
        "content",
    )


def docs(spark: SparkSession, sf: str) -> DataFrame:
    base = raw_docs(spark, sf)
    return document_summary(base.drop("text"), chunks(spark, sf))


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), (F.col("item_id") % 10).alias("user_id"), F.col("text").alias("query_text")
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("message_id"),
        F.timestamp_seconds(F.col("turn") + EPOCH).alias("created_at"),
        "role",
        F.col("text").alias("content"),
        (F.col("conv_id") % 10).alias("user_id"),
    )
