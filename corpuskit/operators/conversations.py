"""Messages, conversation memory and long-term memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpuskit import runtime
from corpuskit.functions import text as X
from corpuskit.functions.json_columns import json_structs, safe_json_list, safe_json_object

REF = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def _newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("message_id")]


def _oldest_first() -> list[Column]:
    return [F.asc("created_at"), F.asc("message_id")]


def parse_messages(messages: DataFrame) -> DataFrame:
    """Decode the JSON columns of messages; a wrong shape becomes an empty value."""
    meta = safe_json_object(F.col("runtime_meta_json"))
    return messages.withColumns(
        {
            "refs": json_structs(F.col("refs_json"), REF),
            "tool_traces": safe_json_list(F.try_element_at(meta, F.lit("tool_traces"))),
            "resource_refs": safe_json_list(F.try_element_at(meta, F.lit("resource_refs"))),
            "metadata": safe_json_object(F.try_element_at(meta, F.lit("metadata"))),
        }
    ).drop("refs_json", "runtime_meta_json")


def last_n_messages(messages: DataFrame, n: int = 12) -> DataFrame:
    """User and assistant messages among the last ``n`` of each session; ``n <= 0`` takes all."""
    if n > 0:
        order = Window.partitionBy("session_id").orderBy(*_newest_first())
        messages = messages.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")
    return messages.filter(F.col("role").isin("user", "assistant"))


def short_term_window(messages: DataFrame, max_turns: int = 10) -> DataFrame:
    """Transcript of the last ``2 x max_turns`` messages per session."""
    order = Window.partitionBy("session_id").orderBy(*_newest_first())
    line = F.concat(F.lit("["), F.upper("role"), F.lit("]: "), F.col("content"))
    kept = messages.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= 2 * max_turns)
    lines = F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("at"), line.alias("line"))))
    return kept.groupBy("session_id").agg(
        F.count("*").alias("messages"), F.array_join(F.transform(lines, lambda s: s.line), "\n").alias("transcript")
    )


def round_text(question: Column, answer: Column) -> Column:
    return F.concat(
        F.lit("用户: "), X.head_tail_summary(question, 100), F.lit("\n助手: "), X.head_tail_summary(answer, 150)
    )


def conversation_rounds(messages: DataFrame, group_limit: int = runtime.GROUP_ROW_LIMIT) -> DataFrame:
    """A round per assistant message that answers a user message.

    The pending question is the user message right before it, other roles left aside.
    """
    talk = messages.filter(F.col("role").isin("user", "assistant")).select(
        "session_id", "message_id", "created_at", "role", "content"
    )
    paired = runtime.with_previous(
        talk, ["session_id"], _oldest_first(), ["message_id", "role", "content"], group_limit
    )
    closes = (F.col("role") == "assistant") & (F.col("prev_role") == "user") & (F.col("prev_content") != "")
    return paired.filter(closes).select(
        "session_id",
        F.col("prev_message_id").alias("user_message_id"),
        "message_id",
        "created_at",
        round_text(F.col("prev_content"), F.col("content")).alias("text"),
    )


def latest_user_query(messages: DataFrame) -> DataFrame:
    """Latest user message of each session."""
    asked = messages.filter(F.col("role") == "user")
    latest = F.max_by(F.struct("message_id", "content"), F.struct("created_at", "message_id"))
    return (
        asked.groupBy("session_id")
        .agg(latest.alias("m"))
        .select("session_id", F.col("m.message_id").alias("message_id"), F.col("m.content").alias("query_text"))
    )


def session_listing(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with their number of messages, per user by latest update."""
    counts = messages.groupBy("session_id").agg(F.count("*").alias("message_count"))
    return (
        sessions.join(counts, "session_id", "left")
        .withColumn("message_count", F.coalesce("message_count", F.lit(0).cast("long")))
        .orderBy("user_id", F.desc("updated_at"), F.desc("session_id"))
    )


def filter_memory(memories: DataFrame, tag: str | None = None, memory_type: str | None = None) -> DataFrame:
    if tag:
        memories = memories.filter(F.col("tag") == tag)
    if memory_type:
        memories = memories.filter(F.col("type") == memory_type)
    return memories


def memory_stats(memories: DataFrame, top_tags: int = 10) -> DataFrame:
    """Total, count per type and the most frequent tags, as (section, name, count) rows."""

    def counts(section: str, column: str) -> DataFrame:
        name = F.coalesce(column, F.lit("(none)")).alias("name")
        return memories.groupBy(name).agg(F.count("*").alias("count")).select(F.lit(section).alias("section"), "name", "count")

    total = memories.agg(F.count("*").alias("count")).select(
        F.lit("total").alias("section"), F.lit("total").alias("name"), "count"
    )
    tags = counts("tag", "tag").orderBy(F.desc("count"), "name").limit(top_tags)
    return total.unionByName(counts("type", "type")).unionByName(tags)


def user_memory_count(memories: DataFrame) -> DataFrame:
    return memories.groupBy("user_id").agg(F.count("*").alias("count"))


def recent_memories(memories: DataFrame, n: int = 5) -> DataFrame:
    """Newest ``n`` memories of each user."""
    order = Window.partitionBy("user_id").orderBy(F.desc("timestamp"), F.desc("memory_id"))
    return memories.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
