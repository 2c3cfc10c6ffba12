"""Listings, statistics, conversations, memories and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import text as X
from corpuskit.operators import catalog as C
from corpuskit.operators import conversations as V
from corpuskit.operators import retrieval as R
from corpuskit.plans import model as M
from corpuskit.plans.registry import query

WS = M.SQL_WS

# documents with a size and a status; the document without chunks has a blank text
LISTED = "raw_docs chunks summaries docs"
STATUS_SQL = "CASE WHEN length(text) < 300 THEN 'failed' WHEN lang = 'de' THEN 'parsing' ELSE 'ready' END"


def listed_docs(spark, sf):
    text = F.length("text")
    status = F.when(text < 300, "failed").when(F.col("lang") == "de", "parsing").otherwise("ready")
    own = M.raw_docs(spark, sf).select("document_id", text.cast("long").alias("size"), status.alias("status"))
    return M.docs(spark, sf).join(own, "document_id")


COUNTED_SQL = """
  , counts AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1)
"""


@query(
    "with_chunk_count",
    M.with_sql(
        LISTED,
        COUNTED_SQL
        + """SELECT document_id, coalesce(n, 0)::BIGINT AS chunk_count FROM (SELECT document_id FROM docs
            UNION ALL SELECT -1 - document_id FROM docs) LEFT JOIN counts USING (document_id)""",
    ),
)
def with_chunk_count(spark, sf):
    docs = M.raw_docs(spark, sf)
    without = docs.withColumn("document_id", -1 - F.col("document_id"))
    return C.with_chunk_count(docs.unionByName(without), M.chunks(spark, sf)).select("document_id", "chunk_count")


@query(
    "document_listing",
    M.with_sql(
        LISTED,
        f""", counts AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1)
        SELECT user_id, document_id AS id, title, domain, length(text)::BIGINT AS size, n AS chunk_count,
               strftime(make_timestamp((newest + {M.EPOCH}) * 1000000), '%Y-%m-%dT%H:%M:%S') AS created_at, summary,
               {STATUS_SQL} AS status, is_published FROM docs JOIN counts USING (document_id)""",
    ),
)
def document_listing(spark, sf):
    listed = C.document_listing(listed_docs(spark, sf), M.chunks(spark, sf))
    return listed.withColumn("created_at", X.iso_timestamp(F.col("created_at")))


@query(
    "document_outline",
    M.with_sql(
        "raw_docs chunks",
        f"""SELECT document_id, chunk_index + 1 AS position,
             CASE WHEN chunk_index % 3 = 0 THEN 'Section ' || (chunk_index + 1) ELSE chunk_title END AS title,
             substring(content, 1, 160) AS summary FROM chunks
           WHERE trim(CASE WHEN chunk_index % 5 = 4 THEN chr(10) ELSE content END, {WS}) <> ''""",
    ),
)
def document_outline(spark, sf):
    chunks = M.chunks(spark, sf).withColumns(
        {
            "chunk_title": F.when(F.col("chunk_index") % 3 == 0, "").otherwise(F.col("chunk_title")),
            "content": F.when(F.col("chunk_index") % 5 == 4, "\n").otherwise(F.col("content")),
        }
    )
    return C.document_outline(chunks)


@query(
    "list_user_documents",
    M.with_sql(
        LISTED,
        """SELECT user_id, rank, document_id, title, substring(summary, 1, 160) AS snippet, 1.0::DOUBLE AS score FROM
        (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY newest DESC) AS rank FROM docs) WHERE rank <= 10""",
    ),
)
def list_user_documents(spark, sf):
    return C.list_user_documents(M.docs(spark, sf), 10)


@query(
    "user_document_stats",
    M.with_sql(
        "raw_docs",
        f"""SELECT user_id, count(*) AS count, count(*) FILTER ({STATUS_SQL} = 'ready') AS ready_count
            FROM raw_docs GROUP BY 1""",
    ),
)
def user_document_stats(spark, sf):
    return C.user_document_stats(listed_docs(spark, sf))


# documents as chunks of the three collections; nothing is stored as a case
DOC_TYPE_SQL = "CASE lang WHEN 'de' THEN 'rule' WHEN 'fr' THEN 'faq' ELSE 'knowledge' END"


def typed_chunks(spark, sf):
    doc_type = F.when(F.col("lang") == "de", "rule").when(F.col("lang") == "fr", "faq").otherwise("knowledge")
    return M.table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("text").alias("content"),
        F.col("source").alias("domain"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat_ws(" > ", "source", "lang")).alias("title_path"),
        F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.concat(F.lit("doc "), "doc_id")).alias("title"),
        doc_type.alias("doc_type"),
        R.collection_of(doc_type).alias("collection"),
    )


@query(
    "collection_stats",
    f"""
    WITH t AS (SELECT CASE {DOC_TYPE_SQL} WHEN 'rule' THEN 'rules' WHEN 'case' THEN 'cases' ELSE 'knowledge' END AS c
               FROM documents)
    SELECT 'knowledge' AS collection, count(*) FILTER (c = 'knowledge') AS count FROM t
    UNION ALL SELECT 'rules', count(*) FILTER (c = 'rules') FROM t
    UNION ALL SELECT 'cases', count(*) FILTER (c = 'cases') FROM t UNION ALL SELECT 'total', count(*) FROM t""",
)
def collection_stats(spark, sf):
    return C.collection_stats(typed_chunks(spark, sf))


@query(
    "list_knowledge",
    """SELECT CASE lang WHEN 'de' THEN 'rules' ELSE 'knowledge' END AS collection, doc_id AS chunk_id,
         CASE WHEN doc_id % 6 = 0 THEN '-' WHEN doc_id % 3 = 0 THEN 'doc ' || doc_id ELSE source || ' > ' || lang
         END AS title, source AS domain, substring(replace(text, chr(10), ' '), 1, 100)
         || CASE WHEN length(text) > 100 THEN '...' ELSE '' END AS preview
       FROM documents""",
)
def list_knowledge(spark, sf):
    return C.list_knowledge(typed_chunks(spark, sf))


@query(
    "filter_supported_ext",
    """
    WITH f AS (SELECT page_id, '/files/' || page_id || ['.md', '.DOC', '.Pdf', '', '.html', '.TXT', '.xlsx'][
                        (page_id % 7 + 1)::INTEGER] AS path FROM pages)
    SELECT page_id, path, lower(regexp_extract(path, '([.][a-zA-Z]+)$', 1)) AS extension FROM f
    WHERE page_id % 7 IN (0, 2, 5, 6)""",
)
def filter_supported_ext(spark, sf):
    endings = F.array(*[F.lit(e) for e in (".md", ".DOC", ".Pdf", "", ".html", ".TXT", ".xlsx")])
    ending = F.element_at(endings, (F.col("page_id") % 7 + 1).cast("int"))
    files = M.table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("/files/"), F.col("page_id").cast("string"), ending).alias("path")
    )
    return C.filter_supported_ext(files)


# --- conversations ---


@query(
    "parse_messages",
    M.with_sql(
        "messages",
        """SELECT message_id, role, CASE WHEN message_id % 4 = 1 THEN 0 ELSE 1 END AS n_refs,
             CASE WHEN message_id % 4 <> 1 THEN content END AS ref_snippet,
             CASE WHEN message_id % 4 = 2 THEN 0 ELSE 2 END AS n_traces, 0 AS n_resources,
             CASE WHEN message_id % 4 <> 2 THEN role END AS mode FROM messages""",
    ),
)
def parse_messages(spark, sf):
    ref = F.struct(
        F.col("message_id").cast("string").alias("document_id"),
        F.col("role").alias("title"),
        F.col("content").alias("snippet"),
        F.lit(0.5).alias("score"),
    )
    meta = F.struct(
        F.array(F.lit("search"), F.lit("read")).alias("tool_traces"),
        F.lit("none").alias("resource_refs"),
        F.struct(F.col("role").alias("mode")).alias("metadata"),
    )
    raw = M.messages(spark, sf).withColumns(
        {
            "refs_json": F.when(F.col("message_id") % 4 == 1, F.to_json(ref)).otherwise(F.to_json(F.array(ref))),
            "runtime_meta_json": F.when(F.col("message_id") % 4 == 2, "{broken").otherwise(F.to_json(meta)),
        }
    )
    return V.parse_messages(raw).select(
        "message_id",
        "role",
        F.size("refs").alias("n_refs"),
        F.get("refs", 0)["snippet"].alias("ref_snippet"),
        F.size("tool_traces").alias("n_traces"),
        F.size("resource_refs").alias("n_resources"),
        F.try_element_at("metadata", F.lit("mode")).alias("mode"),
    )


@query(
    "last_n_messages",
    M.with_sql(
        "messages",
        """SELECT session_id, message_id, role, content FROM
        (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS r FROM messages)
        WHERE r <= 5 AND role IN ('user', 'assistant')""",
    ),
)
def last_n_messages(spark, sf):
    return V.last_n_messages(M.messages(spark, sf), 5).select("session_id", "message_id", "role", "content")


@query(
    "short_term_window",
    M.with_sql(
        "messages",
        """SELECT session_id, count(*) AS messages,
             string_agg('[' || upper(role) || ']: ' || content, chr(10) ORDER BY turn) AS transcript FROM
        (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS r FROM messages)
        WHERE r <= 4 GROUP BY 1""",
    ),
)
def short_term_window(spark, sf):
    return V.short_term_window(M.messages(spark, sf), 2)


def _cut_sql(text: str, n: int, head: int, tail: int) -> str:
    return f"CASE WHEN length({text}) <= {n} THEN {text} ELSE left({text}, {head}) || '...' || right({text}, {tail}) END"


ROUNDS_SQL = f"""
  , seen AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER w AS user_turn,
                    max(CASE WHEN role = 'assistant' THEN turn END) OVER w AS answer_turn FROM messages
             WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  rounds AS (SELECT a.session_id, a.user_id, u.message_id AS user_message_id, a.message_id,
      '用户: ' || {_cut_sql('u.content', 100, 70, 27)} || chr(10) || '助手: ' || {_cut_sql('a.content', 150, 105, 42)} AS text
    FROM seen a JOIN messages u ON u.session_id = a.session_id AND u.turn = a.user_turn
    WHERE a.role = 'assistant' AND a.user_turn > coalesce(a.answer_turn, -1) AND u.content <> '')
"""


@query(
    "conversation_rounds",
    M.with_sql("messages", ROUNDS_SQL + "SELECT session_id, user_message_id, message_id, text FROM rounds"),
)
def conversation_rounds(spark, sf):
    return V.conversation_rounds(M.messages(spark, sf)).drop("created_at")


@query(
    "latest_user_query",
    M.with_sql(
        "messages",
        """SELECT session_id, arg_max(message_id, turn) AS message_id, arg_max(content, turn) AS query_text
           FROM messages WHERE role = 'user' GROUP BY 1""",
    ),
)
def latest_user_query(spark, sf):
    return V.latest_user_query(M.messages(spark, sf))


@query(
    "session_listing",
    """
    SELECT c.conv_id AS session_id, conv_id % 10 AS user_id, 'session ' || conv_id AS title,
           count(*) FILTER (role <> 'system') AS message_count FROM conversations c GROUP BY conv_id""",
)
def session_listing(spark, sf):
    messages = M.messages(spark, sf)
    sessions = messages.groupBy("session_id", "user_id").agg(F.max("created_at").alias("updated_at"))
    sessions = sessions.withColumn("title", F.concat(F.lit("session "), "session_id"))
    return V.session_listing(sessions, messages.filter("role <> 'system'")).drop("updated_at")


# --- memories and jobs from events ---


def memories(spark, sf):
    return M.table(spark, sf, "events").select(
        F.col("event_id").alias("memory_id"),
        "user_id",
        F.col("event_type").alias("tag"),
        F.when(F.col("value") >= 1, F.concat(F.lit("t"), (F.col("value") % 3).cast("int"))).alias("type"),
        F.col("ts").alias("timestamp"),
    )


MEMORY_SQL = """memories AS (SELECT event_id AS memory_id, user_id, event_type AS tag, ts,
  CASE WHEN value >= 1 THEN 't' || floor(value % 3)::INTEGER END AS type FROM events)"""


@query(
    "filter_memory",
    f"WITH {MEMORY_SQL} SELECT memory_id, tag, type FROM memories WHERE tag = 'click' AND type = 't1'",
)
def filter_memory(spark, sf):
    return V.filter_memory(memories(spark, sf), "click", "t1").select("memory_id", "tag", "type")


@query(
    "memory_stats",
    f"""WITH {MEMORY_SQL} SELECT 'total' AS section, 'total' AS name, count(*) AS count FROM memories
    UNION ALL SELECT 'type', coalesce(type, '(none)'), count(*) FROM memories GROUP BY 2
    UNION ALL (SELECT 'tag', tag, count(*) AS n FROM memories GROUP BY 2 ORDER BY n DESC, tag LIMIT 10)""",
)
def memory_stats(spark, sf):
    return V.memory_stats(memories(spark, sf))


@query("user_memory_count", "SELECT user_id, count(*) AS count FROM events GROUP BY 1")
def user_memory_count(spark, sf):
    return V.user_memory_count(memories(spark, sf))


@query(
    "recent_memories",
    f"""WITH {MEMORY_SQL} SELECT user_id, memory_id, tag, rank FROM (SELECT *, row_number() OVER
        (PARTITION BY user_id ORDER BY ts DESC, memory_id DESC) AS rank FROM memories) WHERE rank <= 5""",
)
def recent_memories(spark, sf):
    return V.recent_memories(memories(spark, sf), 5).select("user_id", "memory_id", "tag", "rank")


STATUSES = {"view": "queued", "signup": "queued", "click": "claimed", "purchase": "completed", "error": "failed"}
JOB_STATUS_SQL = (
    "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUSES.items()) + " ELSE 'queued' END"
)


def jobs(spark, sf):
    return M.table(spark, sf, "events").select(
        F.col("event_id").alias("job_id"),
        F.col("event_type").alias("job_type"),
        F.expr(JOB_STATUS_SQL).alias("status"),
        F.concat(F.lit("k"), "user_id").alias("idempotency_key"),
        F.col("ts").alias("created_at"),
    )


@query("jobs_by_status", f"SELECT {JOB_STATUS_SQL} AS status, count(*) AS count FROM events GROUP BY 1")
def jobs_by_status(spark, sf):
    return C.jobs_by_status(jobs(spark, sf))
