"""Searches: vector, keyword and hybrid top-k and what is built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit import runtime
from corpuskit.functions.vectors import norm
from corpuskit.operators import conversations as V
from corpuskit.operators import embedding as E
from corpuskit.operators import retrieval as R
from corpuskit.plans import model as M
from corpuskit.plans.lists import ROUNDS_SQL
from corpuskit.plans.registry import query


def candidates(spark, sf):
    return R.chunks_with_documents(M.chunks(spark, sf), M.docs(spark, sf))


def sql_pairs() -> str:
    """Both scores of every (query, chunk) pair of a scope, as plain joins on tokens and features.

    Expects CTEs sq (query_id, scope, query_text), sc (scope, chunk_id) and candidates.
    """
    return f"""
  sqt AS (SELECT *, list_distinct({M.sql_tokens('query_text')}) AS qtoks FROM sq),
  ct AS (SELECT chunk_id, lower(search_text) AS low, list_distinct({M.sql_tokens('search_text')}) AS toks
         FROM candidates),
  kws AS (
    SELECT query_id, chunk_id,
           CASE WHEN phrase + shared > 0 THEN phrase + shared
                WHEN len(list_filter(qtoks, lambda t: contains(low, t))) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS kw
    FROM (SELECT q.query_id, c.chunk_id, c.low, q.qtoks,
                 CASE WHEN contains(c.low, lower(q.query_text)) THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS phrase,
                 len(list_intersect(q.qtoks, c.toks))::DOUBLE AS shared
          FROM sqt q JOIN sc USING (scope) JOIN ct c USING (chunk_id))),
  cf AS ({M.sql_features('candidates', 'chunk_id', 'search_text')}),
  qf AS ({M.sql_features('sq', 'query_id', 'query_text')}),
  cn AS (SELECT chunk_id, sum(weight * weight) AS n FROM cf GROUP BY 1),
  qn AS (SELECT query_id, sum(weight * weight) AS n FROM qf GROUP BY 1),
  dots AS (SELECT q.query_id, c.chunk_id, sum(q.weight * c.weight) AS d
           FROM qf q JOIN sq USING (query_id) JOIN sc USING (scope)
           JOIN cf c ON c.chunk_id = sc.chunk_id AND c.bucket = q.bucket GROUP BY 1, 2),
  vecs AS (SELECT query_id, chunk_id, round(d / (sqrt(cn.n) * sqrt(qn.n)), 6) AS vec
           FROM dots JOIN cn USING (chunk_id) JOIN qn USING (query_id)),
  scored AS (SELECT query_id, chunk_id, kw, coalesce(vec, 0.0::DOUBLE) AS vec,
                    max(kw) OVER (PARTITION BY query_id) AS max_kw
             FROM kws LEFT JOIN vecs USING (query_id, chunk_id))"""


def sql_hits(score: str, k: int, keep: str, digits: bool = True) -> str:
    """Top k hits per query over ``scored``."""
    shown = "round(s, 6)" if digits else "s"
    return f"""
  hits AS (SELECT query_id, rank, chunk_id, document_id, document_title, chunk_title,
                  substring(content, 1, 160) AS snippet, {shown} AS score, newest FROM (
    SELECT f.query_id, c.*, s, row_number() OVER (PARTITION BY query_id
              ORDER BY s DESC, c.newest DESC, chunk_id) AS rank
    FROM (SELECT *, {score} AS s FROM scored WHERE {keep}) f JOIN candidates c USING (chunk_id)) WHERE rank <= {k})"""


BY_USER = (
    ", sq AS (SELECT query_id, user_id AS scope, query_text FROM queries), "
    "sc AS (SELECT chunk_id, user_id AS scope FROM candidates), "
)
FINAL = "0.7::DOUBLE * vec + 0.3::DOUBLE * CASE WHEN max_kw > 0 THEN kw / max_kw ELSE 0 END"
HYBRID = BY_USER + sql_pairs() + "," + sql_hits(FINAL, 5, "kw > 0 OR vec > 0")
HIT_COLUMNS = "query_id, rank, chunk_id, document_id, document_title, chunk_title, snippet, score"


@query(
    "chunks_with_documents",
    M.with_sql(
        M.DOC_SQL,
        "SELECT document_id, chunk_id, user_id, domain, document_title, md5(search_text) AS text_md5 FROM candidates",
    ),
)
def chunks_with_documents(spark, sf):
    joined = candidates(spark, sf)
    return joined.select(
        "document_id", "chunk_id", "user_id", "domain", "document_title", F.md5("search_text").alias("text_md5")
    )


@query("hybrid_topk", M.with_sql(M.DOC_SQL, HYBRID + f" SELECT {HIT_COLUMNS} FROM hits"))
def hybrid_topk(spark, sf):
    return R.hybrid_topk(M.queries(spark, sf), candidates(spark, sf), 5)


@query(
    "keyword_topk",
    M.with_sql(M.DOC_SQL, BY_USER + sql_pairs() + "," + sql_hits("kw", 5, "kw > 0") + f" SELECT {HIT_COLUMNS} FROM hits"),
)
def keyword_topk(spark, sf):
    return R.keyword_topk(M.queries(spark, sf), candidates(spark, sf), 5)


BEST_SQL = """, best AS (SELECT query_id, chunk_id, document_id, kw, vec, max_kw FROM (
    SELECT s.*, c.document_id, row_number() OVER (PARTITION BY query_id, kw
      ORDER BY vec DESC, newest DESC, chunk_id) AS r FROM scored s JOIN candidates c USING (chunk_id)) WHERE r <= 3)"""


@query(
    "query_chunk_candidates",
    M.with_sql(M.DOC_SQL, BY_USER + sql_pairs() + BEST_SQL + " SELECT query_id, chunk_id, document_id, kw, vec FROM best"),
)
def query_chunk_candidates(spark, sf):
    best = R.query_chunk_candidates(M.queries(spark, sf), candidates(spark, sf), 3)
    return best.select("query_id", "chunk_id", "document_id", "kw", "vec")


@query(
    "normalize_keyword_scores",
    M.with_sql(
        M.DOC_SQL,
        BY_USER + sql_pairs() + BEST_SQL
        + " SELECT query_id, chunk_id, round(CASE WHEN kw > 0 THEN kw / max_kw ELSE 0 END, 6) AS kw_norm FROM best",
    ),
)
def normalize_keyword_scores(spark, sf):
    best = R.query_chunk_candidates(M.queries(spark, sf), candidates(spark, sf), 3)
    return R.normalize_keyword_scores(best).select("query_id", "chunk_id", F.round("kw_norm", 6).alias("kw_norm"))


@query(
    "vector_topk",
    """
    SELECT query_id, vec_id, rank, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[],
          v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.label = v.label))
    WHERE rank <= 5""",
)
def vector_topk(spark, sf):
    vectors = M.table(spark, sf, "embeddings").withColumnRenamed("label", "scope")
    asked = vectors.withColumnRenamed("vec_id", "query_id")
    return R.vector_topk(asked, vectors, 5, row_id="vec_id")


PREVIEW_SQL = """
  previews AS (SELECT user_id, document_id, document_title, chunk_title, chunk_id, substring(content, 1, 160) AS snippet,
    row_number() OVER (PARTITION BY user_id ORDER BY newest DESC, chunk_id) AS rank FROM candidates)"""


@query(
    "empty_query_preview",
    M.with_sql(
        M.DOC_SQL,
        f""", {PREVIEW_SQL} SELECT query_id, rank, chunk_id, document_id, document_title, chunk_title, snippet,
        0.5::DOUBLE AS score FROM previews JOIN queries USING (user_id) WHERE rank <= 5""",
    ),
)
def empty_query_preview(spark, sf):
    return R.empty_query_preview(M.queries(spark, sf), candidates(spark, sf), 5)


BEST_DOC_SQL = """, firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id
    ORDER BY score DESC, rank) AS r FROM hits),
  per_doc AS (SELECT query_id, document_id, chunk_id, document_title AS title, snippet, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM firsts WHERE r = 1)"""


@query(
    "best_chunk_per_document",
    M.with_sql(
        M.DOC_SQL,
        HYBRID + BEST_DOC_SQL + " SELECT query_id, rank, document_id, chunk_id, score FROM per_doc WHERE rank <= 3",
    ),
)
def best_chunk_per_document(spark, sf):
    hits = R.hybrid_topk(M.queries(spark, sf), candidates(spark, sf), 5)
    return R.best_chunk_per_document(hits, 3).select("query_id", "rank", "document_id", "chunk_id", "score")


SEARCH_SQL = M.with_sql(
    M.DOC_SQL,
    HYBRID
    + BEST_DOC_SQL
    + """, found AS (SELECT query_id, rank, document_id, title, snippet, score FROM per_doc),
        fallback AS (SELECT query_id, document_id, l.title,
            coalesce(nullif(substring(summary, 1, 160), ''), 'No summary yet.') AS snippet,
            row_number() OVER (PARTITION BY query_id ORDER BY newest DESC, document_id) AS rank
          FROM queries q JOIN docs l USING (user_id)
          WHERE query_id NOT IN (SELECT query_id FROM found)
            AND contains(lower(l.title || ' ' || coalesce(summary, '')), lower(query_text)))
        SELECT * FROM found UNION ALL
        SELECT query_id, rank, document_id, title, snippet, 0.8::DOUBLE FROM fallback WHERE rank <= 5""",
)


@query("search_documents", SEARCH_SQL)
@query("search_all_documents", SEARCH_SQL)
def search_documents(spark, sf):
    """Every benchmark text is searched in all chunks of its user; tests cover the queries that fall back to titles."""
    return R.search_documents(M.queries(spark, sf), candidates(spark, sf), M.docs(spark, sf), 5)


search_all_documents = search_documents


def embedded(df, text):
    """Rows with their vector, stored once instead of computed in every search."""
    return runtime.materialize(E.hash_embedding(df, text, normalize=False))


@query("search_documents_stored", SEARCH_SQL)
def search_documents_stored(spark, sf):
    asked = embedded(M.queries(spark, sf), "query_text")
    return R.search_documents(asked, embedded(candidates(spark, sf), "search_text"), M.docs(spark, sf), 5, vector="stored")


@query(
    "local_confidence",
    M.with_sql(
        M.DOC_SQL,
        HYBRID + " SELECT query_id, max(score) AS confidence FROM queries LEFT JOIN hits USING (query_id) GROUP BY 1",
    ),
)
def local_confidence(spark, sf):
    asked = M.queries(spark, sf)
    return R.local_confidence(asked, R.hybrid_topk(asked, candidates(spark, sf), 5))


TURNS_SQL = """, turns AS (SELECT session_id AS query_id, session_id % 10 AS user_id,
    CASE WHEN session_id % 3 = 0 THEN 'Summary: ' ELSE '' END || content AS query_text,
    CASE WHEN session_id % 2 = 0 THEN session_id % 10 + 10 * (session_id % 20) END AS document_id
  FROM (SELECT session_id, arg_max(content, turn) AS content FROM messages WHERE role = 'user' GROUP BY 1))"""


def turns(spark, sf):
    s = F.col("session_id")
    return V.latest_user_query(M.messages(spark, sf)).select(
        s.alias("query_id"),
        (s % 10).alias("user_id"),
        F.concat(F.when(s % 3 == 0, "Summary: ").otherwise(""), "query_text").alias("query_text"),
        F.when(s % 2 == 0, s % 10 + 10 * (s % 20)).alias("document_id"),
    )


CHAT_SQL = M.with_sql(
    M.DOC_SQL + " messages",
    TURNS_SQL
    + """, sq AS (SELECT query_id, user_id || '/' || coalesce(document_id::VARCHAR, '*') AS scope, query_text
                FROM turns WHERE NOT (document_id IS NOT NULL AND contains(lower(query_text), 'summary'))),
        sc AS (SELECT chunk_id, user_id || '/*' AS scope FROM candidates
           UNION ALL SELECT chunk_id, user_id || '/' || document_id FROM candidates), """
    + sql_pairs()
    + ","
    + sql_hits(FINAL, 4, "kw > 0 OR vec > 0")
    + """, rest AS (SELECT * FROM turns WHERE document_id IS NOT NULL AND query_id NOT IN (SELECT query_id FROM hits)),
        previews AS (SELECT query_id, c.document_id, chunk_title, substring(content, 1, 160) AS snippet,
        row_number() OVER (PARTITION BY query_id ORDER BY newest DESC, chunk_id) AS rank
      FROM rest JOIN candidates c USING (user_id, document_id))
        SELECT query_id, rank, document_id, chunk_title AS title, snippet, round(score, 4) AS score FROM hits
        UNION ALL SELECT query_id, rank, document_id, chunk_title, snippet, 0.5::DOUBLE FROM previews WHERE rank <= 6""",
)


@query("chat_retrieval", CHAT_SQL)
def chat_retrieval(spark, sf):
    return R.chat_retrieval(turns(spark, sf), candidates(spark, sf), 4)


@query("chat_retrieval_stored", CHAT_SQL)
def chat_retrieval_stored(spark, sf):
    asked = embedded(turns(spark, sf), "query_text")
    return R.chat_retrieval(asked, embedded(candidates(spark, sf), "search_text"), 4, vector="stored")


def sql_cosines(rows: str, key: str, text: str, match: str, k: int) -> str:
    """Top k rows per query by hashed cosine; zero vectors score 0."""
    return f"""
  rf AS ({M.sql_features(rows, key, text)}), qf AS ({M.sql_features('sq', 'query_id', 'query_text')}),
  rn AS (SELECT {key}, sum(weight * weight) AS n FROM rf GROUP BY 1),
  qn AS (SELECT query_id, sum(weight * weight) AS n FROM qf GROUP BY 1),
  dots AS (SELECT p.query_id, p.{key}, sum(q.weight * r.weight) AS d FROM
             (SELECT q.query_id, r.{key} FROM sq q JOIN {rows} r ON {match}) p JOIN qf q USING (query_id)
             JOIN rf r ON r.{key} = p.{key} AND r.bucket = q.bucket GROUP BY 1, 2),
  cosines AS (SELECT q.query_id, r.{key}, coalesce(round(d / (sqrt(rn.n) * sqrt(qn.n)), 6), 0.0::DOUBLE) AS score
    FROM sq q JOIN {rows} r ON {match} LEFT JOIN dots USING (query_id, {key}) LEFT JOIN rn USING ({key})
    LEFT JOIN qn USING (query_id)),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank
          FROM cosines) WHERE rank <= {k})"""


@query(
    "memory_search",
    M.with_sql(
        "messages",
        ROUNDS_SQL
        + """, memories AS (SELECT message_id AS memory_id, user_id, text FROM rounds),
        sq AS (SELECT session_id AS query_id, session_id % 10 AS user_id, arg_max(content, turn) AS query_text
               FROM messages WHERE role = 'user' GROUP BY 1, 2), """
        + sql_cosines("memories", "memory_id", "text", "q.user_id = r.user_id", 3)
        + " SELECT query_id, memory_id, rank, score FROM top",
    ),
)
def memory_search(spark, sf):
    messages = M.messages(spark, sf)
    rounds = V.conversation_rounds(messages).select(
        F.col("message_id").alias("memory_id"), (F.col("session_id") % 10).alias("user_id"), "text"
    )
    asked = V.latest_user_query(messages).select(
        F.col("session_id").alias("query_id"), (F.col("session_id") % 10).alias("user_id"), "query_text"
    )
    return R.memory_search(
        E.hash_embedding(asked, "query_text", normalize=False), E.hash_embedding(rounds, "text", normalize=False), 3
    )


OWNED_SQL = """owned AS (SELECT doc_id AS chunk_id, text, source, lang,
    CASE WHEN doc_id % 4 = 0 THEN 'global' ELSE (doc_id % 10)::VARCHAR END AS user_id,
    CASE lang WHEN 'de' THEN 'rules' ELSE 'knowledge' END AS collection FROM documents)"""


def owned_chunks(spark, sf):
    owner = F.when(F.col("doc_id") % 4 == 0, "global").otherwise((F.col("doc_id") % 10).cast("string"))
    doc_type = F.when(F.col("lang") == "de", "rule").otherwise("knowledge")
    return M.table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("text").alias("content"),
        owner.alias("user_id"),
        F.col("source").alias("domain"),
        F.array("lang", "source").alias("tags"),
        R.collection_of(doc_type).alias("collection"),
    )


@query(
    "knowledge_search",
    M.with_sql(
        "queries",
        ", "
        + OWNED_SQL
        + ", sq AS (SELECT query_id, user_id::VARCHAR AS user_id, query_text FROM queries), "
        + sql_cosines("owned", "chunk_id", "text", "r.user_id IN (q.user_id, 'global')", 5)
        + " SELECT query_id, chunk_id, collection, rank, score FROM top JOIN owned USING (chunk_id)",
    ),
)
def knowledge_search(spark, sf):
    chunks = E.hash_embedding(owned_chunks(spark, sf), "content", normalize=False)
    asked = E.hash_embedding(M.queries(spark, sf), "query_text", normalize=False)
    return R.knowledge_search(asked, chunks, 5)


@query(
    "union_collections",
    "WITH " + OWNED_SQL + " SELECT chunk_id, collection, md5(text) AS content_md5 FROM owned",
)
def union_collections(spark, sf):
    chunks = owned_chunks(spark, sf)
    parts = {n: chunks.filter(F.col("collection") == n).drop("collection") for n in R.COLLECTIONS}
    return R.union_collections(parts).select("chunk_id", "collection", F.md5("content").alias("content_md5"))


@query(
    "hash_embedding",
    f"""
    WITH f AS ({M.sql_features('documents', 'doc_id', 'text')})
    SELECT doc_id, count(*) AS n_cells, md5(string_agg(bucket || ':' || weight::BIGINT, ',' ORDER BY bucket)) AS cells_md5,
           round(sqrt(sum(weight * weight)), 6) AS length FROM f GROUP BY 1""",
)
def hash_embedding(spark, sf):
    docs = E.hash_embedding(M.table(spark, sf, "documents"), "text", normalize=False)
    cells = F.filter(
        F.transform(F.col("embedding"), lambda w, i: F.when(w > 0, F.concat_ws(":", i, w.cast("bigint")))),
        lambda c: c.isNotNull(),
    )
    return docs.select(
        "doc_id",
        F.size(cells).cast("long").alias("n_cells"),
        F.md5(F.array_join(cells, ",")).alias("cells_md5"),
        F.round(norm(F.col("embedding")), 6).alias("length"),
    )
