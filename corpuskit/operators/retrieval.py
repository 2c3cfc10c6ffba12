"""Keyword, vector and hybrid searches, isolated per scope (a user, a document ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskit import runtime
from corpuskit.functions import text as X
from corpuskit.operators.topk import Scoring, best_per_keyword_score, score_topk

VECTOR_WEIGHT = 0.7
KEYWORD_WEIGHT = 0.3
FALLBACK_SCORE = 0.8
PREVIEW_SCORE = 0.5
HIT = ["chunk_id", "document_id", "document_title", "chunk_title", "snippet"]
COLLECTIONS = ("knowledge", "rules", "cases")
SHARED_USER = "global"


def scope_documents(docs: DataFrame, scopes: DataFrame, published_only: bool = False) -> DataFrame:
    """Documents that belong to the asking users.

    ``scopes`` has one row per user: user_id and optionally domain and document_id (null = any).
    """
    wanted = scopes.select(*[F.col(c).alias(f"_{c}") for c in scopes.columns])
    match = docs["user_id"] == wanted["_user_id"]
    for c in ("domain", "document_id"):
        if c in scopes.columns:
            match = match & (wanted[f"_{c}"].isNull() | (docs[c] == wanted[f"_{c}"]))
    kept = docs.join(wanted, match, "left_semi")
    return kept.filter("is_published") if published_only else kept


def scope_user(
    docs: DataFrame,
    user_id: int,
    domain: str | None = None,
    document_id: int | None = None,
    published_only: bool = False,
) -> DataFrame:
    """Scope of a single user as plain filters, which reach the file scan."""
    kept = docs.filter(F.col("user_id") == user_id)
    if published_only:
        kept = kept.filter("is_published")
    if domain:
        kept = kept.filter(F.col("domain") == domain)
    if document_id is not None:
        kept = kept.filter(F.col("document_id") == document_id)
    return kept


def chunks_with_documents(chunks: DataFrame, docs: DataFrame, published_only: bool = False) -> DataFrame:
    """Each chunk with its document, and the text a search looks at."""
    owners = docs.filter("is_published") if published_only else docs
    owners = owners.select(
        "document_id", "user_id", "domain", F.col("title").alias("document_title"), "summary", "created_at"
    )
    parts = [F.coalesce(c, F.lit("")) for c in ("document_title", "summary", "chunk_title", "content")]
    return chunks.join(owners, "document_id").withColumn("search_text", F.concat_ws("\n", *parts))


def query_chunk_candidates(queries: DataFrame, candidates: DataFrame, k: int, scope: str = "user_id") -> DataFrame:
    """The chunks of each query's scope that can still reach its top k, with both partial scores.

    For every keyword score the best k chunks by vector score; no other chunk can be a hit.
    """
    how = Scoring(k=k, keyword="overlap", vector="text", keep_zero=True)
    rows = _with_hit_columns(candidates)
    return best_per_keyword_score(stripped(queries), rows, how, payload=HIT, scope=scope, newest="created_at").drop("_id", "_newest")


def _with_hit_columns(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("snippet", X.snippet(F.col("content"), 160))


def stripped(queries: DataFrame) -> DataFrame:
    """Queries without white space around their text; a null text is blank."""
    return queries.withColumn("query_text", X.strip(F.coalesce("query_text", F.lit(""))))


def keyword_topk(queries: DataFrame, candidates: DataFrame, k: int = 5, scope: str = "user_id", **limits) -> DataFrame:
    """Top k by keyword score, newest document first among equals; a blank query has no keyword and no hit."""
    return score_topk(
        stripped(queries),
        _with_hit_columns(candidates),
        Scoring(k=k, keyword="overlap", vector=None),
        final_score=F.col("kw"),
        payload=HIT,
        scope=scope,
        newest="created_at",
        **limits,
    ).drop("kw", "vec")


def hybrid_topk(
    queries: DataFrame, candidates: DataFrame, k: int = 5, scope: str = "user_id", vector: str = "text", **limits
) -> DataFrame:
    """Top k by 0.7 x cosine + 0.3 x keyword score relative to the query's best keyword score.

    The cosine is rounded to 6 digits before ranking; ties go to the newest document, then the
    smallest chunk id. A blank query gets the preview of its scope. ``vector="stored"`` compares the
    ``embedding`` columns of both sides, computed once per chunk, instead of embedding every text again.
    """
    queries = stripped(queries)
    keyword = F.when(F.col("max_kw") > 0, F.col("kw") / F.col("max_kw")).otherwise(0.0)
    hits = score_topk(
        queries.filter("query_text <> ''"),
        _with_hit_columns(candidates),
        Scoring(k=k, keyword="overlap", vector=vector, both=True),
        final_score=VECTOR_WEIGHT * F.col("vec") + KEYWORD_WEIGHT * keyword,
        payload=HIT,
        scope=scope,
        newest="created_at",
        **limits,
    )
    hits = hits.withColumn("score", F.round("score", 6)).drop("kw", "vec")
    blank = queries.filter("query_text = ''")
    if blank.isEmpty():  # nobody asks for the candidates a second time
        return hits
    previews = empty_query_preview(blank, candidates, k, scope)
    return hits.unionByName(previews.select(*hits.columns))


def vector_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    scope: str = "scope",
    row_id: str = "chunk_id",
    payload: list[str] | None = None,
    **limits,
) -> DataFrame:
    """Top k by cosine over stored embeddings; score = 1 - cosine distance, 6 digits."""
    return score_topk(
        queries,
        vectors,
        Scoring(k=k, keyword=None, vector="stored", keep_zero=True),
        final_score=F.col("vec"),
        payload=payload or [row_id],
        scope=scope,
        row_id=row_id,
        **limits,
    ).drop("kw", "vec")


def empty_query_preview(requests: DataFrame, candidates: DataFrame, k: int, scope: str = "user_id") -> DataFrame:
    """First k chunks of the scope (newest document first) for every request without a query."""
    order = Window.partitionBy(scope).orderBy(F.desc("created_at"), F.asc("chunk_id"))
    candidates = candidates.join(requests.select(scope).distinct(), scope, "left_semi")
    first = _with_hit_columns(candidates).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    first = first.select(F.col(scope).alias("_asked"), "rank", *HIT, F.lit(PREVIEW_SCORE).alias("score"))
    return requests.select("query_id", F.col(scope).alias("_asked")).join(first, "_asked").drop("_asked")


def best_chunk_per_document(hits: DataFrame, k: int) -> DataFrame:
    """Best hit of each document, then the k best documents per query."""
    per_document = Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), F.asc("rank"))
    best = hits.withColumn("_r", F.row_number().over(per_document)).filter("_r = 1").drop("_r")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("rank"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_documents(
    queries: DataFrame, candidates: DataFrame, docs: DataFrame, k: int = 5, scope: str = "user_id", vector: str = "text"
) -> DataFrame:
    """Documents by their best chunk; queries without any hit fall back to title and summary.

    Query texts are stripped; a blank query gets the documents of its scope's preview. ``vector="stored"`` compares the
    ``embedding`` columns of queries and candidates, as in ``hybrid_topk``.
    """
    queries = stripped(queries)
    hits = best_chunk_per_document(runtime.materialize(hybrid_topk(queries, candidates, k, scope, vector)), k)
    found = hits.select("query_id", "rank", "document_id", F.col("document_title").alias("title"), "snippet", "score")
    missed = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    summary = F.substring(F.coalesce("summary", F.lit("")), 1, 160)
    listed = docs.select(
        scope,
        "document_id",
        "created_at",
        "title",
        F.concat_ws(" ", "title", F.coalesce("summary", F.lit(""))).alias("search_text"),
        F.coalesce(F.nullif(summary, F.lit("")), F.lit("No summary yet.")).alias("snippet"),
    )
    fallback = score_topk(
        missed,
        listed,
        Scoring(k=k, keyword="contains", vector=None),
        final_score=F.col("kw"),
        payload=["document_id", "title", "snippet"],
        scope=scope,
        newest="created_at",
        row_id="document_id",
    ).withColumn("score", F.lit(FALLBACK_SCORE))
    return found.unionByName(fallback.select(*found.columns))


def chat_retrieval(turns: DataFrame, candidates: DataFrame, k: int = 4, vector: str = "text") -> DataFrame:
    """Context of a chat turn: query_id, user_id, query_text, document_id (null = no document).

    A summary request for a document, or a turn without hits in its document, gets the first
    chunks of the document; every other turn gets a hybrid search, over the ``embedding`` columns
    of both sides with ``vector="stored"``.
    """
    scoped = turns.withColumn(
        "turn_scope",
        F.concat_ws("/", F.col("user_id").cast("string"), F.coalesce(F.col("document_id").cast("string"), F.lit("*"))),
    )
    user = F.col("user_id").cast("string")
    in_document = F.concat_ws("/", user, F.col("document_id").cast("string"))
    placed = candidates.withColumn("turn_scope", F.explode(F.array(in_document, F.concat(user, F.lit("/*")))))
    placed = placed.join(scoped.select("turn_scope").distinct(), "turn_scope", "left_semi")
    overview = F.col("document_id").isNotNull() & classify_summary_request(F.col("query_text"))
    summaries = scoped.filter(overview)
    searches = scoped.filter(~overview & (X.strip(F.coalesce("query_text", F.lit(""))) != ""))
    hits = runtime.materialize(hybrid_topk(searches, placed, k, "turn_scope", vector))
    bound = scoped.filter(~overview & F.col("document_id").isNotNull())
    missed = bound.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    previews = empty_query_preview(summaries.unionByName(missed), placed, max(k, 6), "turn_scope")
    title = F.coalesce(F.nullif("chunk_title", F.lit("")), F.col("document_title"))
    return hits.unionByName(previews.select(*hits.columns)).select(
        "query_id", "rank", "document_id", title.alias("title"), "snippet", F.round("score", 4).alias("score")
    )


def local_confidence(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Best retrieval score per query, null without hits."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("confidence"))
    return queries.select("query_id").join(best, "query_id", "left")


def normalize_keyword_scores(scored: DataFrame) -> DataFrame:
    """Keyword score relative to the best positive one of the same query (1 when there is none)."""
    best = F.max(F.when(F.col("kw") > 0, F.col("kw"))).over(Window.partitionBy("query_id"))
    return scored.withColumn("kw_norm", F.when(F.col("kw") > 0, F.col("kw") / F.coalesce(best, F.lit(1.0))).otherwise(0.0))


def scope_private_or_global(chunks: DataFrame, user: int | str | None) -> DataFrame:
    """Rows of the user and shared rows; ``None`` keeps all."""
    return chunks if user is None else chunks.filter(F.col("user_id").isin(str(user), SHARED_USER))


def filter_tags_any(chunks: DataFrame, tags: list[str]) -> DataFrame:
    """Rows that carry at least one of the tags."""
    return chunks.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))) if tags else chunks


def collection_of(doc_type):
    """Collection that stores a document type; unknown types go to ``knowledge``."""
    return F.when(doc_type == "rule", "rules").when(doc_type == "case", "cases").otherwise("knowledge")


def union_collections(collections: dict[str, DataFrame]) -> DataFrame:
    """Rows of all collections with a collection label."""
    labelled = [df.withColumn("collection", F.lit(name)) for name, df in collections.items()]
    merged = labelled[0]
    for df in labelled[1:]:
        merged = merged.unionByName(df, allowMissingColumns=True)
    return merged


def knowledge_search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    doc_type: str | None = None,
    domain: str | None = None,
    tags: list[str] | None = None,
    **limits,
) -> DataFrame:
    """Vector search over the collections, in the user's own and the shared chunks.

    All filters apply before the top k. ``chunks`` carry ``embedding`` and ``collection``.
    """
    if doc_type:
        chunks = chunks.filter(F.col("collection") == collection_of(F.lit(doc_type)))
    if domain:
        chunks = chunks.filter(F.col("domain") == domain)
    own = F.col("user_id").cast("string")
    asked = queries.withColumn("scope", F.explode(F.array_distinct(F.array(own, F.lit(SHARED_USER)))))
    rows = filter_tags_any(chunks, tags or []).withColumn("scope", own)
    return vector_topk(asked, rows, k, payload=["chunk_id", "collection"], **limits)


def memory_search(queries: DataFrame, memories: DataFrame, k: int = 5, **limits) -> DataFrame:
    """Vector search in the memories of the same user."""
    return vector_topk(queries, memories, k, scope="user_id", row_id="memory_id", **limits)


# --- fixed values -----------------------------------------------------------
SUMMARY_WORDS = (
    "总结", "概括", "摘要", "概述", "主要内容", "讲了什么", "说了什么", "介绍一下",
    "summarize", "summary", "overview", "tldr", "tl;dr",
)
# -----------------------------------------------------------------------------


def classify_summary_request(query):
    """True when the query asks for a summary."""
    return X.contains_any(F.lower(X.strip(F.coalesce(query, F.lit("")))), SUMMARY_WORDS)
