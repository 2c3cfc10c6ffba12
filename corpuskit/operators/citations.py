"""Search runs, ranked results, citations, references and the prompts built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpuskit.functions import text as X
from corpuskit.functions import urls as U
from corpuskit.functions.json_columns import json_structs, safe_json_object

# --- fixed values -----------------------------------------------------------
EXPLICIT_WEB = "(联网|上网|搜索|搜一下|搜一搜|查一下最新|查最新|帮我搜|在线查|实时|网上找|上网查)"
FRESH = "(最新|今天|今日|昨天|本周|本月|202[0-9]年?|新闻|股价|价格|汇率|天气|发布会|财报|实时|刚发布|最近|进展|动态)"
STRONG_FRESH = "(最新|今天|今日|实时|刚发布|202[0-9]年?财报|股价|汇率|天气|新闻|发布会)"
CONFIDENCE_FLOOR = 0.35
SUMMARY_ROUTE = ("总结", "概括", "摘要", "summary", "overview")
RULE_ROUTE = ("规则", "允许", "可不可以", "能不能", "audit", "policy")
CASE_ROUTE = ("案例", "经验", "类似", "case", "reference")
# -----------------------------------------------------------------------------

# Lines of a text that is put together from rows.
LINES = 1_000

RESULT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "url", "source_domain", "snippet")]
    + [T.StructField("score", T.DoubleType())]
)
_ITEM = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "url", "link", "content", "snippet")]
    + [T.StructField("score", T.DoubleType())]
)


def _text(c: Column | str) -> Column:
    return F.coalesce(c, F.lit(""))


def _or(*choices: Column | str) -> Column:
    """First choice that is neither null nor empty, else empty."""
    filled = [F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in choices]
    return F.coalesce(*filled, F.lit(""))


def parse_search_results(runs: DataFrame) -> DataFrame:
    """One row per stored result of a run; a missing domain comes from the URL."""
    items = json_structs(F.col("results_json"), RESULT)
    return runs.select("run_id", F.posexplode(items).alias("pos", "r")).select(
        "run_id",
        F.col("pos").cast("long").alias("pos"),
        _text("r.title").alias("title"),
        _text("r.url").alias("url"),
        _or("r.source_domain", U.url_host(F.col("r.url"))).alias("source_domain"),
        F.col("r.score").alias("score"),
    )


def list_search_runs(runs: DataFrame, user_id: int | None = None) -> DataFrame:
    """Runs (of one user) newest first, with their parsed results."""
    if user_id is not None:
        runs = runs.filter(F.col("user_id") == user_id)
    results = F.transform(
        json_structs(F.col("results_json"), RESULT),
        lambda r: F.struct(
            _text(r.title).alias("title"),
            _text(r.url).alias("url"),
            _or(r.source_domain, U.url_host(r.url)).alias("source_domain"),
            r.score.alias("score"),
        ),
    )
    kept = ["user_id", "run_id", "query", "provider", "status", "created_at"]
    return runs.select(*kept, results.alias("results")).orderBy("user_id", F.desc("created_at"), F.desc("run_id"))


def normalize_provider_payload(df: DataFrame, payload: str = "payload", provider: str = "provider") -> DataFrame:
    """Results of both provider formats as (title, url, snippet, score); the second has no score."""
    body = safe_json_object(F.col(payload))

    def items(key: str) -> Column:
        return json_structs(F.try_element_at(body, F.lit(key)), _ITEM)

    first = F.transform(
        items("results"),
        lambda r: F.struct(
            _text(r.title).alias("title"),
            _text(r.url).alias("url"),
            _text(r.content).alias("snippet"),
            F.coalesce(r.score, F.lit(0.0)).alias("score"),
        ),
    )
    second = F.transform(
        items("organic"),
        lambda r: F.struct(
            _text(r.title).alias("title"),
            _text(r.link).alias("url"),
            _text(r.snippet).alias("snippet"),
            F.lit(0.0).alias("score"),
        ),
    )
    chosen = F.when(F.lower(provider) == "serper", second).otherwise(first)
    kept = [c for c in df.columns if c not in (payload, provider)]
    exploded = df.select(*kept, F.posexplode(chosen).alias("pos", "r"))
    return exploded.select(*kept, F.col("pos").cast("long").alias("pos"), "r.title", "r.url", "r.snippet", "r.score")


def rank_search_results(results: DataFrame, n: int = 5, m: int = 3) -> DataFrame:
    """Best ``n`` results per run; the first ``m`` are marked for their full text."""
    order = Window.partitionBy("run_id").orderBy(F.desc("score"), F.asc("pos"))
    return (
        results.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .withColumn("fetch", F.col("rank") <= m)
        .withColumn("result_id", F.concat(F.lit("web:"), F.col("rank").cast("string")))
    )


def build_citation(df: DataFrame, ref_type: str = "web") -> DataFrame:
    """Citation columns of rows with url, title, snippet, score and optional further columns."""

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in df.columns else default

    return df.withColumns(
        {
            "citation_id": given("citation_id", X.citation_id(F.col("url"))),
            "ref_type": F.lit(ref_type),
            "source_domain": _or(given("source_domain", F.lit("")), U.url_host(F.col("url"))),
            "quote": given("quote", F.lit("")),
            "score": F.round(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), 4),
            "language": given("language", F.lit("unknown")),
        }
    )


def web_citations(ranked: DataFrame, pages: DataFrame) -> DataFrame:
    """A citation for every ranked result: from its curated page, else from the snippet.

    ``pages``: run_id, url, final_url, title, text, language of the curated pages.
    """
    page = pages.select(
        "run_id",
        "url",
        F.col("final_url").alias("p_url"),
        F.col("title").alias("p_title"),
        F.substring("text", 1, 2000).alias("p_snippet"),
        F.col("language").alias("p_language"),
    )
    joined = ranked.drop("source_domain").join(page, ["run_id", "url"], "left")
    found = F.col("p_url").isNotNull()
    cited = joined.select(
        "run_id",
        "rank",
        F.when(found, F.col("p_url")).otherwise(F.col("url")).alias("url"),
        F.when(found, _or("p_title", "title")).otherwise(_or("title", "url")).alias("title"),
        F.when(found, F.col("p_snippet")).otherwise(_text("snippet")).alias("snippet"),
        "score",
        F.col("result_id").alias("document_id"),
        F.when(found, F.col("p_language")).otherwise(F.lit("unknown")).alias("language"),
    )
    return build_citation(cited)


def turn_sources(citations: DataFrame, runs: DataFrame) -> DataFrame:
    """A source row per citation of a run, for the message that the run answered."""
    turn = runs.select("run_id", "user_id", "session_id", "message_id")
    return citations.join(turn, "run_id").select(
        "user_id",
        "session_id",
        "message_id",
        F.col("run_id").alias("web_search_run_id"),
        "citation_id",
        "ref_type",
        "url",
        "title",
        "source_domain",
    )


def citation_page_items(citations: DataFrame, pages: DataFrame, limit: int = 5) -> DataFrame:
    """First ``limit`` citations of a run with the page text, or the snippet without one."""
    order = Window.partitionBy("run_id").orderBy("rank")
    first = citations.withColumn("item", F.row_number().over(order)).filter(F.col("item") <= limit)
    texts = pages.groupBy("run_id", "citation_id").agg(F.max("text").alias("page_text"))
    return first.join(texts, ["run_id", "citation_id"], "left").select(
        "run_id",
        "item",
        _text("title").alias("title"),
        _text("url").alias("url"),
        _text("snippet").alias("snippet"),
        _or("page_text", "snippet").alias("text"),
    )


def _joined(rows: DataFrame, key: str, order: str, line: Column, separator: str, out: str, lines: int) -> DataFrame:
    """The first lines of each key in order, as one text; equal places are ordered by the line.

    Spark keeps each task's own first lines of a key before rows are shuffled (for up to 1,000 lines), so a key with a
    third of all rows needs memory for its lines, not for its rows.
    """
    place = Window.partitionBy(key).orderBy(order, "_line")
    first = rows.select(key, order, line.alias("_line")).withColumn("_n", F.row_number().over(place))
    listed = F.array_sort(F.collect_list(F.struct("_n", "_line")))
    text = F.array_join(F.transform(listed, lambda s: s["_line"]), separator)
    return first.filter(F.col("_n") <= lines).groupBy(key).agg(text.alias(out))


def assemble_context(refs: DataFrame, key: str = "query_id", order: str = "rank", lines: int = LINES) -> DataFrame:
    """Numbered document snippets per query, the first ``lines`` of them."""
    head = F.concat(F.lit("[Snippet "), F.col(order).cast("string"), F.lit("] Document "))
    line = F.concat(head, F.col("document_id").cast("string"), F.lit(" - "), "title", F.lit("\n"), "snippet")
    return _joined(refs, key, order, line, "\n\n", "context", lines)


def local_context(refs: DataFrame, key: str = "query_id", order: str = "rank", lines: int = LINES) -> DataFrame:
    """Numbered local documents for the synthesis prompt, the first ``lines`` of them."""
    line = F.concat(F.lit("[文档"), F.col(order).cast("string"), F.lit("] "), "title", F.lit("\n"), "snippet")
    return _joined(refs, key, order, line, "\n\n", "local_context", lines)


def build_synthesis_prompt(queries: DataFrame, items: DataFrame, lines: int = LINES) -> DataFrame:
    """Question, the first ``lines`` numbered results and optional local context, per run.

    ``queries``: run_id, query, local_context (null = none); ``items``: run_id, item, title, url, text.
    """
    text = X.strip(_or("text", "snippet"))
    cut = F.when(F.length(text) > 1500, F.concat(F.substring(text, 1, 1500), F.lit("…"))).otherwise(text)
    link = X.strip(_text("url"))
    block = F.concat(
        F.lit("["),
        F.col("item").cast("string"),
        F.lit("] 标题："),
        F.coalesce(F.nullif(X.strip(_text("title")), F.lit("")), F.lit("(无标题)")),
        F.when(link != "", F.concat(F.lit("\n    链接："), link)).otherwise(F.lit("")),
        F.lit("\n    内容："),
        cut,
        F.lit("\n"),
    )
    listed = _joined(items, "run_id", "item", block, "\n", "listed", lines)
    local = F.when(
        F.coalesce("local_context", F.lit("")) != "",
        F.concat(
            F.lit("另外，用户自有文档中检索到的相关片段（供参考、可结合使用）：\n"), "local_context", F.lit("\n\n")
        ),
    ).otherwise(F.lit(""))
    return queries.join(listed, "run_id").select(
        "run_id",
        F.concat(
            F.lit("用户问题："),
            "query",
            F.lit("\n\n检索到的联网结果：\n"),
            "listed",
            F.lit("\n"),
            local,
            F.lit("请基于以上结果，给出整合后的结构化回答，并在文中用 [n] 标注来源。"),
        ).alias("prompt"),
    )


def synthesis_markdown(turns: DataFrame, citations: DataFrame, lines: int = LINES) -> DataFrame:
    """The saved form of a web answer (question, answer, the first ``lines`` sources), its md5 and storage key."""
    name = _or("title", "url", F.concat(F.lit("来源"), F.col("rank").cast("string")))
    short = F.substring(F.regexp_replace(X.strip(_text("snippet")), "\n", " "), 1, 400)
    line = F.concat(
        F.lit("["),
        F.col("rank").cast("string"),
        F.lit("] "),
        name,
        F.lit(" — "),
        _text("url"),
        F.when(short != "", F.concat(F.lit("\n    "), short)).otherwise(F.lit("")),
    )
    sources = _joined(citations, "run_id", "rank", line, "\n", "sources", lines)
    content = F.concat(
        F.lit("# "), "query", F.lit("\n\n"), X.strip(F.col("answer")), F.lit("\n\n## 引用来源\n"), "sources"
    )
    saved = turns.filter(_text("answer") != "").join(sources, "run_id").withColumn("content", content).drop("sources")
    return saved.withColumn("content_hash", F.md5("content")).withColumn(
        "storage_key", F.concat(F.lit("web_syn/"), "content_hash", F.lit(".md"))
    )


def ingest_decision(turns: DataFrame) -> DataFrame:
    """How many answers are saved and citations skipped, from knowledge_mode, answer, citation_count."""
    held = F.col("knowledge_mode").isin("off", "ask")
    nothing = (_text("answer") == "") | (F.col("citation_count") == 0)
    return turns.withColumns(
        {
            "saved": F.when(held | nothing, 0).otherwise(1),
            "skipped": F.when(held, F.col("citation_count")).otherwise(F.lit(0).cast("long")),
        }
    )


def merge_local_web_refs(local: DataFrame, web: DataFrame) -> DataFrame:
    """Local references followed by web references, as a bag with a common order."""
    both = local.withColumn("part", F.lit(0)).unionByName(web.withColumn("part", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("origin", F.when(F.col("part") == 0, "local").otherwise("web"))


def merge_refs(first: DataFrame, second: DataFrame, key: str = "query_id") -> DataFrame:
    """Union of two reference lists without repeats: the better score wins, the first place stays.

    Lists carry key, rank, document_id, title, snippet, score.
    """
    both = first.withColumn("_list", F.lit(0)).unionByName(second.withColumn("_list", F.lit(1)))
    place = F.struct("_list", "rank")
    same = [key, "document_id", "title", "snippet"]
    merged = both.groupBy(*same).agg(F.min(place).alias("_at"), F.max("score").alias("score"))
    order = Window.partitionBy(key).orderBy("_at")
    return merged.withColumn("rank", F.row_number().over(order)).drop("_at")


def detect_web_need(df: DataFrame, query: str, confidence: str, override: str) -> DataFrame:
    """Rule decision whether a question needs a web search, with the reason and the signals."""
    q, conf, forced = F.col(query), F.col(confidence), F.col(override)
    off = F.coalesce(~forced, F.lit(False))
    asked = F.coalesce(forced, F.lit(False)) | q.rlike(EXPLICIT_WEB)
    strong, fresh = q.rlike(STRONG_FRESH), q.rlike(FRESH)
    unsure = F.coalesce(conf < CONFIDENCE_FLOOR, F.lit(False))
    weak = F.array_compact(
        F.array(F.when(fresh, "freshness_keyword"), F.when(unsure, "low_local_confidence"))
    )
    signals = (
        F.when(off, F.array().cast("array<string>"))
        .when(asked, F.array(F.lit("explicit_web_request")))
        .when(strong, F.array(F.lit("strong_freshness")))
        .otherwise(weak)
    )
    reason = (
        F.when(off, "显式关闭联网")
        .when(asked, "用户显式要求联网")
        .when(strong, "命中强时效性关键词")
        .when(fresh & unsure, "时效性关键词且本地召回置信度不足")
        .when(fresh | unsure, "信号不足（仅有弱时效性或置信度尚可）")
        .otherwise("无需联网")
    )
    return df.withColumns({"need_web": ~off & (asked | strong | (fresh & unsure)), "reason": reason, "signals": signals})


def route_prompt(query: Column, document_id: Column) -> Column:
    """Prompt template for a question; the first matching kind wins."""
    q = F.lower(X.strip(_text(query)))
    return (
        F.when(document_id.isNotNull() & X.contains_any(q, SUMMARY_ROUTE), "document_summary")
        .when(X.contains_any(q, RULE_ROUTE), "rule_audit")
        .when(X.contains_any(q, CASE_ROUTE), "case_reference")
        .otherwise("knowledge_qa")
    )


