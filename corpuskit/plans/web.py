"""Pages, search runs, citations, prompts and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import text as X
from corpuskit.operators import citations as C
from corpuskit.operators import network
from corpuskit.operators import pages as P
from corpuskit.operators import retrieval as R
from corpuskit.plans import model as M
from corpuskit.plans.duplicates import sql_greedy, sql_simhash
from corpuskit.plans.registry import query
from corpuskit.plans.scalars import CANONICAL_SQL
from corpuskit.plans.search import HYBRID, candidates
from corpuskit.sources.readers import scan_pages

WS = M.SQL_WS

# --- pages ---

# The text nodes of the article (of the body when the article is short), as lists of strings.
_STRINGS = """list_filter(list_transform(string_split(regexp_replace({part}, '(?s)<!--.*?-->|<[^>]*>', chr(1), 'g'), chr(1)),
    lambda s: trim(replace(replace(replace(replace(replace(s, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'),
                   '&amp;', '&'), {ws})), lambda s: s <> '')"""
CLEAN_SQL = f"""
  parts AS (SELECT page_id, url, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS article,
      regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1),
        '(?s)<nav>.*?</nav>|<footer>.*?</footer>|<script>.*?</script>', '', 'g') AS body,
      trim(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&quot;', '"'), '&amp;', '&'), {WS}) AS title
    FROM pages),
  strs AS (SELECT *, {_STRINGS.format(part='article', ws=WS)} AS a, {_STRINGS.format(part='body', ws=WS)} AS b FROM parts),
  picked AS (SELECT *, length(array_to_string(a, '')) > 200 AS is_long FROM strs),
  clean AS (SELECT page_id, url, title, array_to_string(CASE WHEN is_long THEN a ELSE b END, ' ') AS text,
      CASE WHEN is_long THEN '# ' || array_to_string(a, chr(10) || chr(10))
        ELSE b[1] || chr(10) || chr(10) || '# ' || array_to_string(b[2:], chr(10) || chr(10)) END AS markdown,
      length(html) AS html_length FROM picked),
  normal AS (SELECT *, length(text) AS content_length, length(text) / html_length::DOUBLE AS content_ratio,
      regexp_matches(title || chr(10) || substring(text, 1, 500),
        '(?i)(404|not\\s*found|page\\s*not\\s*found|access\\s*denied)') AS is_soft_404,
      round(0.6::DOUBLE * least(length(text) / 1500.0::DOUBLE, 1.0::DOUBLE)
        + 0.4::DOUBLE * least((length(text) / html_length::DOUBLE) / 0.15::DOUBLE, 1.0::DOUBLE), 3) AS quality_score
    FROM clean)"""
GOOD_SQL = f"""{CLEAN_SQL},
  good AS (SELECT * FROM normal WHERE NOT is_soft_404 AND quality_score >= 0.3 AND content_length >= 200),
  keyed AS (SELECT *, {CANONICAL_SQL} AS canonical FROM (SELECT *, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
      list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'),
                  lambda p: regexp_matches(p, '=.')) AS params FROM good))"""

CURATED_SQL = f"""{GOOD_SQL},
  by_url AS (SELECT * FROM keyed WHERE page_id IN (SELECT min(page_id) FROM keyed GROUP BY canonical)),
  by_hash AS (SELECT * FROM by_url WHERE page_id IN (SELECT min(page_id) FROM by_url GROUP BY sha256(text))),
  {sql_simhash('by_hash', 'page_id', 'text')},
  ordered AS MATERIALIZED (SELECT page_id, simhash, row_number() OVER (ORDER BY page_id) AS i FROM prints),
  {sql_greedy('ordered', 'page_id')},
  curated AS (SELECT n.*, CASE WHEN page_id NOT IN (SELECT page_id FROM good) THEN 'quality'
        WHEN page_id NOT IN (SELECT page_id FROM by_url) THEN 'url'
        WHEN page_id NOT IN (SELECT page_id FROM by_hash) THEN 'hash'
        WHEN page_id NOT IN (SELECT page_id FROM near) THEN 'simhash' ELSE '' END AS reason FROM normal n)"""


@query("scan_pages", "SELECT page_id, url, length(html)::BIGINT AS html_length, md5(html) AS html_md5 FROM pages")
def scan_pages_query(spark, sf):
    return scan_pages(spark, f"{sf}/pages.parquet").select(
        "page_id", "url", F.length("html").cast("long").alias("html_length"), F.md5("html").alias("html_md5")
    )


@query(
    "clean_html",
    f"""WITH {CLEAN_SQL} SELECT page_id, title, text, markdown, html_length::INTEGER AS html_length,
        content_length::INTEGER AS content_length, round(content_ratio, 6) AS content_ratio, 0 AS n_links FROM normal""",
)
def clean_html(spark, sf):
    return P.clean_html(M.table(spark, sf, "pages")).select(
        "page_id",
        "title",
        "text",
        "markdown",
        "html_length",
        "content_length",
        F.round("content_ratio", 6).alias("content_ratio"),
        F.size("links").alias("n_links"),
    )


# links are in the navigation only; with another wrapper they are part of the content
@query(
    "page_links",
    """
    WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1),
                 '<a href="([^"]*)">', 1)) AS href FROM pages)
    SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS href, count(*) AS n FROM l GROUP BY ALL""",
)
def page_links(spark, sf):
    html = F.replace(F.replace("html", F.lit("<nav>"), F.lit("<section>")), F.lit("</nav>"), F.lit("</section>"))
    html = F.replace(F.replace(html, F.lit("<article>"), F.lit("<div>")), F.lit("</article>"), F.lit("</div>"))
    pages = M.table(spark, sf, "pages").withColumn("html", html)
    links = P.clean_html(pages).select("page_id", F.explode("links").alias("l"))
    return links.groupBy("page_id", F.col("l.href").alias("href")).agg(F.count("*").alias("n"))


@query(
    "normalize_pages",
    f"""WITH {CLEAN_SQL} SELECT page_id, 'en' AS language, is_soft_404, quality_score, md5(text) AS text_md5 FROM normal""",
)
def normalize_pages(spark, sf):
    return P.normalize_pages(M.table(spark, sf, "pages")).select(
        "page_id", "language", "is_soft_404", "quality_score", F.md5("text").alias("text_md5")
    )


@query(
    "quality_gate",
    f"""WITH {CLEAN_SQL} SELECT page_id, quality_score FROM normal
        WHERE NOT is_soft_404 AND quality_score >= 0.95 AND content_length >= 400""",
)
def quality_gate(spark, sf):
    return P.quality_gate(P.normalize_pages(M.table(spark, sf, "pages")), 0.95, 400).select("page_id", "quality_score")


@query("curate_pages", f"WITH RECURSIVE {CURATED_SQL} SELECT page_id, title, quality_score, reason FROM curated")
def curate_pages(spark, sf):
    return P.curate_pages(M.table(spark, sf, "pages")).select("page_id", "title", "quality_score", "reason")


@query(
    "organize_fallback_card",
    f"WITH {CLEAN_SQL} SELECT page_id, substring(markdown, 1, 500) AS summary, 0 AS n_topics, 0 AS n_faqs FROM clean",
)
def organize_fallback_card(spark, sf):
    card = P.organize_fallback_card(P.clean_html(M.table(spark, sf, "pages")))
    return card.select("page_id", "summary", F.size("topics").alias("n_topics"), F.size("faqs").alias("n_faqs"))


# --- search runs: seven pages each, stored as JSON; the JSON of every fifth run is not a list ---

SCORE_SQL = "(page_id * 37 % 100) / 100.0::DOUBLE"
RESULTS_SQL = f"""results AS (SELECT page_id // 7 AS run_id, page_id % 7 AS pos, 'page ' || page_id AS title, url,
    CASE WHEN page_id % 2 = 0 THEN 'stored.example' ELSE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) END AS source_domain,
    'about ' || url AS snippet, {SCORE_SQL} AS score FROM pages WHERE page_id // 7 % 5 <> 0)"""
RUNS_SQL = f"""runs AS (SELECT DISTINCT page_id // 7 AS run_id, page_id // 7 % 10 AS user_id, 'find ' || page_id // 7 AS query
    FROM pages)"""


def results(spark, sf):
    page = F.col("page_id")
    return M.table(spark, sf, "pages").select(
        F.floor(page / 7).alias("run_id"),
        F.struct(
            page.alias("page_id"),
            F.concat(F.lit("page "), page).alias("title"),
            "url",
            F.when(page % 2 == 0, "stored.example").alias("source_domain"),
            F.concat(F.lit("about "), "url").alias("snippet"),
            (page * 37 % 100 / F.lit(100.0)).alias("score"),
        ).alias("r"),
    )


def runs(spark, sf):
    run = F.col("run_id")
    stored = results(spark, sf).groupBy("run_id").agg(F.array_sort(F.collect_list("r")).alias("items"))
    as_json = F.when(run % 5 == 0, F.to_json(F.get("items", 0))).otherwise(F.to_json("items"))
    return stored.select(
        "run_id",
        (run % 10).alias("user_id"),
        run.alias("session_id"),
        (run * 100).alias("message_id"),
        F.concat(F.lit("find "), run).alias("query"),
        F.lit("tavily").alias("provider"),
        F.lit("completed").alias("status"),
        F.timestamp_seconds(run + M.EPOCH).alias("created_at"),
        as_json.alias("results_json"),
    )


@query("parse_search_results", f"WITH {RESULTS_SQL} SELECT run_id, pos, title, url, source_domain, score FROM results")
def parse_search_results(spark, sf):
    return C.parse_search_results(runs(spark, sf))


@query(
    "list_search_runs",
    f"""WITH {RESULTS_SQL}, {RUNS_SQL} SELECT run_id, any_value(user_id) AS user_id, any_value(query) AS query,
        count(pos)::INTEGER AS n_results, coalesce(string_agg(source_domain, ' ' ORDER BY pos), '') AS domains
        FROM runs LEFT JOIN results USING (run_id) GROUP BY run_id""",
)
def list_search_runs(spark, sf):
    return C.list_search_runs(runs(spark, sf)).select(
        "run_id",
        "user_id",
        "query",
        F.size("results").alias("n_results"),
        F.array_join(F.transform("results", lambda r: r.source_domain), " ").alias("domains"),
    )


@query(
    "normalize_provider_payload",
    f"""SELECT page_id // 7 AS run_id, page_id % 7 AS pos, 'page ' || page_id AS title, url, 'about ' || url AS snippet,
         CASE WHEN page_id // 7 % 2 = 0 THEN {SCORE_SQL} ELSE 0.0::DOUBLE END AS score FROM pages""",
)
def normalize_provider_payload(spark, sf):
    items = results(spark, sf).groupBy("run_id").agg(F.array_sort(F.collect_list("r")).alias("items"))
    one = F.transform(
        "items",
        lambda r: F.struct(r.title.alias("title"), r.url.alias("url"), r.snippet.alias("content"), r.score.alias("score")),
    )
    two = F.transform(
        "items", lambda r: F.struct(r.title.alias("title"), r.url.alias("link"), r.snippet.alias("snippet"))
    )
    even = F.col("run_id") % 2 == 0
    payloads = items.select(
        "run_id",
        F.when(even, "tavily").otherwise("serper").alias("provider"),
        F.when(even, F.to_json(F.struct(one.alias("results")))).otherwise(
            F.to_json(F.struct(two.alias("organic")))
        ).alias("payload"),
    )
    return C.normalize_provider_payload(payloads)


RANKED_SQL = f"""{RESULTS_SQL}, ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id
    ORDER BY score DESC, pos) AS rank FROM results) WHERE rank <= 5)"""


def ranked(spark, sf):
    parsed = C.parse_search_results(runs(spark, sf)).withColumn("snippet", F.concat(F.lit("about "), "url"))
    return C.rank_search_results(parsed, 5, 3)


@query(
    "rank_search_results",
    f"WITH {RANKED_SQL} SELECT run_id, rank, url, score, rank <= 3 AS fetch, 'web:' || rank AS result_id FROM ranked",
)
def rank_search_results(spark, sf):
    return ranked(spark, sf).select("run_id", "rank", "url", "score", "fetch", "result_id")


@query(
    "build_citation",
    """SELECT page_id, 'cit_' || substr(sha256(url), 1, 12) AS citation_id, 'web' AS ref_type,
         regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS source_domain, round(page_id / 7.0::DOUBLE, 4) AS score,
         'unknown' AS language FROM pages""",
)
def build_citation(spark, sf):
    pages = M.table(spark, sf, "pages").withColumn("score", F.col("page_id") / F.lit(7.0))
    return C.build_citation(pages).select("page_id", "citation_id", "ref_type", "source_domain", "score", "language")


# Citations of the ranked results; the first three get the text of their page unless the run had it already.
_NEAR = "b.run_id = a.run_id AND bit_count(xor(b.s, a.s)) <= 3"
CITED_SQL = f"""{GOOD_SQL},
  {sql_simhash('good', 'page_id', 'text')}, {RANKED_SQL},
  seq AS (SELECT r.run_id, k.url, k.title, k.text, k.canonical, sha256(k.text) AS h, p.simhash AS s,
      row_number() OVER (PARTITION BY r.run_id ORDER BY r.rank) AS n
    FROM ranked r JOIN keyed k USING (url) LEFT JOIN prints p USING (page_id) WHERE r.rank <= 3),
  s1 AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM seq b WHERE b.run_id = a.run_id AND b.n < a.n
      AND b.canonical = a.canonical) AS u FROM seq a),
  s2 AS (SELECT a.* FROM s1 a WHERE u AND NOT EXISTS (SELECT 1 FROM s1 b WHERE b.run_id = a.run_id AND b.n < a.n
      AND b.u AND b.h = a.h)),
  t1 AS (SELECT * FROM s2 WHERE n = 1),
  t2 AS (SELECT * FROM s2 a WHERE n = 2 AND NOT EXISTS (SELECT 1 FROM t1 b WHERE {_NEAR})),
  t3 AS (SELECT * FROM s2 a WHERE n = 3 AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) b
      WHERE {_NEAR})),
  fetched AS (SELECT run_id, url, title, text FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)),
  cited AS (SELECT r.run_id, r.rank, r.url, 'cit_' || substr(sha256(r.url), 1, 12) AS citation_id,
      CASE WHEN f.url IS NULL THEN r.title ELSE f.title END AS title,
      CASE WHEN f.url IS NULL THEN r.snippet ELSE substring(f.text, 1, 2000) END AS snippet,
      round(r.score, 4) AS score, 'web:' || r.rank AS document_id,
      CASE WHEN f.url IS NULL THEN 'unknown' ELSE 'en' END AS language,
      regexp_extract(r.url, '^[a-z]+://([^/?#]*)', 1) AS source_domain
    FROM ranked r LEFT JOIN fetched f USING (run_id, url))"""


def fetched(spark, sf):
    wanted = ranked(spark, sf).filter("fetch").select("run_id", "rank", "url")
    return P.fetched_pages(wanted, M.table(spark, sf, "pages"))


def cited(spark, sf):
    return C.web_citations(ranked(spark, sf), fetched(spark, sf))


@query(
    "web_citations",
    f"""WITH RECURSIVE {CITED_SQL} SELECT run_id, rank, url, citation_id, title, snippet, score, document_id, language,
        source_domain FROM cited""",
)
def web_citations(spark, sf):
    columns = "run_id rank url citation_id title snippet score document_id language source_domain".split()
    return cited(spark, sf).select(*columns)


@query(
    "turn_sources",
    f"""WITH RECURSIVE {CITED_SQL}, {RUNS_SQL} SELECT user_id, run_id AS session_id, run_id * 100 AS message_id,
        run_id AS web_search_run_id, citation_id, 'web' AS ref_type, url, title, source_domain
        FROM cited JOIN runs USING (run_id)""",
)
def turn_sources(spark, sf):
    return C.turn_sources(cited(spark, sf), runs(spark, sf))


ITEMS_SQL = f"""{CITED_SQL}, items AS (SELECT c.run_id, c.rank AS item, c.title, c.url, c.snippet,
    coalesce(nullif(f.text, ''), c.snippet) AS text
  FROM cited c LEFT JOIN fetched f USING (run_id, url) WHERE c.rank <= 4)"""


def page_items(spark, sf):
    texts = fetched(spark, sf).withColumn("citation_id", X.citation_id(F.col("final_url")))
    return C.citation_page_items(cited(spark, sf), texts, 4)


@query(
    "citation_page_items",
    f"WITH RECURSIVE {ITEMS_SQL} SELECT run_id, item, title, url, md5(snippet) AS snippet_md5, md5(text) AS text_md5 FROM items",
)
def citation_page_items(spark, sf):
    return page_items(spark, sf).select(
        "run_id", "item", "title", "url", F.md5("snippet").alias("snippet_md5"), F.md5("text").alias("text_md5")
    )


@query(
    "build_synthesis_prompt",
    f"""WITH RECURSIVE {ITEMS_SQL}, {RUNS_SQL},
    listed AS (SELECT run_id, string_agg('[' || item || '] 标题：' || title || chr(10) || '    链接：' || url || chr(10)
        || '    内容：' || CASE WHEN length(text) > 1500 THEN substring(text, 1, 1500) || '…' ELSE text END || chr(10),
        chr(10) ORDER BY item) AS listed FROM items GROUP BY 1)
    SELECT run_id, '用户问题：' || query || chr(10) || chr(10) || '检索到的联网结果：' || chr(10) || listed || chr(10)
      || CASE WHEN run_id % 2 = 0 THEN '另外，用户自有文档中检索到的相关片段（供参考、可结合使用）：' || chr(10)
           || '[文档1] own notes' || chr(10) || query || chr(10) || chr(10) ELSE '' END
      || '请基于以上结果，给出整合后的结构化回答，并在文中用 [n] 标注来源。' AS prompt FROM listed JOIN runs USING (run_id)""",
)
def build_synthesis_prompt(spark, sf):
    asked = runs(spark, sf).select("run_id", "query")
    refs = asked.filter("run_id % 2 = 0").select(
        "run_id", F.lit(1).alias("rank"), F.lit("own notes").alias("title"), F.col("query").alias("snippet")
    )
    local = C.local_context(refs, "run_id")
    return C.build_synthesis_prompt(asked.join(local, "run_id", "left"), page_items(spark, sf))


SYNTHESIS_SQL = f"""{RANKED_SQL}, {RUNS_SQL}, saved AS (
    SELECT run_id, any_value(user_id) AS user_id, any_value(query) AS query, 'answer to ' || any_value(query) AS answer,
      '# ' || any_value(query) || chr(10) || chr(10) || 'answer to ' || any_value(query) || chr(10) || chr(10)
      || '## 引用来源' || chr(10) || string_agg('[' || rank || '] ' || title || ' — ' || url || chr(10) || '    '
         || substring(snippet, 1, 400), chr(10) ORDER BY rank) AS content
    FROM ranked JOIN runs USING (run_id) GROUP BY run_id)"""


def saved_answers(spark, sf):
    turns = runs(spark, sf).select(
        "run_id", "user_id", "message_id", "created_at", "query", F.concat(F.lit(" answer to "), "query").alias("answer")
    )
    return C.synthesis_markdown(turns, ranked(spark, sf))


@query(
    "synthesis_markdown",
    f"WITH {SYNTHESIS_SQL} SELECT run_id, content, md5(content) AS content_hash, "
    "'web_syn/' || md5(content) || '.md' AS storage_key FROM saved",
)
def synthesis_markdown(spark, sf):
    return saved_answers(spark, sf).select("run_id", "content", "content_hash", "storage_key")


# --- references and decisions ---


@query(
    "assemble_context",
    M.with_sql(
        M.DOC_SQL,
        HYBRID
        + """ SELECT query_id, string_agg('[Snippet ' || rank || '] Document ' || document_id || ' - ' || document_title
          || chr(10) || snippet, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY 1""",
    ),
)
def assemble_context(spark, sf):
    hits = R.hybrid_topk(M.queries(spark, sf), candidates(spark, sf), 5)
    return C.assemble_context(hits.withColumnRenamed("document_title", "title"))


def _refs(hits):
    return hits.select("query_id", "rank", "document_id", F.col("document_title").alias("title"), "snippet", "score")


@query(
    "merge_refs",
    M.with_sql(
        M.DOC_SQL,
        HYBRID
        + f""", other AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY kw DESC, newest DESC, chunk_id)
              AS rank, document_id, document_title, substring(content, 1, 160) AS snippet, kw AS score
            FROM (SELECT s.query_id, s.kw, c.* FROM scored s JOIN candidates c USING (chunk_id) WHERE kw > 0)),
        both_lists AS (SELECT 0 AS part, query_id, rank, document_id, document_title AS title, snippet, score FROM hits
          UNION ALL SELECT 1, query_id, rank, document_id, document_title, snippet, score FROM other WHERE rank <= 5),
        merged AS (SELECT query_id, document_id, title, snippet, max(score) AS score, min(part * 100 + rank) AS place
          FROM both_lists GROUP BY ALL)
        SELECT query_id, document_id, title, snippet, score,
               row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM merged""",
    ),
)
def merge_refs(spark, sf):
    rows = candidates(spark, sf)
    asked = M.queries(spark, sf)
    return C.merge_refs(_refs(R.hybrid_topk(asked, rows, 5)), _refs(R.keyword_topk(asked, rows, 5)))


@query(
    "merge_local_web_refs",
    M.with_sql(
        M.DOC_SQL,
        HYBRID
        + f""", {RANKED_SQL} SELECT 'local' AS origin, query_id, rank, document_id::VARCHAR AS document_id,
            snippet, NULL AS url FROM hits UNION ALL
        SELECT 'web', run_id, rank, 'web:' || rank, snippet, url FROM ranked""",
    ),
)
def merge_local_web_refs(spark, sf):
    local = R.hybrid_topk(M.queries(spark, sf), candidates(spark, sf), 5)
    local = local.select("query_id", "rank", F.col("document_id").cast("string").alias("document_id"), "snippet")
    web = ranked(spark, sf).select(
        F.col("run_id").alias("query_id"), "rank", F.col("result_id").alias("document_id"), "snippet", "url"
    )
    return C.merge_local_web_refs(local, web).drop("part")


ASKED_SQL = """asked AS (SELECT conv_id * 100 + turn AS message_id, CASE (conv_id * 7 + turn) % 8
    WHEN 0 THEN '帮我搜 ' WHEN 1 THEN '今天 ' WHEN 2 THEN '最近进展 ' WHEN 3 THEN 'Summary of ' WHEN 4 THEN '规则 ' WHEN 5 THEN '案例 '
    WHEN 6 THEN ' 概括 ' ELSE '' END || text AS query,
    CASE WHEN conv_id % 3 = 0 THEN NULL ELSE (conv_id * 13 + turn * 7) % 100 / 100.0::DOUBLE END AS confidence,
    CASE conv_id % 5 WHEN 0 THEN false WHEN 1 THEN true END AS forced,
    CASE WHEN turn % 2 = 0 THEN conv_id END AS document_id FROM conversations)"""


def asked_messages(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    words = ["帮我搜 ", "今天 ", "最近进展 ", "Summary of ", "规则 ", "案例 ", " 概括 ", ""]
    word = F.element_at(F.array(*[F.lit(w) for w in words]), ((c * 7 + t) % 8 + 1).cast("int"))
    return M.table(spark, sf, "conversations").select(
        (c * 100 + t).alias("message_id"),
        F.concat(word, "text").alias("query"),
        F.when(c % 3 != 0, (c * 13 + t * 7) % 100 / F.lit(100.0)).alias("confidence"),
        F.when(c % 5 == 0, False).when(c % 5 == 1, True).alias("forced"),
        F.when(t % 2 == 0, c).alias("document_id"),
    )


@query(
    "detect_web_need",
    f"""
    WITH {ASKED_SQL}, s AS (SELECT *, forced IS NOT DISTINCT FROM false AS off,
        coalesce(forced, false) OR regexp_matches(query, '{C.EXPLICIT_WEB}') AS explicit,
        regexp_matches(query, '{C.STRONG_FRESH}') AS strong, regexp_matches(query, '{C.FRESH}') AS fresh,
        coalesce(confidence < 0.35, false) AS unsure FROM asked)
    SELECT message_id, NOT off AND (explicit OR strong OR (fresh AND unsure)) AS need_web,
      CASE WHEN off THEN '显式关闭联网' WHEN explicit THEN '用户显式要求联网' WHEN strong THEN '命中强时效性关键词'
        WHEN fresh AND unsure THEN '时效性关键词且本地召回置信度不足'
        WHEN fresh OR unsure THEN '信号不足（仅有弱时效性或置信度尚可）' ELSE '无需联网' END AS reason,
      CASE WHEN off THEN '' WHEN explicit THEN 'explicit_web_request' WHEN strong THEN 'strong_freshness'
        ELSE concat_ws(',', CASE WHEN fresh THEN 'freshness_keyword' END, CASE WHEN unsure THEN 'low_local_confidence' END)
        END AS signals FROM s""",
)
def detect_web_need(spark, sf):
    decided = C.detect_web_need(asked_messages(spark, sf), "query", "confidence", "forced")
    return decided.select("message_id", "need_web", "reason", F.array_join("signals", ",").alias("signals"))


def _contains_sql(words) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


@query(
    "classify_summary_request",
    f"""WITH {ASKED_SQL} SELECT message_id, {_contains_sql(R.SUMMARY_WORDS)} AS wants_summary
        FROM (SELECT message_id, lower(trim(query)) AS q FROM asked)""",
)
def classify_summary_request(spark, sf):
    wants = R.classify_summary_request(F.col("query")).alias("wants_summary")
    return asked_messages(spark, sf).select("message_id", wants)


@query(
    "route_prompt",
    f"""WITH {ASKED_SQL} SELECT message_id, CASE WHEN document_id IS NOT NULL AND {_contains_sql(C.SUMMARY_ROUTE)}
          THEN 'document_summary' WHEN {_contains_sql(C.RULE_ROUTE)} THEN 'rule_audit'
          WHEN {_contains_sql(C.CASE_ROUTE)} THEN 'case_reference' ELSE 'knowledge_qa' END AS prompt
        FROM (SELECT *, lower(trim(query)) AS q FROM asked)""",
)
def route_prompt(spark, sf):
    prompt = C.route_prompt(F.col("query"), F.col("document_id")).alias("prompt")
    return asked_messages(spark, sf).select("message_id", prompt)


@query(
    "ingest_decision",
    """
    WITH t AS (SELECT conv_id * 100 + turn AS message_id, ['off', 'ask', 'auto', 'always'][(conv_id % 4 + 1)::INTEGER]
        AS knowledge_mode, CASE WHEN role = 'assistant' THEN text ELSE '' END AS answer, turn % 3 AS citation_count
      FROM conversations)
    SELECT message_id, CASE WHEN knowledge_mode IN ('off', 'ask') OR answer = '' OR citation_count = 0 THEN 0 ELSE 1 END
      AS saved, CASE WHEN knowledge_mode IN ('off', 'ask') THEN citation_count ELSE 0 END::BIGINT AS skipped FROM t""",
)
def ingest_decision(spark, sf):
    modes = F.array(*[F.lit(m) for m in ("off", "ask", "auto", "always")])
    turns = M.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("message_id"),
        F.element_at(modes, (F.col("conv_id") % 4 + 1).cast("int")).alias("knowledge_mode"),
        F.when(F.col("role") == "assistant", F.col("text")).otherwise("").alias("answer"),
        (F.col("turn") % 3).alias("citation_count"),
    )
    return C.ingest_decision(turns).select("message_id", "saved", "skipped")


@query(
    "first_network",
    """
    WITH ips AS (SELECT event_id, '10.' || user_id % 256 || '.' || (event_id // 256) % 256 || '.' || event_id % 256 AS ip,
                   user_id % 256 AS x, (event_id // 256) % 256 AS y FROM events),
    nets AS (SELECT p_partkey % 256 AS x, (p_partkey // 256) % 8 AS y, p_partkey AS o, '10.' || p_partkey % 256 || '.' ||
               (p_partkey // 256) % 8 || '.0/24' AS network FROM part
             UNION ALL SELECT s_suppkey % 256, NULL, 1000000 + s_suppkey, '10.' || s_suppkey % 256 || '.0.0/16' FROM supplier),
    hit AS (SELECT event_id, arg_min(network, o) AS reason FROM ips JOIN nets ON ips.x = nets.x AND (nets.y IS NULL OR nets.y = ips.y)
            GROUP BY 1)
    SELECT event_id, ip, reason FROM ips LEFT JOIN hit USING (event_id)""",
)
def first_network(spark, sf):
    def dotted(*parts):
        return F.concat_ws(".", F.lit("10"), *[p.cast("string") for p in parts])

    e, p, s = F.col("event_id"), F.col("p_partkey"), F.col("s_suppkey")
    ips = M.table(spark, sf, "events").select("event_id", dotted(F.col("user_id") % 256, F.floor(e / 256) % 256, e % 256).alias("ip"))
    small = M.table(spark, sf, "part").select(
        F.concat(dotted(p % 256, F.floor(p / 256) % 8, F.lit(0)), F.lit("/24")).alias("network"), p.alias("rule_order")
    )
    wide = M.table(spark, sf, "supplier").select(
        F.concat(dotted(s % 256, F.lit(0), F.lit(0)), F.lit("/16")).alias("network"), (s + 1_000_000).alias("rule_order")
    )
    return network.first_network(ips, small.unionByName(wide))
