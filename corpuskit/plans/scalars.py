"""Scalar functions and filters over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit import runtime
from corpuskit.functions import json_columns as J
from corpuskit.functions import text as X
from corpuskit.functions import urls as U
from corpuskit.functions import vectors as V
from corpuskit.operators import network as N
from corpuskit.operators import patterns
from corpuskit.operators import retrieval as R
from corpuskit.plans import model as M
from corpuskit.plans.registry import query

WS = M.SQL_WS


@query(
    "tokenize",
    f"""SELECT doc_id, len(toks)::BIGINT AS n_tokens, md5(array_to_string(list_sort(toks), ' ')) AS tokens_md5
        FROM (SELECT doc_id, list_distinct({M.sql_tokens('text')}) AS toks FROM documents)""",
)
def tokenize(spark, sf):
    tokens = M.table(spark, sf, "documents").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    return tokens.select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        F.md5(F.array_join(F.array_sort("t"), " ")).alias("tokens_md5"),
    )


WORD_SPLIT_SQL = X.WORD_SPLIT.replace("'", "''")


@query(
    "split_words",
    f"""SELECT doc_id, len(w)::BIGINT AS n_words, md5(array_to_string(w, ' ')) AS words_md5
        FROM (SELECT doc_id, regexp_split_to_array(text, '{WORD_SPLIT_SQL}') AS w FROM documents)""",
)
def split_words(spark, sf):
    words = M.table(spark, sf, "documents").select("doc_id", X.split_words(F.col("text")).alias("w"))
    return words.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5")
    )


@query(
    "keyword_score",
    f"""
    WITH p AS (SELECT doc_id, lower(d.text) AS t, lower(b.text) AS q,
                      list_distinct({M.sql_tokens('d.text')}) AS tt, list_distinct({M.sql_tokens('b.text')}) AS qt
               FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40),
    s AS (SELECT *, CASE WHEN contains(t, q) THEN 3 ELSE 0 END + len(list_intersect(tt, qt)) AS base FROM p)
    SELECT doc_id, (CASE WHEN base > 0 THEN base
        WHEN len(list_filter(qt, lambda w: contains(t, w))) > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM s""",
)
def keyword_score(spark, sf):
    asked = M.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("q"))
    pairs = M.table(spark, sf, "documents").withColumn("item_id", F.col("doc_id") % 40).join(asked, "item_id")
    return pairs.select("doc_id", X.keyword_score(F.col("q"), F.col("text")).alias("score"))


@query(
    "detect_language",
    """
    WITH t AS (SELECT doc_id, repeat('文', (doc_id % 7 * 300)::BIGINT) || text AS text FROM documents)
    SELECT doc_id, CASE WHEN r > 0.5 THEN 'zh' WHEN r > 0.2 THEN 'mixed' ELSE 'en' END AS language
    FROM (SELECT doc_id, length(regexp_replace(text, '[^一-鿿]', '', 'g')) / length(text) AS r FROM t)""",
)
def detect_language(spark, sf):
    mixed = F.concat(F.expr("repeat('文', cast(doc_id % 7 * 300 as int))"), "text")
    return M.table(spark, sf, "documents").select("doc_id", X.detect_language(mixed).alias("language"))


@query(
    "is_soft_404",
    """
    WITH t AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'Page  Not Found' ELSE source END AS title, text
               FROM documents)
    SELECT doc_id, regexp_matches(title || chr(10) || substring(text, 1, 500),
      '(?i)(404|not\\s*found|page\\s*not\\s*found|页面不存在|找不到页面|access\\s*denied|禁止访问|该页面已删除|内容不存在)'
      ) AS soft_404 FROM t""",
)
def is_soft_404(spark, sf):
    title = F.when(F.col("doc_id") % 11 == 0, "Page  Not Found").otherwise(F.col("source"))
    return M.table(spark, sf, "documents").select("doc_id", X.is_soft_404(title, F.col("text")).alias("soft_404"))


@query(
    "quality_score",
    """SELECT doc_id, round(0.6::DOUBLE * least(n_chars / 1500.0::DOUBLE, 1.0::DOUBLE)
          + 0.4::DOUBLE * least((doc_id % 20 / 100.0::DOUBLE) / 0.15::DOUBLE, 1.0::DOUBLE), 3) AS score FROM documents""",
)
def quality_score(spark, sf):
    ratio = F.col("doc_id") % 20 / F.lit(100.0)
    return M.table(spark, sf, "documents").select("doc_id", X.quality_score(F.length("text"), ratio).alias("score"))


@query(
    "head_tail_summary",
    """SELECT doc_id, CASE WHEN length(text) <= 100 THEN text
              ELSE substring(text, 1, 70) || '...' || right(text, 27) END AS summary FROM documents""",
)
def head_tail_summary(spark, sf):
    return M.table(spark, sf, "documents").select("doc_id", X.head_tail_summary(F.col("text"), 100).alias("summary"))


@query(
    "snippet",
    """SELECT doc_id, substring(text, 1, 160) AS snippet, substring(replace(text, chr(10), ' '), 1, 100)
         || CASE WHEN length(text) > 100 THEN '...' ELSE '' END AS preview FROM documents""",
)
def snippet(spark, sf):
    text = F.col("text")
    return M.table(spark, sf, "documents").select(
        "doc_id", X.snippet(text, 160).alias("snippet"), X.preview(text, 100).alias("preview")
    )


SANITIZE_SQL = f"""coalesce(nullif(substring(trim(regexp_replace(regexp_replace(trim(%s, {WS}),
    '[<>:"/\\\\|?*\\x00-\\x1f]+', '-', 'g'), '\\s+', '-', 'g'), ' .-_'), 1, 64), ''), 'report')"""


@query(
    "sanitize_filename",
    "SELECT doc_id, " + SANITIZE_SQL % "(' ' || source || ': ' || lang || '/' || text)" + " AS file_name FROM documents",
)
def sanitize_filename(spark, sf):
    name = F.concat(F.lit(" "), "source", F.lit(": "), "lang", F.lit("/"), "text")
    return M.table(spark, sf, "documents").select("doc_id", X.sanitize_filename(name).alias("file_name"))


CANONICAL_SQL = """
  lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1))
  || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END
  || CASE WHEN len(params) > 0 THEN '?' || array_to_string(list_sort(params), '&') ELSE '' END"""
URL_PARTS_SQL = """
  SELECT *, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
         list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'),
                     lambda p: regexp_matches(p, '=.')) AS params FROM pages"""


@query("canonicalize_url", f"SELECT page_id, {CANONICAL_SQL} AS canonical FROM ({URL_PARTS_SQL})")
def canonicalize_url(spark, sf):
    return M.table(spark, sf, "pages").select("page_id", U.canonicalize_url(F.col("url")).alias("canonical"))


@query("url_host", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages")
def url_host(spark, sf):
    return M.table(spark, sf, "pages").select("page_id", U.url_host(F.col("url")).alias("host"))


DERIVED_URL_SQL = """CASE page_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'ftp' || url WHEN 2 THEN replace(url, '://', ':///')
   ELSE url END"""


@query(
    "url_fetchable",
    f"""
    WITH u AS (SELECT page_id, {DERIVED_URL_SQL} AS url FROM pages),
    e AS (SELECT *, CASE WHEN trim(url) = '' THEN 'URL 为空'
       WHEN regexp_extract(url, '^([A-Za-z]+):', 1) NOT IN ('http', 'https')
         THEN '仅支持 http/https，收到: ' || regexp_extract(url, '^([A-Za-z]+):', 1)
       WHEN regexp_extract(url, '://([^/?#]*)', 1) = '' THEN '缺少主机名' ELSE '' END AS error FROM u)
    SELECT page_id, url, error, error = '' AS fetchable FROM e""",
)
def url_fetchable(spark, sf):
    pages = M.table(spark, sf, "pages").select("page_id", F.expr(DERIVED_URL_SQL).alias("url"))
    return N.url_fetchable(pages)


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return M.table(spark, sf, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("citation_id", "SELECT page_id, 'cit_' || substr(sha256(url), 1, 12) AS citation_id FROM pages")
def citation_id(spark, sf):
    return M.table(spark, sf, "pages").select("page_id", X.citation_id(F.col("url")).alias("citation_id"))


@query("hamming", "SELECT event_id, bit_count(xor(event_id, user_id * 7919))::INTEGER AS distance FROM events")
def hamming(spark, sf):
    return M.table(spark, sf, "events").select(
        "event_id", X.hamming(F.col("event_id"), F.col("user_id") * 7919).alias("distance")
    )


@query(
    "l2_normalize",
    """
    WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings)
    SELECT vec_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS weight FROM c""",
)
def l2_normalize(spark, sf):
    unit = M.table(spark, sf, "embeddings").select(
        "vec_id", F.posexplode(V.l2_normalize(F.col("embedding"))).alias("pos", "w")
    )
    return unit.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("w", 6).alias("weight"))


@query(
    "cosine_clipped",
    """
    SELECT a.vec_id, greatest(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6), 0)::DOUBLE
      AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_clipped(spark, sf):
    a = M.table(spark, sf, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select(
        "vec_id", F.round(V.cosine_clipped(F.col("embedding"), F.col("other")), 6).alias("cosine")
    )


@query("parse_tags", "SELECT doc_id, source || '|' || lang || '|end' AS tags, 3::BIGINT AS n FROM documents")
def parse_tags(spark, sf):
    raw = F.concat(F.lit(" "), "source", F.lit(" ,, "), "lang", F.lit(",\t, end "))
    tags = X.parse_tags(raw)
    return M.table(spark, sf, "documents").select(
        "doc_id", F.array_join(tags, "|").alias("tags"), F.size(tags).cast("long").alias("n")
    )


@query(
    "breadcrumb_parts",
    """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'doc ' || doc_id ELSE source || '|' || lang END AS parts
       FROM documents""",
)
def breadcrumb_parts(spark, sf):
    path = F.when(F.col("doc_id") % 9 == 0, " > ").otherwise(F.concat("source", F.lit(" >> "), "lang", F.lit(" >")))
    parts = X.breadcrumb_parts(path, F.concat(F.lit("doc "), "doc_id"))
    return M.table(spark, sf, "documents").select("doc_id", F.array_join(parts, "|").alias("parts"))


BROKEN_JSON = """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[' || props || ', 7, "x"]'
   WHEN 2 THEN substr(props, 1, 4) ELSE 'null' END"""


@query(
    "safe_json",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN regexp_extract(props, '[0-9]+') END AS k,
              CASE event_id % 4 WHEN 1 THEN 3 ELSE 0 END AS items,
              CASE event_id % 4 WHEN 1 THEN 'x' END AS last_item FROM events""",
)
def safe_json(spark, sf):
    raw = F.expr(BROKEN_JSON)
    items = J.safe_json_list(raw)
    return M.table(spark, sf, "events").select(
        "event_id",
        F.try_element_at(J.safe_json_object(raw), F.lit("k")).alias("k"),
        F.size(items).alias("items"),
        F.try_element_at(items, F.lit(-1)).alias("last_item"),
    )


@query(
    "iso_timestamp",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
         CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END AS iso FROM events""",
)
def iso_timestamp(spark, sf):
    return M.table(spark, sf, "events").select("event_id", X.iso_timestamp(F.col("ts")).alias("iso"))


# --- filters ---


@query(
    "scope_documents",
    M.with_sql(
        "raw_docs",
        """, scopes AS (SELECT user_id, max(domain) AS domain FROM raw_docs GROUP BY 1)
        SELECT document_id, d.user_id, d.domain FROM raw_docs d JOIN scopes s
          ON s.user_id = d.user_id AND s.domain = d.domain WHERE is_published""",
    ),
)
def scope_documents(spark, sf):
    docs = M.raw_docs(spark, sf)
    scopes = docs.groupBy("user_id").agg(F.max("domain").alias("domain"))
    return R.scope_documents(docs, scopes, published_only=True).select("document_id", "user_id", "domain")


@query(
    "scope_private_or_global",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'global' ELSE user_id::VARCHAR END AS user_id
       FROM events WHERE event_type = 'view' OR user_id = 8""",
)
def scope_private_or_global(spark, sf):
    owner = F.when(F.col("event_type") == "view", "global").otherwise(F.col("user_id").cast("string"))
    rows = M.table(spark, sf, "events").select("event_id", owner.alias("user_id"))
    return R.scope_private_or_global(rows, 8)


@query(
    "filter_tags_any",
    "SELECT doc_id, source, lang FROM documents WHERE source IN ('src1', 'src7') OR lang = 'de'",
)
def filter_tags_any(spark, sf):
    tagged = M.table(spark, sf, "documents").select("doc_id", "source", "lang", F.array("source", "lang").alias("tags"))
    return R.filter_tags_any(tagged, ["src1", "src7", "de"]).drop("tags")


@query(
    "filter_safe_text",
    "SELECT doc_id FROM documents WHERE NOT contains(lower(text), 'spam') AND NOT contains(lower(text), 'hack') "
    "AND NOT contains(lower(text), 'license')",
)
def filter_safe_text(spark, sf):
    safe = X.is_safe_text(F.col("text"), (*X.BLOCKLIST, "license"))
    return M.table(spark, sf, "documents").filter(safe).select("doc_id")


# words of the conversations as a list of patterns
WORDS_SQL = """words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS pattern FROM conversations)"""


def _words(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{8,})"))
    return M.table(spark, sf, "conversations").select(F.explode(words).alias("pattern"))


@query(
    "find_patterns",
    f"""WITH {WORDS_SQL} SELECT doc_id, count(*) AS n_patterns, min(pattern) AS first_pattern
        FROM documents JOIN words ON contains(lower(text), pattern) GROUP BY 1""",
)
def find_patterns(spark, sf):
    runtime.ship_package(spark)
    docs = M.table(spark, sf, "documents")
    hits = patterns.find_patterns(docs, "doc_id", F.lower("text"), _words(spark, sf))
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_patterns"), F.min("pattern").alias("first_pattern"))


@query(
    "without_patterns",
    f"""WITH {WORDS_SQL} SELECT doc_id, length(text) AS n_chars FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM documents JOIN words ON contains(lower(text), pattern))""",
)
def without_patterns(spark, sf):
    runtime.ship_package(spark)
    left = patterns.without_patterns(M.table(spark, sf, "documents"), F.lower("text"), _words(spark, sf))
    return left.select("doc_id", F.length("text").cast("long").alias("n_chars"))


# robots files of the pages' hosts: one per host, from the first path segment of its smallest URL
ROBOTS_SQL = """
  hosts AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
                   min(regexp_extract(url, '^[a-z]+://[^/?#]*/([a-z]+)', 1)) AS seg FROM pages GROUP BY 1),
"""


def _robots(spark, sf):
    pages = M.table(spark, sf, "pages").select(
        U.url_host(F.col("url")).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]*/([a-z]+)", 1).alias("seg")
    )
    seg = F.col("seg")
    body = F.concat(
        F.lit("# rules\nDisallow: /nothing\nUser-agent: *\nDisallow: /"), seg, F.lit("/*  # all\nAllow: /"), seg,
        F.lit("/?[0-5]*\nAllow: /"), seg, F.lit("/*.html$\nUser-agent: Otherbot\nDisallow:\n"),
    )
    return pages.groupBy("host").agg(F.min("seg").alias("seg")).select("host", body.alias("body"))


@query(
    "robots_filter",
    "WITH "
    + ROBOTS_SQL
    + """
    p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
                 regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, host, CASE WHEN path GLOB ('/' || seg || '/*.html') THEN true
      WHEN path GLOB ('/' || seg || '/?[0-5]*') THEN true
      WHEN path GLOB ('/' || seg || '/*') THEN false ELSE true END AS allowed FROM p JOIN hosts USING (host)""",
)
def robots_filter(spark, sf):
    checked = N.robots_filter(M.table(spark, sf, "pages"), _robots(spark, sf))
    return checked.select("page_id", "host", "allowed")


IP_SQL = """[10, 8, 127, 172, 192, 93, 169, 0, 198, 203][(event_id % 10 + 1)::INTEGER] || '.' ||
  CASE event_id % 10 WHEN 4 THEN 168 - event_id % 3 WHEN 6 THEN 254 ELSE event_id * 7 % 256 END || '.' ||
  CASE event_id % 20 WHEN 6 THEN 169 ELSE event_id % 256 END || '.' ||
  CASE event_id % 20 WHEN 6 THEN 254 ELSE user_id % 256 END"""


@query(
    "blocked_network_join",
    f"""
    WITH i AS (SELECT 'u' || user_id || '.' || event_type || '.example.com' AS host, event_id AS ip_order,
                      {IP_SQL} AS ip FROM events),
    n AS (SELECT *, string_split(ip, '.')[1]::BIGINT * 16777216 + string_split(ip, '.')[2]::BIGINT * 65536
               + string_split(ip, '.')[3]::BIGINT * 256 + string_split(ip, '.')[4]::BIGINT AS v FROM i),
    nets(pos, net, lo, hi) AS (VALUES (0, 'metadata', 2852039166, 2852039166), (1, '0.0.0.0/8', 0, 16777215),
      (2, '10.0.0.0/8', 167772160, 184549375), (3, '127.0.0.0/8', 2130706432, 2147483647),
      (4, '169.254.0.0/16', 2851995648, 2852061183), (5, '172.16.0.0/12', 2886729728, 2887778303),
      (6, '192.168.0.0/16', 3232235520, 3232301055)),
    r AS (SELECT host, ip_order, ip, arg_min(net, pos) AS reason FROM n LEFT JOIN nets ON v BETWEEN lo AND hi
          GROUP BY ALL)
    SELECT host, count(reason) = 0 AS safe, arg_min(ip, ip_order) FILTER (reason IS NOT NULL) AS blocked_ip,
           arg_min(reason, ip_order) FILTER (reason IS NOT NULL) AS reason FROM r GROUP BY host""",
)
def blocked_network_join(spark, sf):
    first = F.element_at(
        F.array(*[F.lit(o) for o in (10, 8, 127, 172, 192, 93, 169, 0, 198, 203)]), (F.col("event_id") % 10 + 1).cast("int")
    )
    e, u = F.col("event_id"), F.col("user_id")
    second = F.when(e % 10 == 4, 168 - e % 3).when(e % 10 == 6, 254).otherwise(e * 7 % 256)
    third = F.when(e % 20 == 6, 169).otherwise(e % 256)
    fourth = F.when(e % 20 == 6, 254).otherwise(u % 256)
    ips = M.table(spark, sf, "events").select(
        F.concat(F.lit("u"), u, F.lit("."), "event_type", F.lit(".example.com")).alias("host"),
        e.alias("ip_order"),
        F.concat_ws(".", *[c.cast("string") for c in (first, second, third, fourth)]).alias("ip"),
    )
    return N.blocked_network_join(ips)
