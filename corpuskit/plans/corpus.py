"""Sections, chunks, keywords, summaries, tables and the ingest of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions.text import STOPWORDS, WORD_SPLIT
from corpuskit.operators import documents as D
from corpuskit.plans import model as M
from corpuskit.plans.registry import query

WS = M.SQL_WS

# Markdown from the documents: the source is the title, every later line gets a heading that
# alternates between level 3 and level 2.
MARKDOWN_SQL = """lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
    unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
  sections AS (SELECT doc_id, i, trim(line, {ws}) AS content, CASE WHEN i = 0 THEN source
      WHEN i % 2 = 1 THEN source || CASE WHEN i > 1 THEN ' > even' ELSE '' END || ' > odd'
      ELSE source || ' > even' END AS title_path FROM lines WHERE trim(line, {ws}) <> '')""".format(ws=WS)


def markdown_docs(spark, sf):
    numbered = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when(i == 0, line)
        .when(i % 2 == 1, F.concat(F.lit("### odd \n"), line))
        .otherwise(F.concat(F.lit("##  even\n"), line)),
    )
    return M.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.lit("# "), "source", F.lit("\n"), F.array_join(numbered, "\n")).alias("text"),
        F.lit(".md").alias("extension"),
        F.col("source").alias("domain"),
    )


@query(
    "split_markdown_sections",
    f"""WITH {MARKDOWN_SQL} SELECT doc_id::VARCHAR AS doc_id, title_path, content,
        row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS section_index FROM sections""",
)
def split_markdown_sections(spark, sf):
    docs = markdown_docs(spark, sf).select("doc_id", "text")
    return D.split_markdown_sections(docs)


def sql_chunks(source: str, key: str, size: int, overlap: int) -> str:
    """Chunker for texts without fences, tables and CJK: windows cut at line breaks past their half."""

    def cut(sep: str, width: int) -> str:
        at = f"length(win) - strpos(reverse(win), {sep}) + {1 if width == 1 else 0} - {width}"
        return f"CASE WHEN strpos(reverse(win), {sep}) > 0 AND {at} > {size / 2} THEN s + {at} + {width} END"

    return f"""
  spans(k, s, e) AS (
    SELECT {key}, -1::BIGINT, {overlap}::BIGINT FROM {source} WHERE length(text) > {size}
    UNION ALL
    SELECT k, s, CASE WHEN s + {size} >= n THEN s + {size} ELSE coalesce({cut("chr(10) || chr(10)", 2)},
        {cut("chr(10)", 1)}, s + {size}) END
    FROM (SELECT p.k, p.e - {overlap} AS s, length(d.text) AS n, substring(d.text, p.e - {overlap} + 1, {size}) AS win
          FROM spans p JOIN {source} d ON d.{key} = p.k AND p.e - {overlap} < length(d.text))),
  cuts AS (SELECT {key}, s, trim(substring(text, s + 1, e - s), {WS}) AS content FROM spans JOIN {source} ON {key} = k
           WHERE s >= 0 UNION ALL SELECT {key}, 0, text FROM {source} WHERE length(text) <= {size}),
  pieces AS (SELECT {key}, content, row_number() OVER (PARTITION BY {key} ORDER BY s) - 1 AS chunk_index FROM cuts
             WHERE content <> '')"""


@query(
    "chunk_text",
    f"WITH RECURSIVE {sql_chunks('documents', 'doc_id', 600, 120)} SELECT doc_id, chunk_index, content FROM pieces",
)
def chunk_text(spark, sf):
    return D.chunk_text(M.table(spark, sf, "documents").select("doc_id", "text"), "text", 600, 120)


@query("window_chunks", M.with_sql("raw_docs chunks", "SELECT chunk_id, content FROM chunks"))
def window_chunks(spark, sf):
    return M.chunks(spark, sf).select("chunk_id", "content")


WORDS_SQL = WORD_SPLIT.replace("'", "''")
STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS.split())


def sql_keywords(source: str, key: str, text: str) -> str:
    return f"""
  words AS (SELECT {key}, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos
            FROM (SELECT {key}, regexp_split_to_array({text}, '{WORDS_SQL}') AS ws FROM {source})),
  counted AS (SELECT {key}, w, count(*) AS n, min(pos) AS first FROM words
              WHERE length(w) >= 2 AND w NOT IN ({STOP_SQL}) GROUP BY ALL),
  keywords AS (SELECT {key}, string_agg(w, ' ' ORDER BY n DESC, first) AS keywords FROM (SELECT *, row_number() OVER
      (PARTITION BY {key} ORDER BY n DESC, first) AS r FROM counted) WHERE r <= 5 GROUP BY 1)"""


@query(
    "extract_keywords",
    M.with_sql(
        "raw_docs chunks",
        f""", {sql_keywords('chunks', 'chunk_id', 'content')}
        SELECT chunk_id, coalesce(keywords, '') AS keywords FROM chunks LEFT JOIN keywords USING (chunk_id)""",
    ),
)
def extract_keywords(spark, sf):
    tagged = D.extract_keywords(M.chunks(spark, sf).select("chunk_id", "content"))
    return tagged.select("chunk_id", F.array_join("keywords", " ").alias("keywords"))


@query(
    "document_summary",
    M.with_sql("raw_docs chunks summaries", "SELECT document_id, summary FROM summaries"),
)
def document_summary(spark, sf):
    return M.docs(spark, sf).select("document_id", "summary")


@query(
    "ingest_corpus",
    f"""WITH {MARKDOWN_SQL},
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS section_index FROM sections),
    parts AS (SELECT *, unnest(CASE WHEN length(content) <= 500 THEN [0] ELSE
        range(0, ceil(length(content) / 420.0)::BIGINT) END) AS p FROM numbered),
    cut AS (SELECT *, CASE WHEN length(content) <= 500 THEN content ELSE trim(substring(content, p * 420 + 1, 500), {WS})
              END AS piece FROM parts),
    chunked AS (SELECT doc_id, title_path, section_index, piece, row_number() OVER (PARTITION BY doc_id, section_index
              ORDER BY p) - 1 AS part_index FROM cut WHERE piece <> ''),
    ids AS (SELECT *, sha256('{{"doc_id":"' || doc_id || '","section_index":' ||
              section_index || ',"part_index":' || part_index || '}}') AS chunk_id FROM chunked),
    {sql_keywords('ids', 'chunk_id', 'piece')}
    SELECT chunk_id, doc_id::VARCHAR AS doc_id, title_path, title_path AS title, piece AS content,
           coalesce(keywords, '') AS keywords FROM ids LEFT JOIN keywords USING (chunk_id)""",
)
def ingest_corpus(spark, sf):
    chunks = D.ingest_corpus(markdown_docs(spark, sf))
    return chunks.select(
        "chunk_id", "doc_id", "title_path", "title", "content", F.array_join("keywords", " ").alias("keywords")
    )


# uploads: plain text; every 17th document lost its text
def uploads(spark, sf):
    return M.table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.concat(F.lit("doc "), "doc_id").alias("title"),
        F.when(F.col("doc_id") % 17 != 0, F.col("text")).alias("text"),
        F.lit(".txt").alias("extension"),
    )


UPLOADS_SQL = f"""uploads AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 17 <> 0 THEN text END AS text FROM documents),
  {sql_chunks('uploads', 'document_id', 600, 120)},
  final AS (SELECT document_id, chunk_index, trim(content, {WS}) AS content FROM pieces)"""


@query(
    "ingest_user_documents",
    f"""WITH RECURSIVE {UPLOADS_SQL}, s AS (SELECT document_id, substring(trim(string_agg(content, chr(10) || chr(10)
      ORDER BY chunk_index), {WS}), 1, 500) AS summary FROM final WHERE chunk_index < 2 GROUP BY 1)
    SELECT u.document_id, 'doc ' || u.document_id AS title, CASE WHEN text IS NULL THEN 'failed' ELSE 'ready' END AS status,
      CASE WHEN text IS NULL THEN 'Parsing failed: text is missing' ELSE s.summary END AS summary
    FROM uploads u LEFT JOIN s USING (document_id)""",
)
def ingest_user_documents(spark, sf):
    return D.ingest_user_documents(uploads(spark, sf))[0]


@query(
    "ingest_user_chunks",
    f"""WITH RECURSIVE {UPLOADS_SQL}
    SELECT document_id, chunk_index, document_id::VARCHAR AS chunk_title, content FROM final""",
)
def ingest_user_chunks(spark, sf):
    return D.ingest_user_documents(uploads(spark, sf))[1]


@query(
    "rows_to_markdown_table",
    """
    WITH r AS (SELECT p_brand AS brand, p_partkey AS row_index, '| ' || p_name || ' | ' || p_type || ' x | ' ||
                 CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE '' END || ' |' AS line FROM part)
    SELECT brand, row_index, 0 AS part, line FROM r UNION ALL
    SELECT brand, min(row_index), 1, '| --- | --- | --- |' FROM r GROUP BY brand""",
)
def rows_to_markdown_table(spark, sf):
    size = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))
    cells = F.array(F.concat(F.lit(" "), "p_name"), F.concat("p_type", F.lit("\nx")), size)
    rows = M.table(spark, sf, "part").select(
        F.col("p_brand").alias("brand"), F.col("p_partkey").alias("row_index"), cells.alias("cells")
    )
    blank = rows.withColumn("row_index", -F.col("row_index")).withColumn("cells", F.array(F.lit(" "), F.lit(None)))
    return D.rows_to_markdown_table(rows.unionByName(blank), "brand")
