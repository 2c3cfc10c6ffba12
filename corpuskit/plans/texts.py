"""Queries for functions whose work the other queries leave out: protected ranges and the named SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions.registry import register_all
from corpuskit.operators import chunking as K
from corpuskit.plans import model as M
from corpuskit.plans.corpus import sql_chunks, sql_keywords
from corpuskit.plans.duplicates import sql_simhash
from corpuskit.plans.registry import query


# every document inside a fence, then a table of two rows
@query(
    "protected_ranges",
    """WITH t AS (SELECT doc_id, 6 AS fence, 6 + 4 + length(text) + 4 AS fenced,
        length('| ' || source || ' | ' || lang || ' |') + 1 + length('| --- | --- |') AS rows FROM documents)
    SELECT doc_id, 'fence' AS kind, fence::BIGINT AS "start", fenced::BIGINT AS "end" FROM t
    UNION ALL SELECT doc_id, 'table', fenced + 1, fenced + 1 + rows FROM t""",
)
def protected_ranges(spark, sf):
    parts = [F.lit("intro\n```\n"), F.translate("text", "`|", "''"), F.lit("\n```\n| "), "source", F.lit(" | "), "lang"]
    docs = M.table(spark, sf, "documents").withColumn("text", F.concat(*parts, F.lit(" |\n| --- | --- |\nend")))
    return docs.select("doc_id", F.explode(K.protected_column(F.col("text"))).alias("r")).select("doc_id", "r.*")


@query(
    "text_sql_functions",
    f"""WITH RECURSIVE {sql_chunks('documents', 'doc_id', 500, 80)}, {sql_keywords('documents', 'doc_id', 'text')},
      {sql_simhash('documents', 'doc_id', 'text')},
      many AS (SELECT doc_id, count(*) AS n, sum(length(content)) AS chars FROM pieces GROUP BY 1)
    SELECT doc_id, coalesce(simhash, 0)::BIGINT AS simhash, n::BIGINT AS chunks, coalesce(keywords, '') AS keywords,
      n::BIGINT AS rows, chars::BIGINT AS chars, chr(39) || 'id' || chr(92) || chr(39) AS user_id
    FROM documents LEFT JOIN prints USING (doc_id) LEFT JOIN many USING (doc_id) LEFT JOIN keywords USING (doc_id)""",
)
def text_sql_functions(spark, sf):
    register_all(spark, "'id\\'")
    M.table(spark, sf, "documents").createOrReplaceTempView("ck_documents")
    return spark.sql(
        """WITH cut AS (SELECT doc_id, count(*) AS rows, sum(length(content)) AS chars
             FROM ck_documents, LATERAL ck_text_chunks(text, 500, 80) GROUP BY doc_id)
           SELECT doc_id, ck_simhash(text).value AS simhash, CAST(size(ck_chunks(text).value) AS BIGINT) AS chunks,
             array_join(ck_keywords(text).value, ' ') AS keywords, rows, chars, ck_user_id() AS user_id
           FROM ck_documents LEFT JOIN cut USING (doc_id)"""
    )
