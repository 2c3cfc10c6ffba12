"""Fingerprints and duplicates over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import text as X
from corpuskit.operators import dedup as D
from corpuskit.operators import embedding as E
from corpuskit.plans import model as M
from corpuskit.plans.registry import query

# documents with a URL that several of them share
ARRIVALS_SQL = """arrivals AS (SELECT doc_id, text, sha256(text) AS hash,
    'http://' || source || '.example.com/' || lang || '/' || n_chars % 300 AS canonical FROM documents)"""


def arrivals(spark, sf):
    size = (F.col("n_chars") % 300).cast("string")
    host = F.concat(F.lit("HTTP://User@"), F.upper("source"), F.lit(".Example.com:80/"))
    return M.table(spark, sf, "documents").select(
        "doc_id", "text", F.concat(host, "lang", F.lit("/"), size, F.lit("/#top")).alias("url")
    )


def sql_simhash(source: str, key: str, text: str) -> str:
    """64 majority bits over the low 64 bits of the md5 of every token occurrence."""
    return f"""
  tokens AS (SELECT {key}, t, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}),
      '[\\p{{L}}\\p{{N}}_]+')) AS t FROM {source}) GROUP BY ALL),
  hashed AS (SELECT {key}, n, ('0x' || substr(md5(t), 17, 8))::BIGINT AS hi, ('0x' || substr(md5(t), 25, 8))::BIGINT AS lo
             FROM tokens),
  ones AS (SELECT {key}, b, sum(n) AS total, sum(CASE WHEN (CASE WHEN b < 32 THEN lo >> b ELSE hi >> (b - 32) END) & 1 = 1
             THEN n ELSE 0 END) AS n1 FROM hashed, range(64) AS bits(b) GROUP BY ALL),
  prints AS (SELECT {key}, (CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END)::BIGINT AS simhash
    FROM (SELECT {key}, sum(CASE WHEN n1 * 2 > total THEN (2::HUGEINT ** b)::HUGEINT ELSE 0 END) AS v FROM ones GROUP BY 1))"""


@query(
    "simhash64",
    f"WITH {sql_simhash('documents', 'doc_id', 'text')} SELECT doc_id, coalesce(simhash, 0)::BIGINT AS simhash "
    "FROM documents LEFT JOIN prints USING (doc_id)",
)
def simhash64(spark, sf):
    return E.simhash64(M.table(spark, sf, "documents"), "text").select("doc_id", "simhash")


@query(
    "simhash_pairs",
    f"""WITH {sql_simhash('documents', 'doc_id', 'text')},
    fps AS (SELECT DISTINCT simhash AS fp FROM prints)
    SELECT x.fp AS a, y.fp AS b, bit_count(xor(x.fp, y.fp))::INTEGER AS distance FROM fps x JOIN fps y ON x.fp < y.fp
    WHERE bit_count(xor(x.fp, y.fp)) <= 3""",
)
def simhash_pairs(spark, sf):
    return D.simhash_pairs(E.simhash64(M.table(spark, sf, "documents"), "text"))


def sql_greedy(rows: str, key: str) -> str:
    """Sequential pass over rows (i, key, simhash): a list of kept fingerprints, one row per step."""
    return f"""
  pass(i, kept, ids) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL
    SELECT p.i + 1, CASE WHEN fresh THEN list_append(kept, simhash) ELSE kept END,
           CASE WHEN fresh THEN list_append(ids, {key}) ELSE ids END
    FROM (SELECT p.*, r.{key}, r.simhash, len(list_filter(p.kept, lambda k: bit_count(xor(k, r.simhash)) <= 3)) = 0 AS fresh
          FROM pass p JOIN {rows} r ON r.i = p.i + 1) p),
  near AS (SELECT unnest(arg_max(ids, i)) AS {key} FROM pass)"""


@query(
    "dedup_simhash_greedy",
    f"""WITH RECURSIVE {sql_simhash('documents', 'doc_id', 'text')},
    ordered AS MATERIALIZED (SELECT doc_id, simhash, row_number() OVER (ORDER BY doc_id) AS i FROM prints),
    {sql_greedy('ordered', 'doc_id')} SELECT doc_id FROM near""",
)
def dedup_simhash_greedy(spark, sf):
    fps = E.simhash64(M.table(spark, sf, "documents"), "text").select("doc_id", "simhash")
    return D.dedup_simhash_greedy(fps, "doc_id", ["doc_id"]).select("doc_id")


@query("dedup_first_url", f"WITH {ARRIVALS_SQL} SELECT min(doc_id) AS doc_id FROM arrivals GROUP BY canonical")
def dedup_first_url(spark, sf):
    return D.dedup_first_url(arrivals(spark, sf), "doc_id", ["doc_id"]).select("doc_id")


@query("dedup_first_hash", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def dedup_first_hash(spark, sf):
    return D.dedup_first_hash(M.table(spark, sf, "documents"), "doc_id", ["doc_id"]).select("doc_id")


EXACT_SQL = f"""{ARRIVALS_SQL},
  by_url AS (SELECT * FROM arrivals WHERE doc_id IN (SELECT min(doc_id) FROM arrivals GROUP BY canonical)),
  by_hash AS (SELECT * FROM by_url WHERE doc_id IN (SELECT min(doc_id) FROM by_url GROUP BY hash))"""


@query("dedup_exact", f"WITH {EXACT_SQL} SELECT doc_id FROM by_hash")
def dedup_exact(spark, sf):
    return D.dedup_exact(arrivals(spark, sf), "doc_id", ["doc_id"]).select("doc_id")


@query(
    "duplicate_reasons",
    f"""WITH RECURSIVE {EXACT_SQL}, {sql_simhash('by_hash', 'doc_id', 'text')},
    ordered AS MATERIALIZED (SELECT doc_id, simhash, row_number() OVER (ORDER BY doc_id) AS i FROM prints),
    {sql_greedy('ordered', 'doc_id')}
    SELECT doc_id, CASE WHEN doc_id NOT IN (SELECT doc_id FROM by_url) THEN 'url'
        WHEN doc_id NOT IN (SELECT doc_id FROM by_hash) THEN 'hash'
        WHEN doc_id NOT IN (SELECT doc_id FROM near) THEN 'simhash' ELSE '' END AS reason FROM arrivals""",
)
def duplicate_reasons(spark, sf):
    return D.duplicate_reasons(arrivals(spark, sf), "doc_id", ["doc_id"])


@query(
    "known_key_antijoin",
    "SELECT doc_id, sha256(text) AS hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM benchmark) "
    "AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'fr')",
)
def known_key_antijoin(spark, sf):
    docs = M.table(spark, sf, "documents").select("doc_id", "lang", X.content_hash(F.col("text")).alias("hash"))
    known = M.table(spark, sf, "benchmark").select(X.content_hash(F.col("text")).alias("hash"))
    stored = known.unionByName(docs.filter("lang = 'fr'").select("hash"))
    return D.known_key_antijoin(docs.drop("lang"), stored, "hash")
