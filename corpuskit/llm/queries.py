"""The operators as queries over the driver tables, with SQL where DuckDB can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuskit import runtime

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            runtime.ship_package(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


EXACT_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""


@query("op3_exact_dedup", EXACT_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    from corpuskit.llm import exact_dedup

    return exact_dedup.exact_groups(documents(spark, sf))


@query("op8_bpe")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from corpuskit.llm import bpe

    return bpe.round_trip(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))


@query("op1_token_files")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from corpuskit.llm import token_files

    docs, folder = documents(spark, sf), f"{runtime.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(docs.select("doc_id").distinct(), folder)


@query("op2_toxicity")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    from corpuskit.llm import toxicity

    docs = documents(spark, sf)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet")))


@query("op4_language")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    from corpuskit.llm import language

    docs = documents(spark, sf)
    return language.predict(docs, language.train(docs))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS x
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) USING (doc_id)
"""


@query("op9_ngram_join", JACCARD_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    from corpuskit.llm import ngram_join

    return ngram_join.jaccard_components(documents(spark, sf))


@query("op10_repeats")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    from corpuskit.llm import repeats

    return repeats.remove_repeats(documents(spark, sf))


@query("op6_embedding_dedup")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    from corpuskit.llm import embedding_dedup

    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query("op5_pii")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    from corpuskit.llm import pii

    docs = documents(spark, sf)
    return pii.find_all(docs, pii.train(docs))


@query("op7_packing")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from corpuskit.llm import packing

    docs = documents(spark, sf)
    return packing.pack(docs, packing.words(F.col("text")), F.col("source"), packing.copies(F.col("text")))


@query("op13_mix")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from corpuskit.llm import mixing

    return mixing.mixed_documents(documents(spark, sf))


@query("op12_spelling")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    from corpuskit.llm import spelling

    return spelling.spelling_groups(documents(spark, sf))


PHRASE_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
f AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (
    SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT c.lang, c.phrase, j, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[:c.j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.j + 1:], ' ')),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM cuts),
hidden AS (SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN candidates d
  ON d.lang = c.lang AND d.k > c.k AND 100 * d.a::HUGEINT >= 80 * c.a::HUGEINT
  AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ')),
ranked AS (SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM candidates JOIN lowest USING (lang, phrase) ANTI JOIN hidden USING (lang, phrase) WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op11_phrases", PHRASE_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    from corpuskit.llm import phrases

    return phrases.collocations(documents(spark, sf))
