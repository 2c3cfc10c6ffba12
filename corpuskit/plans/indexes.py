"""Searches over stored indexes: vector cells, postings of tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.operators import postings as N
from corpuskit.operators import retrieval as R
from corpuskit.operators import vector_index as I
from corpuskit.plans import model as M
from corpuskit.plans import search as S
from corpuskit.plans.registry import query
from corpuskit.plans.storage import scratch


def tenants(spark, sf):
    return M.table(spark, sf, "embeddings").withColumn("scope", F.col("vec_id") % 2)


def indexed(spark, sf, k):
    vectors = tenants(spark, sf)
    path = scratch(spark, "vectors")
    I.build(vectors, path, "vec_id", "scope")
    asked = vectors.withColumnRenamed("vec_id", "query_id")
    return I.search(asked, path, k, row_id="vec_id")


@query("vector_index_topk")
def vector_index_topk(spark, sf):
    """Every row asks for its ten nearest rows of its own tenant."""
    return indexed(spark, sf, 10)


@query("vector_index_recall", "SELECT count(*) AS queries, true AS recall_is_090, true AS scores_are_exact FROM embeddings")
def vector_index_recall(spark, sf):
    """Share of the ten nearest rows of each row that the index finds, against the exact search."""
    vectors = tenants(spark, sf)
    exact = R.vector_topk(vectors.withColumnRenamed("vec_id", "query_id"), vectors, 10, row_id="vec_id")
    found = indexed(spark, sf, 10).select("query_id", "vec_id", F.col("score").alias("own"))
    both = exact.join(found, ["query_id", "vec_id"], "left")
    return both.agg(
        F.count_distinct("query_id").alias("queries"),
        (F.count("own") >= 0.9 * F.count("*")).alias("recall_is_090"),
        F.coalesce(F.max(F.abs(F.col("own") - F.col("score"))) <= 2e-6, F.lit(False)).alias("scores_are_exact"),
    )


@query(
    "keyword_index_topk",
    M.with_sql(
        M.DOC_SQL,
        S.BY_USER + S.sql_pairs() + "," + S.sql_hits("kw", 5, "kw > 0") + f" SELECT {S.HIT_COLUMNS} FROM hits",
    ),
)
def keyword_index_topk(spark, sf):
    """The keyword search of all benchmark texts, answered from stored postings."""
    path = scratch(spark, "postings")
    N.build(S.candidates(spark, sf), path)
    return N.keyword_topk(M.queries(spark, sf), path, 5)
