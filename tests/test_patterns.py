"""Pattern lists against the plain substring test, and texts put together from many rows."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import text as X
from corpuskit.operators import citations, patterns


def texts(spark, data):
    return spark.createDataFrame(data, "id long, text string, pattern string")


def listed(spark, words):
    return spark.createDataFrame([(w,) for w in words], "pattern string")


def wanted(data, words):
    words = {w for w in words if w}
    return sorted((str(i), w) for i, t, _ in data for w in words if t and w in t)


@pytest.mark.parametrize("block", [patterns.BLOCK_CHARS, 40])
def test_against_substrings(spark, block):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé字😀 ") for _ in range(n))
    data = [(i, word(rng.randint(0, 60)), "x") for i in range(300)]
    data += [(None, "ab ba", "x"), (7, None, "x"), (7, "", "x"), (7, data[0][1], "x"), (8, "a" * 200_000 + "字字b", "x")]
    words = [word(rng.randint(1, 4)) for _ in range(60)] + [None, "", "ab", "ab", "aab", "b" * 100]
    docs, given = texts(spark, data), listed(spark, words)
    found = patterns.find_patterns(docs, "id", F.col("text"), given, block)
    assert found.columns == ["id", "pattern"]
    assert sorted((str(r.id), r.pattern) for r in found.collect()) == wanted(data, words)
    few = ["字字", "aab", "é😀a", None, "é é"] * 3 + ["b" * 60]
    left = patterns.without_patterns(docs, F.col("text"), listed(spark, few), block)
    assert left.columns == docs.columns
    safe = [r for r in data if not any(w and r[1] and w in r[1] for w in few)]
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, safe))
    chain = docs.filter(~F.coalesce(X.contains_any(F.col("text"), tuple(w for w in few if w)), F.lit(False)))
    assert left.count() == chain.count()


def test_many_patterns_of_several_blocks(spark):
    words = [f"w{i:x}." for i in range(100_000)]
    data = [(i, f"see w{i * 977 % 120_000:x}. and w{i:x}.", "x") for i in range(2000)]
    want = sorted((str(i), w) for i, n in ((i, i * 977 % 120_000) for i in range(2000)) for w in {f"w{n:x}.", f"w{i:x}."} if n < 100_000 or w != f"w{n:x}.")
    found = patterns.find_patterns(texts(spark, data), "id", F.col("text"), listed(spark, words), 200_000)
    assert sorted((str(r.id), r.pattern) for r in found.collect()) == want


def test_empty_tables(spark):
    docs, none = texts(spark, [(1, "abc", "x")]), listed(spark, [])
    assert patterns.find_patterns(docs, "id", F.col("text"), none).count() == 0
    assert patterns.without_patterns(docs, F.col("text"), none).count() == 1
    assert patterns.find_patterns(docs.limit(0), "id", F.col("text"), listed(spark, ["a"])).count() == 0


def test_context_of_many_references(spark):
    n = 300_000
    refs = spark.range(n, numPartitions=8).select(
        F.when(F.col("id") >= n - 100, 1).otherwise(F.col("id") % 2).alias("query_id"), (F.lit(n) - F.col("id")).alias("rank"), F.lit("d").alias("document_id"),
        F.lit("t").alias("title"), F.col("id").cast("string").alias("snippet"),
    )
    made = citations.assemble_context(refs, lines=3)
    contexts = {r.query_id: r.context for r in made.collect()}
    assert contexts[1] == "\n\n".join(f"[Snippet {k}] Document d - t\n{n - k}" for k in (1, 2, 3))
    plan = made._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2, plan  # one before and one after the shuffle
    whole = citations.assemble_context(refs.filter("rank <= 40"))
    assert sum(r.context.count("[Snippet") for r in whole.collect()) == 40
