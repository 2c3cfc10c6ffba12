"""Stored indexes against exhaustive search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.operators import postings as N
from corpuskit.operators import topk
from corpuskit.operators import retrieval as R
from corpuskit.operators import vector_index as I

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters in 24 dimensions, two tenants, one of them with most rows, and rows without a direction."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    rows = [(i, 1 if i % 5 else 2, (centres[i % 40] + 0.6 * rng.normal(size=24)).tolist()) for i in range(3000)]
    rows += [(9001, 1, None), (9002, 1, [0.0] * 24), (9003, 2, [1.0] * 23), (9004, 2, [float("nan")] * 24), (9005, None, [1.0] * 24)]
    return spark.createDataFrame(rows, "vec_id long, scope int, embedding array<float>").repartition(4).cache()


def recall(found, exact):
    pairs = lambda df: {(r.query_id, r.vec_id) for r in df.select("query_id", "vec_id").collect()}
    want = pairs(exact)
    return len(pairs(found) & want) / len(want)


def test_recall_and_exact_scores(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "PART_ROWS", 25)
    monkeypatch.setattr(I, "BLOCK_QUERIES", 7)
    path = str(tmp_path / "index")
    model = I.build(vectors, path, "vec_id", "scope", sample_rows=800)
    stored = spark.read.parquet(f"{path}/rows")
    assert stored.count() == vectors.count() and stored.filter("cell = -1").count() == 4
    asked = vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = I.search(asked, path, 10, row_id="vec_id").cache()
    exact = R.vector_topk(asked, vectors.filter("vec_id < 9000"), 10, row_id="vec_id")
    assert recall(found, exact) >= 0.9
    loaded = I.load_model(spark, path)
    assert loaded.probes == model.probes < 20
    assert np.array_equal(loaded.centres, model.centres) and np.array_equal(loaded.codebooks, model.codebooks)
    # no row of another tenant, right order, exact scores
    scope = {r.vec_id: r.scope for r in vectors.collect()}
    table = {r.vec_id: np.array(r.embedding) for r in vectors.filter("vec_id < 9000").collect()}
    by_query = {}
    for r in found.collect():
        assert scope[r.vec_id] == scope[r.query_id]
        a, b = table[r.query_id], table[r.vec_id]
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-5
        by_query.setdefault(r.query_id, []).append((-r.score, r.vec_id, r["rank"]))
    assert all([x[2] for x in sorted(rows)] == list(range(1, 11)) for rows in by_query.values())


def test_all_cells_are_the_exact_search(spark, vectors, tmp_path):
    path = str(tmp_path / "index")
    model = I.build(vectors.filter("vec_id < 600"), path, "vec_id", "scope")
    asked = vectors.filter("vec_id < 60").withColumnRenamed("vec_id", "query_id")
    found = I.search(asked, path, 5, len(model.centres), shortlist=200, row_id="vec_id")
    exact = R.vector_topk(asked, vectors.filter("vec_id < 600"), 5, row_id="vec_id")
    key = lambda df: sorted((r.query_id, r["rank"], r.vec_id) for r in df.collect())
    assert key(found) == key(exact)


def test_added_and_filtered_rows(spark, vectors, tmp_path):
    path = str(tmp_path / "index")
    model = I.build(vectors.filter("vec_id < 1000"), path, "vec_id", "scope")
    I.add(vectors.filter("vec_id >= 1000"), path, "vec_id", "scope")
    asked = vectors.filter("vec_id IN (1500, 2222, 9002, 9005)").withColumnRenamed("vec_id", "query_id")
    found = I.search(asked, path, 1, 4, row_id="vec_id")
    best = {r.query_id: (r.vec_id, r.score) for r in found.collect()}
    assert best[1500] == (1500, 1.0) and best[2222] == (2222, 1.0) and 9005 not in best
    assert best[9002][1] == 0.0
    allowed = vectors.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("row_id"))
    kept = I.search(asked, path, 5, len(model.centres), shortlist=100, allowed=allowed, row_id="vec_id").collect()
    assert kept and all(r.vec_id % 7 == 0 for r in kept)
    assert sum(r.query_id == 1500 for r in kept) == 5


def test_empty(spark, vectors, tmp_path):
    path = str(tmp_path / "index")
    I.build(vectors.limit(0), path, "vec_id", "scope")
    asked = vectors.filter("vec_id = 3").withColumnRenamed("vec_id", "query_id")
    assert I.search(asked, path, 5).count() == 0


def test_a_query_travels_once_whatever_its_probes(spark, vectors, tmp_path):
    model = I.build(vectors, str(tmp_path / "index"), "vec_id", "scope", sample_rows=800)
    asked = vectors.filter("vec_id < 50").withColumnRenamed("vec_id", "query_id")
    placed = I.probes_of(asked, model, 9).collect()
    assert len(placed) == 50 and all(len(r["cells"]) == 10 and r["cells"][-1] == I.NOWHERE for r in placed)


# --- postings ---


def texts(spark):
    rng = np.random.default_rng(4)
    words = ["alpha", "beta", "gamma", "delta", "alphabet", "x1", "foo_bar", "zz", "12", "退款", "规则", "a", "the"]
    rare = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(900):
        own = [words[j] for j in rng.integers(len(words), size=rng.integers(0, 12))] + [rare[j] for j in rng.integers(400, size=3)]
        rows.append((i, int(i % 3 != 0) if i % 50 else None, i % 7, rng.choice([" ", ", ", "", "。"]).join(own).title() if i % 11 else None))
    df = spark.createDataFrame(rows, "chunk_id long, user_id long, newest long, content string")
    return df.selectExpr("*", "newest AS created_at", "chunk_id AS document_id", "'d' AS document_title", "'c' AS chunk_title", "content AS search_text")


ASKED = [
    "alpha", "Alpha beta", "lph", "w17 w18", "w1", "the gamma w3, the", "nothing here", "zz12", "12", "bet", "", "  ", None, "!", "a", "退款", "退", "规则退款",
    "alpha beta gamma delta alphabet x1 zz", "eta g", "W17, The", "foo_bar", "o_b", "a w2", ", ", "w399 w398 w397", "alphabet zz the", "x1the",
]


@pytest.mark.parametrize("k,block,first", [(1, 4, 1), (5, 128, 200), (40, 3, 10)])
def test_postings_give_the_scan(spark, tmp_path, monkeypatch, k, block, first):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "FIRST_ROWS", first)
    rows, path = texts(spark), str(tmp_path / "postings")
    N.build(rows, path)
    asked = [(i, i % 2, t) for i, t in enumerate(ASKED)] + [(100, None, "alpha")] + [(200 + i, 1, t) for i, t in enumerate(ASKED)]
    asked = spark.createDataFrame(asked, "query_id long, user_id long, query_text string")
    got = N.keyword_topk(asked, path, k)
    want = R.keyword_topk(asked, rows, k)
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score, r.snippet) for r in df.collect())
    assert got.columns == want.columns and key(got) == key(want)


def test_postings_read_few_rows(spark, tmp_path):
    """Of rows that share common words only those with the rare ones are read."""
    rows = [(i, 1, i, "common words in every row " * 3 + f"own{i} pair{i // 2} group{i // 20}") for i in range(4000)]
    df = spark.createDataFrame(rows, "chunk_id long, user_id long, newest long, content string")
    df = df.selectExpr("*", "newest AS created_at", "chunk_id AS document_id", "'d' AS document_title", "'c' AS chunk_title", "content AS search_text")
    path = str(tmp_path / "postings")
    N.build(df, path)
    asked = [(i, 1, f"common words in every row group{i} pair{i * 10} own{i * 20}") for i in range(50)]
    asked = spark.createDataFrame(asked, "query_id long, user_id long, query_text string")
    read = N.keyword_scores(asked, path, 3).count()
    assert read < 0.01 * 50 * 4000
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
    assert key(N.keyword_topk(asked, path, 3)) == key(R.keyword_topk(asked, df, 3))


def test_postings_of_nothing(spark, tmp_path):
    path = str(tmp_path / "postings")
    N.build(texts(spark).limit(0), path)
    asked = spark.createDataFrame([(1, 1, "alpha beta")], "query_id long, user_id long, query_text string")
    assert N.keyword_topk(asked, path).count() == 0


@pytest.mark.parametrize("bundle", [50, 1_500_000])
def test_postings_travel_packed_and_keep_every_row(spark, tmp_path, monkeypatch, bundle):
    """Whatever fits in a bundle, a token's blocks hold each of its rows once, and a pack holds many of them."""
    monkeypatch.setattr(N, "BUNDLE", bundle)
    rows, path = texts(spark), str(tmp_path / "postings")
    lower = rows.selectExpr("user_id AS _scope", "chunk_id AS _id", "lower(coalesce(search_text, '')) AS _text").filter("_scope IS NOT NULL")
    packs = N._packed(lower.coalesce(1)).collect()
    want = {}
    for r in lower.collect():
        for token in topk._tokens(r["_text"]):
            want.setdefault((r["_scope"], token), []).append(r["_id"])
    assert (len(packs) == len(want)) == (bundle > 50)
    N.build(rows, path)
    got, tokens = {}, spark.read.parquet(f"{path}/tokens").collect()
    for r in spark.read.parquet(f"{path}/postings").collect():
        assert len(r["ids"]) <= N.BLOCK
        got.setdefault((r["_scope"], r["token"]), []).extend(r["ids"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert {(r["_scope"], r["token"]): r["df"] for r in tokens} == {k: len(v) for k, v in want.items()}


def test_few_rows_are_scored_beside_the_best(spark, tmp_path, monkeypatch):
    """Rows that share many tokens raise the score to reach, so rows that share few are not scored."""
    monkeypatch.setattr(N, "FIRST_ROWS", 5)
    rng = np.random.default_rng(8)
    words = [f"c{j}" for j in range(20)]
    rows = [(i, 1, i, " ".join(rng.choice(words, 6, replace=False)) + " rare" * (i % 40 == 0)) for i in range(1000)]
    rows += [(1000 + i, 1, i, " ".join(words[:19])) for i in range(10)]
    df = spark.createDataFrame(rows, "chunk_id long, user_id long, newest long, content string")
    df = df.selectExpr("*", "newest AS created_at", "chunk_id AS document_id", "'d' AS document_title", "'c' AS chunk_title", "content AS search_text")
    path = str(tmp_path / "postings")
    N.build(df, path)
    asked = spark.createDataFrame([(1, 1, " ".join(reversed([*words, "rare"])))], "query_id long, user_id long, query_text string")
    assert N.keyword_scores(asked, path, 3).count() < 100
    key = lambda found: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in found.collect())
    assert key(N.keyword_topk(asked, path, 3)) == key(R.keyword_topk(asked, df, 3))


def test_cells_do_not_travel_and_blocks_are_few(spark, vectors, tmp_path, monkeypatch):
    """Queries reach the parts without their lists of cells, and rows are repeated for few blocks only."""
    path = str(tmp_path / "index")
    I.build(vectors, path, "vec_id", "scope", sample_rows=800)
    monkeypatch.setattr(I, "LEAST_QUERIES", 10_000)
    found = I.search(vectors.withColumnRenamed("vec_id", "query_id"), path, 5, 9, row_id="vec_id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    sent = [line for line in plan.splitlines() if "FlatMapCoGroupsInArrow" in line]
    assert len(sent) == 1 and "cells" not in sent[0] and "embedding" in plan
    assert found.select("query_id").distinct().count() == vectors.filter("scope IS NOT NULL").count()
    model = I.load_model(spark, path)
    rng = np.random.default_rng(2)
    cells, codes = rng.integers(-1, len(model.centres), 50), rng.integers(0, model.codebooks.shape[1], (50, len(model.codebooks)))
    cells[:5] = I.NOWHERE
    told = model.decoded(cells, codes)
    assert not told[cells == I.NOWHERE].any()
    one = [c + np.concatenate([model.codebooks[j][x] for j, x in enumerate(own)]) for c, own in zip(model.centres[cells], codes)]
    assert np.allclose(told[cells != I.NOWHERE], np.array(one)[cells != I.NOWHERE])


def test_the_index_holds_what_hits_show(spark, tmp_path, monkeypatch):
    """Neither other columns, nor whole contents beside the texts, nor packs stay; shuffles of the build are deleted."""
    monkeypatch.setattr(N, "SENT_ROWS", 3)
    monkeypatch.setattr(N, "ROUND_ROWS", 300)
    rows, path = texts(spark).withColumn("summary", F.lit("s" * 300)).withColumn("content", F.repeat("content", 9)), str(tmp_path / "postings")
    cleaned = []
    deleted = N.runtime.shuffles_deleted
    monkeypatch.setattr(N.runtime, "shuffles_deleted", lambda spark: cleaned.append(1) or deleted(spark))
    N.build(rows, path)
    assert {p.name for p in (tmp_path / "postings").iterdir()} == {"rows", "postings", "tokens", "grams"} and cleaned
    stored = spark.read.parquet(f"{path}/rows")
    assert "summary" not in stored.columns and stored.agg(F.max(F.length("content"))).first()[0] <= 160
    asked = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(ASKED)], "query_id long, user_id long, query_text string")
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score, r.snippet) for r in df.collect())
    assert key(N.keyword_topk(asked, path, 4)) == key(R.keyword_topk(asked, rows, 4))
