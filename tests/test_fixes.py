"""Inputs that the driver tables lack: null and huge owners, padded queries, odd names, hubs, repeated saves."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.functions.registry import register_all
from corpuskit.operators import documents, embedding, pages, retrieval, structure
from corpuskit.operators.html import extract_page
from corpuskit.sources import readers, sinks
from corpuskit.streaming import jobs as J

BIG = 2**53


def candidates(spark, rows, when="timestamp"):
    """(chunk_id, user_id, content, seconds)"""
    df = spark.createDataFrame(rows, "chunk_id long, user_id long, content string, at double")
    return df.select(
        "chunk_id",
        "user_id",
        F.col("chunk_id").alias("document_id"),
        F.lit("t").alias("document_title"),
        F.lit("c").alias("chunk_title"),
        "content",
        F.col("content").alias("search_text"),
        F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).cast(when).alias("created_at"),
    ).coalesce(1)


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, user_id long, query_text string")


@pytest.mark.parametrize("search", [retrieval.keyword_topk, retrieval.hybrid_topk])
@pytest.mark.parametrize("row_limit", [0, 5000])
def test_no_rows_of_neighbouring_owners(spark, search, row_limit):
    rows = [(i, owner, "support email", 0.0) for i, owner in enumerate([BIG + 1, None, BIG, BIG + 2, None, -BIG - 1])]
    queries = asked(spark, [(1, BIG, "support email"), (2, BIG + 1, "support email"), (3, None, "support email")])
    found = search(queries, candidates(spark, rows), 5, row_limit=row_limit)
    assert sorted((r.query_id, r.chunk_id) for r in found.collect()) == [(1, 2), (2, 0)]


def test_padded_and_blank_queries(spark):
    rows = [(1, 1, "write to our support email", 1.0), (2, 1, "opening hours", 2.0), (3, 2, "support email", 3.0)]
    queries = asked(spark, [(1, 1, "  support email \n"), (2, 1, "support email"), (3, 1, " \t\n"), (4, 1, None)])
    found = retrieval.hybrid_topk(queries, candidates(spark, rows), 5).collect()
    hits = {q: [(r.rank, r.chunk_id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in range(1, 5)}
    assert hits[1] == hits[2]
    assert hits[3] == hits[4] == [(1, 2, 0.5), (2, 1, 0.5)]
    words = retrieval.keyword_topk(queries, candidates(spark, rows), 5).collect()
    assert {r.score for r in words if r.query_id < 3} == {5.0} and not [r for r in words if r.query_id > 2]
    docs = spark.createDataFrame([(1, 1, "t", "s")], "document_id long, user_id long, title string, summary string")
    docs = docs.withColumn("created_at", F.current_timestamp())
    blank = retrieval.search_documents(queries.filter("query_id = 3"), candidates(spark, rows), docs).collect()
    assert {r.document_id for r in blank} == {1, 2}


@pytest.mark.parametrize("when", ["timestamp", "timestamp_ntz"])
def test_newest_within_a_second(spark, when):
    rows = [(1, 1, "support email", 0.1), (2, 1, "support email", 0.9), (3, 1, "support email", 0.5)]
    found = retrieval.keyword_topk(asked(spark, [(1, 1, "email")]), candidates(spark, rows, when), 3)
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == [2, 3, 1]


def test_partial_words_score_half(spark):
    rng = random.Random(2)
    rows = [(i, 1, " ".join(rng.choice(["emails", "hours", "supporting", "open"]) for _ in range(3)), 0.0) for i in range(40)]
    queries = [(q, 1, rng.choice(["email", "support hour", "ope", "zz"])) for q in range(90)]
    found = retrieval.keyword_topk(asked(spark, queries), candidates(spark, rows), 100).collect()
    text = {i: t for i, _, t, _ in rows}
    want = set()
    for q, _, query in queries:
        for i, t in text.items():
            words = set(query.split())
            score = len(words & set(t.split())) + 3.0 * (query in t)
            score = score or 0.5 * any(w in t for w in words)
            if score:
                want.add((q, i, score))
    assert {(r.query_id, r.chunk_id, r.score) for r in found} == want


def test_all_links_and_whole_link_texts():
    body = "".join(f'<a href="/p{i}">{"x" * 300}{i}</a> ' for i in range(250))
    links = extract_page(f"<html><body><article><p>{'word ' * 60}</p>{body}</article></body></html>", "http://h/")["links"]
    assert len(links) == 250 and links[-1]["text"] == "x" * 300 + "249"


def test_stray_end_tags_are_cheap():
    start = time.perf_counter()
    extract_page("<div>" * 8000 + "</b>" * 8000 + "text", "http://h/")
    assert time.perf_counter() - start < 3


def test_headings_only_upload(spark):
    text = "\n".join(f"# heading {i}" for i in range(500))
    docs = spark.createDataFrame([(1, "t", text, ".md")], "document_id long, title string, text string, extension string")
    chunks = documents.ingest_user_documents(docs)[1].orderBy("chunk_index").collect()
    assert all(any(f"heading {i}" in c.content for c in chunks) for i in range(500))
    assert [c.chunk_index for c in chunks] == list(range(len(chunks)))


def test_chunk_ids_of_equal_names(spark, tmp_path):
    rows = [("readme", "one text", ".txt", "d", "k", f"/{f}/readme.txt") for f in "ab"]
    docs = spark.createDataFrame(rows, "doc_id string, text string, extension string, domain string, doc_type string, source string")
    assert documents.ingest_corpus(docs).select("chunk_id").distinct().count() == 2
    lines = "\n".join('{"title": "t%d", "sections": [{"heading": "h", "content": "c"}]}' % i for i in range(5))
    (tmp_path / "many.json").write_text(lines)
    chunks = documents.ingest_json_sections(readers.scan_json_docs(spark, str(tmp_path), multiline=False))
    assert chunks.count() == chunks.select("chunk_id").distinct().count() == 5


def test_file_names(spark, tmp_path):
    for name in ("退款 规则.md", "a+b 100%.txt"):
        (tmp_path / name).write_text("text")
    found = readers.scan_text_dir(spark, str(tmp_path))
    assert {r.doc_id for r in found.collect()} == {"退款 规则", "a+b 100%"}


def test_saves_without_a_url(spark):
    key = "user_id long, canonical_url string, source_type string"
    docs = spark.createDataFrame([], f"{key}, document_id long, title string, summary string, last_fetched_at timestamp, current_version_id long")
    versions = spark.createDataFrame([], "document_id long, version_id long, version_no long, content_hash string, created_at timestamp")
    for n in range(3):
        rows = [(1, None, "web", 10 + n, 50 + n, f"t{n}", "s", f"h{n}")]
        new = spark.createDataFrame(rows, f"{key}, document_id long, version_id long, title string, summary string, content_hash string")
        docs, versions = sinks.upsert_document_version(docs, versions, new.withColumn("fetched_at", F.timestamp_seconds(F.lit(n))))
    assert [(r.document_id, r.current_version_id, r.title) for r in docs.collect()] == [(10, 52, "t2")]
    assert sorted((r.document_id, r.version_no, r.version_id) for r in versions.collect()) == [(10, 1, 50), (10, 2, 51), (10, 3, 52)]


def test_repeated_saves_do_not_double_sources(spark):
    sources = spark.createDataFrame([(1, 7, None), (2, 8, 3)], "source_id long, message_id long, document_version_id long")
    saved = spark.createDataFrame([(7, 20), (7, 21)], "message_id long, document_version_id long")
    found = sinks.backfill_source_version(sources, saved).collect()
    assert sorted((r.source_id, r.document_version_id) for r in found) == [(1, 21), (2, 3)]


@pytest.mark.parametrize("user", ["x\\' || 'global", "o'neil\\", "', 'global", 7])
def test_user_ids_stay_literals(spark, user):
    register_all(spark, user)
    assert spark.sql("SELECT ck_user_id() AS u").first().u == str(user)


def brute_neighbors(nodes, edges, start, k):
    order = {n: i for i, n in enumerate(nodes)}
    around = {}
    for a, b, kind, w in edges:
        around.setdefault(a, []).append((b, kind, w))
        around.setdefault(b, []).append((a, kind, w))
    best = {}
    frontier = {}
    for b, kind, w in around.get(start, []):
        if b != start:
            frontier[b] = min(frontier.get(b, (0, "~")), (-w, kind))
    while frontier:
        best |= frontier
        new = {}
        for u, (score, _) in frontier.items():
            for b, kind, _ in around[u]:
                if b != start:
                    new[b] = min(new.get(b, (0, "~")), (score / 2, kind))
        frontier = {b: v for b, v in new.items() if v[0] < best.get(b, (0,))[0] and -v[0] > 1e-9}
    return [n for n in sorted(best, key=lambda n: (best[n][0], order[n]))[:k]]


def test_neighbors_around_a_hub(spark):
    nodes = [f"n{i:03}" for i in range(120)]
    edges = [("n000", n, "sub", 1.0) for n in nodes[1:90]] + [(nodes[i], nodes[i + 30], "term", 2.0) for i in range(60, 90)]
    edges = [(a, b, kind, w) for a, b, kind, w in edges]
    n = spark.createDataFrame([(1, x, i, x) for i, x in enumerate(nodes)], "document_id long, section_id string, ordinal long, title string")
    e = spark.createDataFrame([(1, *x) for x in edges], "document_id long, src string, dst string, type string, weight double")
    starts = n.select("document_id", F.col("section_id").alias("start"))
    got = {}
    for r in structure.concept_neighbors(n, e, starts, k=5).orderBy("rank").collect():
        got.setdefault(r.start, []).append(r.section_id)
    assert got == {s: b for s in nodes if (b := brute_neighbors(nodes, edges, s, 5))}


def test_page_that_arrives_twice(spark, tmp_path):
    def page(i, word):
        return (i, f"http://h/{i}", f"<html><title>t</title><body><article>{f'<p>{word} words of a page.</p>' * 60}</article></body></html>")

    for n, part in enumerate([[page(1, "old"), page(2, "old")], [page(1, "new")]]):
        spark.createDataFrame(part, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
        assert n < 2
    stream = spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    J.stream_ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    chunks = J.ingested_chunks(spark, str(tmp_path / "out")).collect()
    assert {(c.page_id, "new" in c.content, "old" in c.content) for c in chunks} == {(1, True, False), (2, False, True)}
    assert len({(c.page_id, c.chunk_index) for c in chunks}) == len(chunks)


def test_first_arrivals_by_order(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, f"http://h/{rng.integers(0, 20)}" if i % 9 else "", f"text {rng.integers(0, 15)}" if i % 7 else "") for i in range(90)]
    kept, urls, texts = [], set(), set()
    batches = [rows[:40], rows[40:70], rows[70:]]
    for part in batches:
        spark.createDataFrame(part[::-1], "id long, url string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    for i, u, t in rows:
        if u and u in urls:
            continue
        urls.add(u)
        if t and t in texts:
            continue
        texts.add(t)
        kept.append(i)
    stream = spark.readStream.schema("id long, url string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    J.stream_first_arrivals(stream, out, str(tmp_path / "state"), "id", ["id"]).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == kept


def test_json_uploads(spark):
    text = '{"title": "Guide", "domain": "support", "sections": [{"heading": "Hours", "content": "nine to five"}, {"content": "more"}]}'
    rows = [(1, "t", text, ".json"), (2, "u", "{broken", ".json"), (3, "v", None, ".json")]
    docs = spark.createDataFrame(rows, "document_id long, title string, text string, extension string")
    listed, chunks = documents.ingest_user_documents(docs)
    found = sorted((c.document_id, c.chunk_index, c.chunk_title, c.content) for c in chunks.collect())
    assert found == [(1, 0, "Guide > Hours", "nine to five"), (1, 1, "Guide", "more"), (2, 0, "u", "{broken")]
    assert {r.document_id: r.status for r in listed.collect()} == {1: "ready", 2: "ready", 3: "failed"}
    given = spark.createDataFrame([("g", text, ".json", "d", "rule", "/g.json")], "doc_id string, text string, extension string, domain string, doc_type string, source string")
    assert {(c.domain, c.doc_type) for c in documents.ingest_corpus(given).collect()} == {("support", "rule")}


def test_a_page_of_two_runs(spark):
    body = "".join(f"<p>{w} words of a page that is long enough to pass.</p>" * 30 for w in "ab")
    html = f"<html><title>t</title><body><article>{body}</article></body></html>"
    other = html.replace("words", "lines").replace("page", "leaf").replace("long", "wide").replace("enough", "as can be")
    page_rows = [("http://h/1", html), ("http://h/2", html), ("http://h/1/", other), ("http://h/3", "<p>short</p>"), ("http://h/4", other)]
    page_table = spark.createDataFrame(page_rows, "url string, html string")
    wanted = [(1, 1, "http://h/1"), (1, 2, "http://h/2"), (1, 3, "http://h/1/"), (2, 1, "http://h/2"), (2, 2, "http://h/3"), (2, 3, "http://h/4")]
    kept = pages.fetched_pages(spark.createDataFrame(wanted, "run_id long, rank long, url string"), page_table)
    assert {(r.run_id, r.url) for r in kept.collect()} == {(1, "http://h/1"), (2, "http://h/2"), (2, "http://h/4")}


def test_stored_vectors_give_the_hits_of_texts(spark):
    rng = random.Random(4)
    words = "support email opening hours returns refund contact order late parcel".split()
    rows = [(i, 1, " ".join(rng.choice(words) for _ in range(8)), float(i)) for i in range(60)]
    queries = asked(spark, [(q, 1, " ".join(rng.choice(words) for _ in range(2))) for q in range(8)])
    found = candidates(spark, rows)
    text = retrieval.hybrid_topk(queries, found, 4).collect()
    stored = retrieval.hybrid_topk(
        embedding.hash_embedding(queries, "query_text"), embedding.hash_embedding(found, "search_text"), 4, vector="stored"
    ).collect()
    by_place = [{(r.query_id, r.rank): r.score for r in x} for x in (text, stored)]
    assert by_place[0].keys() == by_place[1].keys()
    assert all(abs(by_place[0][k] - by_place[1][k]) < 1e-5 for k in by_place[0])


def test_repeated_json_documents_have_their_own_chunks(spark, tmp_path):
    from corpuskit.operators import documents as D
    from corpuskit.sources import readers

    line = '{"title": "t", "sections": [{"heading": "h", "content": "%s"}]}'
    (tmp_path / "a.jsonl").write_text("\n".join([line % "one"] * 3 + [line % "two"]))
    (tmp_path / "b.jsonl").write_text(line % "one")
    chunks = D.ingest_json_sections(readers.scan_json_docs(spark, str(tmp_path), multiline=False))
    assert chunks.count() == chunks.select("chunk_id").distinct().count() == 5
    again = D.ingest_json_sections(readers.scan_json_docs(spark, str(tmp_path), multiline=False))
    assert {r.chunk_id for r in chunks.collect()} == {r.chunk_id for r in again.collect()}
