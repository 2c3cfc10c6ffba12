"""Operators on small tables: golden cases, brute-force checks, and the paths for large groups."""

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuskit import runtime
from corpuskit.functions.registry import register_all
from corpuskit.operators import citations, conversations, dedup, documents, network, retrieval, structure, topk
from corpuskit.operators import embedding as E
from corpuskit.plans import model as M
from corpuskit.plans import search as S
from corpuskit.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- large groups take another way to the same result ---


def test_ranked_splits_large_groups(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("k"), (F.col("id") * 7919 % 3001).alias("v"))
    plain = rows(runtime.ranked(df, ["k"], [F.desc("v")], "r"), "k", "v", "r")
    split = rows(runtime.ranked(df.repartition(7), ["k"], [F.desc("v")], "r", group_limit=10), "k", "v", "r")
    assert plain == split


def test_rounds_of_a_large_session(spark):
    messages = M.messages(spark, SF)
    columns = ("session_id", "user_message_id", "message_id", "text")
    plain = rows(conversations.conversation_rounds(messages), *columns)
    assert plain == rows(conversations.conversation_rounds(messages, group_limit=2), *columns)


def _queries_and_rows(spark):
    return M.queries(spark, SF), S.candidates(spark, SF)


def test_hybrid_search_without_shipped_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    queries, candidates = _queries_and_rows(spark)
    columns = ("query_id", "rank", "chunk_id", "score")
    shipped = rows(retrieval.hybrid_topk(queries, candidates, 5), *columns)
    assert shipped == rows(retrieval.hybrid_topk(queries, candidates, 5, row_limit=0), *columns)


def test_larger_k_extends_smaller_k(spark):
    queries, candidates = _queries_and_rows(spark)
    small = set(rows(retrieval.hybrid_topk(queries, candidates, 2), "query_id", "rank", "chunk_id"))
    assert small <= set(rows(retrieval.hybrid_topk(queries, candidates, 50), "query_id", "rank", "chunk_id"))


def test_phrases_with_and_without_the_automaton(monkeypatch):
    texts = [f"word{i} in text" for i in range(70)] + ["é x"]
    body = ["some word3 in text here", "word69 in texts é x", ""]
    how = topk.Scoring(k=3, keyword="overlap", vector=None)
    with_machine = topk._Queries(list(range(71)), texts, None, how).keyword_scores(body, "overlap")
    monkeypatch.setattr(topk, "ahocorasick", None)
    assert (with_machine == topk._Queries(list(range(71)), texts, None, how).keyword_scores(body, "overlap")).all()


# --- isolation ---


def test_no_rows_of_other_users(spark):
    queries, candidates = _queries_and_rows(spark)
    hits = retrieval.hybrid_topk(queries, candidates, 5).join(queries, "query_id")
    assert hits.filter(F.col("document_id") % 10 != F.col("user_id")).count() == 0
    chunks = E.hash_embedding(S.owned_chunks(spark, SF), "content", normalize=False)
    asked = E.hash_embedding(queries, "query_text", normalize=False)
    found = retrieval.knowledge_search(asked, chunks, 5, doc_type="rule", tags=["src1", "src2", "src3"])
    owned = found.join(chunks.select("chunk_id", "tags", F.col("user_id").alias("owner")), "chunk_id").join(queries, "query_id")
    assert owned.count() > 0
    wrong = ~F.col("owner").isin("global") & (F.col("owner") != F.col("user_id").cast("string"))
    assert owned.filter(wrong | (F.col("collection") != "rules")).count() == 0
    assert owned.filter(~F.arrays_overlap("tags", F.array(*map(F.lit, ["src1", "src2", "src3"])))).count() == 0


def test_search_documents_fallback(spark):
    docs = spark.createDataFrame(
        [(1, 1, "Support guide", "Email and phone", 5), (2, 1, "Other", "", 9), (3, 2, "Support too", "x", 7)],
        "document_id long, user_id long, title string, summary string, created_at long",
    ).withColumns({"domain": F.lit("d"), "is_published": F.lit(True)})
    chunks = spark.createDataFrame([], "document_id long, chunk_id long, chunk_title string, content string")
    queries = spark.createDataFrame([(7, 1, "support GUIDE"), (8, 1, "o")], "query_id long, user_id long, query_text string")
    rows_ = retrieval.chunks_with_documents(chunks, docs)
    found = retrieval.search_documents(queries, rows_, docs, 5)
    assert rows(found, "query_id", "rank", "document_id", "snippet", "score") == [
        (7, 1, 1, "Email and phone", 0.8),
        (8, 1, 2, "No summary yet.", 0.8),
        (8, 2, 1, "Email and phone", 0.8),
    ]


def test_documents_of_all_languages_are_searched_by_content(spark):
    """With every text of the benchmark; none is replaced and no document left out."""
    found = S.search_all_documents(spark, SF).join(M.raw_docs(spark, SF).select("document_id", "lang"), "document_id")
    hits = found.filter(F.col("score") != retrieval.FALLBACK_SCORE)
    assert {r.lang for r in hits.select("lang").distinct().collect()} == {r.lang for r in M.raw_docs(spark, SF).select("lang").distinct().collect()}
    best = retrieval.hybrid_topk(M.queries(spark, SF), S.candidates(spark, SF), 1).select("query_id", "document_id")
    first = found.filter("rank = 1").select("query_id", "document_id")
    assert best.count() > 0 and best.exceptAll(first).count() == 0


# --- duplicates ---


def _greedy(values):
    kept = []
    for v in values:
        if all((v ^ k).bit_count() > 3 for k in kept):
            kept.append(v)
    return kept


@pytest.mark.parametrize("hot_key", [2000, 3])
def test_simhash_against_brute_force(spark, hot_key):
    rng = random.Random(5)
    values = []
    for _ in range(60):
        base = rng.getrandbits(64)
        values.append(base)
        for _ in range(6):
            v = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                v ^= 1 << b
            values.append(v)
    rng.shuffle(values)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, simhash long")
    distinct = sorted(set(signed))
    expected = [
        (a, b, bin((a ^ b) & (2**64 - 1)).count("1"))
        for i, a in enumerate(distinct)
        for b in distinct[i + 1 :]
        if bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    ]
    assert rows(dedup.simhash_pairs(df, hot_key=hot_key), "a", "b", "distance") == sorted(expected)
    kept = dedup.dedup_simhash_greedy(df, "id", ["id"])
    assert {values[r.id] for r in kept.collect()} == set(_greedy(values))


def test_exploded_keys_are_not_broadcast(spark):
    """Their estimated size is that of the fingerprints, a fraction of what they hold."""
    df = spark.createDataFrame([(i, 1 << i) for i in range(40)], "id long, simhash long")
    for found in (dedup.simhash_pairs(df), dedup._pairs_by_flips(runtime.materialize(df.select(F.col("simhash").alias("fp"))))):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_greedy_is_not_transitive(spark):
    a, b, c = 0, 0b111, 0b111111
    df = spark.createDataFrame([(1, a), (2, b), (3, c)], "id long, simhash long")
    assert rows(dedup.dedup_simhash_greedy(df, "id", ["id"]), "id") == [(1,), (3,)]


def test_rows_without_key_are_kept(spark):
    df = spark.createDataFrame([(1, "u", "t"), (2, "u", "x"), (3, "", "t"), (4, "", "")], "id long, url string, text string")
    assert rows(dedup.dedup_exact(df, "id", ["id"]), "id") == [(1,), (4,)]


def test_export_is_written_by_many_tasks(spark, tmp_path):
    df = spark.createDataFrame([(i % 2, "t", f"body {i}", str(i)) for i in range(40)], "user_id long, title string, content string, file_id string")
    sinks.export_markdown(df.coalesce(1), str(tmp_path / "out"))
    written = [p.name[:10] for p in (tmp_path / "out").rglob("part-*.txt")]
    assert len(written) == 40 and len(set(written)) > 4


# --- references, conversations, network ---


def test_merge_refs(spark):
    schema = "query_id long, rank int, document_id string, title string, snippet string, score double"
    a = spark.createDataFrame([(1, 1, "d", "t", "s", 0.5), (1, 2, "e", "t", "s", 0.4)], schema)
    b = spark.createDataFrame([(1, 1, "d", "t", "s", 0.9), (1, 2, "web:1", "w", "s", 0.1)], schema)
    assert rows(citations.merge_refs(a, b), "rank", "document_id", "score") == [(1, "d", 0.9), (2, "e", 0.4), (3, "web:1", 0.1)]


def test_conversation_rounds(spark):
    turns = ["u1", "u2", "a1", "a2", "u3", "a3", "", "a4"]
    data = [(1, i, i, "assistant" if t.startswith("a") else "user", t) for i, t in enumerate(turns)]
    df = spark.createDataFrame(data, "session_id long, message_id long, created_at long, role string, content string")
    assert rows(conversations.conversation_rounds(df), "text") == [("用户: u2\n助手: a1",), ("用户: u3\n助手: a3",)]


def test_robots(spark):
    robots = spark.createDataFrame(
        [
            ("a.com", "User-agent: *\nDisallow: /private*\nAllow: /private/ok"),
            ("b.com", "User-agent: *\nDisallow: /private\nUser-agent: Kit\nDisallow: /"),
        ],
        "host string, body string",
    )
    urls = spark.createDataFrame(
        [("http://a.com/private/ok",), ("http://a.com/private/x",), ("http://b.com/private/x",), ("http://c.com/",)], "url string"
    )
    assert rows(network.robots_filter(urls, robots), "url", "allowed") == [
        ("http://a.com/private/ok", True),
        ("http://a.com/private/x", False),
        ("http://b.com/private/x", True),
        ("http://c.com/", True),
    ]
    kit = network.robots_filter(urls, robots, "kit").filter("url like '%b.com%'")
    assert rows(kit, "allowed") == [(False,)]


def _robots_by_hand(body, agent, path):
    """The last matching rule of the agent's group, of ``*`` without one."""
    named, groups = "*", {}
    for line in re.split(r"\r\n|\r|\n", body):
        field, colon, value = line.split("#")[0].strip().partition(":")
        field, value = field.lower() if colon else "", value.strip()
        if field == "user-agent":
            named = value.lower()
            groups.setdefault(named, [])
        elif field in ("allow", "disallow"):
            groups.setdefault(named, []).append((field == "allow", value.removesuffix("$")))
    allowed = True
    for allow, pattern in groups.get(agent, groups.get("*", [])):
        if pattern in ("", "/") or fnmatch.fnmatchcase(path, pattern):
            allowed = allow
    return allowed


@pytest.mark.parametrize("agent", ["*", "Kit"])
def test_robots_by_hand(spark, agent):
    """Random files, with one host that holds most rules and URLs; no key of the join is much larger than a part of it."""
    rng = random.Random(6)
    names = ["/", "/a", "/a/", "/a/b", "/a/*", "/a/b*", "/*b", "/b/?", "/b/[ab]c", "", "/a/b$", "*", "/c/d/*.html", "/x*/y"]
    ends = ["\n", "\r\n", "\r", " # note\n"]

    def body(n):
        lines = ["Sitemap: http://x/", " \tUSER-agent: *" if rng.random() < 0.7 else "Allow: /a"]
        for _ in range(n):
            rule = rng.choice(["Allow: ", "disallow:", "  Disallow :", "Disallow: "]) + rng.choice(names)
            lines.append(rule if rng.random() < 0.8 else rng.choice(["User-Agent: kit", "user-agent:*", "User-agent: other", "# user-agent: kit"]))
        return "".join(x + rng.choice(ends) for x in lines)

    bodies = {f"h{i}.com": body(rng.randint(0, 12)) for i in range(40)} | {"empty.com": "", "hot.com": body(300)}
    paths = ["/", "/a", "/a/", "/a/b", "/a/bc", "/b/a", "/b/ac", "/b/zc", "/c/d/e.html", "/xx/y", "/nothing"]
    urls = [(f"http://{h}{p}", h, p) for h in [*bodies, "none.com"] for p in paths] * 2
    urls += [(f"http://hot.com/s{i}/{i}", "hot.com", f"/s{i}/{i}") for i in range(500)] + [(None, None, "")]
    robots = spark.createDataFrame(list(bodies.items()) + [("null.com", None)], "host string, body string")
    df = spark.createDataFrame([(u, "clash") for u, _, _ in urls], "url string, pattern string")
    want = sorted((u or "", _robots_by_hand(bodies.get(h, ""), agent.lower(), p)) for u, h, p in urls)
    got = network.robots_filter(df, robots, agent)
    assert got.columns == ["host", "url", "pattern", "allowed"]
    assert sorted((r.url or "", r.allowed) for r in got.collect()) == want


def test_blocked_addresses(spark):
    ips = ["10.1.2.3", "8.8.8.8", "169.254.169.254", "::1", "fd00::1", "fe80::5:1", "2001:db8::1", "172.32.0.1"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    found = dict(rows(df.withColumn("r", network.blocked_reason(F.col("ip"))), "ip", "r"))
    assert found == {
        "10.1.2.3": "10.0.0.0/8", "8.8.8.8": None, "169.254.169.254": "metadata", "::1": "::1/128",
        "fd00::1": "fc00::/7", "fe80::5:1": "fe80::/10", "2001:db8::1": None, "172.32.0.1": None,
    }


# --- structure ---


def test_concept_neighbors(spark):
    chunks = spark.createDataFrame(
        [(1, "B", 1, "A", ""), (1, "B", 2, "A > x > y", "t"), (1, "B", 3, "A > z", "u")],
        "document_id long, document_title string, chunk_id long, chunk_title string, content string",
    )
    nodes = structure.build_section_nodes(chunks)
    assert rows(nodes, "section_id", "path", "parent_id") == [
        ("s1", "A", None), ("s2", "A > x", "s1"), ("s3", "A > x > y", "s2"), ("s4", "A > z", "s1"),
    ]
    assert rows(structure.fill_previews(nodes), "section_id", "preview") == [("s1", "t"), ("s2", "t"), ("s3", "t"), ("s4", "u")]
    starts = spark.createDataFrame([(1, "s1")], "document_id long, start string")
    found = structure.concept_neighbors(nodes, structure.section_graph(nodes), starts)
    assert rows(found, "section_id", "weight") == [("s2", 2.0), ("s3", 1.0), ("s4", 2.0)]
    near = structure.concept_neighbors(nodes, structure.section_graph(nodes), starts, max_hops=1)
    assert rows(near, "section_id") == [("s2",), ("s4",)]


# --- documents, sources, sinks, functions ---


def test_uploads(spark):
    docs = spark.createDataFrame(
        [(1, "Guide", "# A\ntext one\n## B\ntext two", ".md"), (2, "Heads", "# Only\n## heads", ".md"), (3, "Gone", None, ".txt")],
        "document_id long, title string, text string, extension string",
    )
    documents_, chunks = documents.ingest_user_documents(docs)
    assert rows(chunks, "document_id", "chunk_index", "chunk_title", "content") == [
        (1, 0, "A", "text one"), (1, 1, "A > B", "text two"), (2, 0, "Heads", "# Only\n## heads"),
    ]
    assert rows(documents_, "document_id", "status", "summary") == [
        (1, "ready", "text one\n\ntext two"),
        (2, "ready", "# Only\n## heads"),
        (3, "failed", "Parsing failed: text is missing"),
    ]


def test_text_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A\nx")
    (tmp_path / "sub" / "b.TXT").write_text("plain\ntext")
    (tmp_path / "c.log").write_text("log")
    found = readers.scan_text_dir(spark, str(tmp_path))
    assert rows(found, "doc_id", "extension", "text") == [("a", ".md", "# A\nx"), ("b", ".txt", "plain\ntext")]
    assert rows(readers.scan_text_dir(spark, str(tmp_path), recursive=False), "doc_id") == [("a",)]
    assert rows(readers.scan_text_dir(spark, str(tmp_path / "c.log")), "doc_id") == [("c",)]
    corpus = documents.ingest_corpus(found.withColumn("doc_type", F.lit("knowledge")))
    assert rows(corpus, "title", "title_path", "content") == [("A", "A", "x"), ("b - 片段 1", "b", "plain\ntext")]


def test_json_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text(
        '{"title": "T", "doc_type": "rule",\n "sections": [{"heading": "H", "content": "c", "tags": ["x"]}, {"content": ""}]}'
    )
    found = readers.scan_json_docs(spark, str(tmp_path))
    assert rows(found, "doc_id", "title_path", "content", "domain", "doc_type") == [("d", "T > H", "c", "general", "rule")]


def test_versions_of_a_large_document(spark):
    key = "user_id long, canonical_url string, source_type string, "
    docs = spark.createDataFrame([], key + "document_id long, title string, summary string, last_fetched_at long, current_version_id long")
    versions = spark.createDataFrame([], "document_id long, version_id long, version_no long, content_hash string, created_at long")
    incoming = spark.createDataFrame(
        [(1, "u", "web", 5, i, f"t{i}", "s", "h", i) for i in range(50)],
        key + "document_id long, version_id long, title string, summary string, content_hash string, fetched_at long",
    )
    saved, history = sinks.upsert_document_version(docs, versions, incoming, group_limit=5)
    assert rows(saved, "document_id", "title", "current_version_id") == [(5, "t49", 49)]
    assert rows(history, "version_id", "version_no") == [(i, i + 1) for i in range(50)]


def test_registered_functions_return_errors(spark):
    names = [f["name"] for f in register_all(spark, "o'brien")]
    assert "ck_chunks" in names
    row = spark.sql("SELECT ck_chunks('abc') AS c, ck_keywords(CAST(NULL AS STRING)) AS k, ck_user_id() AS u").first()
    assert row.c.value == ["abc"] and row.c.error is None
    assert row.k.value is None and row.k.error.startswith("TypeError")
    assert row.u == "o'brien"
    assert spark.sql("SELECT * FROM ck_text_chunks(repeat('a', 250), 100, 0)").count() == 3


def test_first_network_of_many(spark):
    import ipaddress
    import random

    rng = random.Random(8)
    nets = [f"{rng.randrange(40)}.{rng.randrange(256)}.0.0/{rng.choice([8, 12, 16])}" for _ in range(3000)]
    nets += [f"{rng.randrange(40)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}/{rng.choice([24, 31, 32])}" for _ in range(3000)]
    nets += [f"20{rng.randrange(9)}:{rng.randrange(99)}::/{rng.choice([7, 32, 48, 127])}" for _ in range(500)] + ["77.0.0.0/8", "77.1.0.0/16", "77.0.0.0/8"]
    nets = [str(ipaddress.ip_network(n, strict=False)) for n in nets]
    ips = [f"{rng.randrange(60)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(400)] + ["77.1.2.3"] * 3 + [None]
    ips += [f"20{rng.randrange(9)}:{rng.randrange(99)}::{rng.randrange(99)}" for _ in range(60)]
    order = {n: i for i, n in reversed(list(enumerate(nets)))}
    parsed = [(i, ipaddress.ip_network(n)) for n, i in sorted(order.items(), key=lambda x: x[1])]
    want = []
    for ip in ips:
        a = ipaddress.ip_address(ip) if ip else None
        want.append((ip, next((str(n) for _, n in parsed if a and a.version == n.version and a in n), None)))
    got = network.first_network(
        spark.createDataFrame([(ip,) for ip in ips], "ip string"),
        spark.createDataFrame(list(zip(nets, range(len(nets)))), "network string, rule_order int"),
    )
    key = lambda r: (r[0] or "", r[1] or "")
    assert sorted(map(tuple, got.select("ip", "reason").collect()), key=key) == sorted(want, key=key)
    empty = spark.createDataFrame([], "network string, rule_order int")
    assert network.first_network(got.select("ip"), empty).filter("reason IS NOT NULL").isEmpty()
