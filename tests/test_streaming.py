"""Streams fed in several micro-batches give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import conversations
from corpuskit.operators.dedup import dedup_exact, dedup_simhash_greedy
from corpuskit.operators.embedding import simhash_column
from corpuskit.plans import model as M
from corpuskit.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def feed(spark, parts, path):
    """Write each part as one file and read them as a stream, one file per micro-batch."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(path))
    schema = spark.read.parquet(str(path)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def finish(spark, stream, tmp_path, name, mode="append"):
    J.run_to_table(stream, str(tmp_path / name), str(tmp_path / f"{name}-state"), mode).awaitTermination()
    return spark.read.parquet(str(tmp_path / name))


def test_rounds_over_batches(spark, tmp_path):
    J.use_rocksdb(spark)
    messages = M.messages(spark, SF)
    parts = [messages.filter((F.col("message_id") % 100 >= lo) & (F.col("message_id") % 100 < hi)) for lo, hi in ((0, 1), (1, 3), (3, 99))]
    found = finish(spark, J.stream_conversation_rounds(feed(spark, parts, tmp_path / "in")), tmp_path, "rounds")
    columns = ["session_id", "user_message_id", "message_id", "text"]
    expected = conversations.conversation_rounds(messages).select(*columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, expected.collect()))
    assert found.select("batch").distinct().count() > 1


MESSAGE = "session_id long, message_id long, created_at long, role string, content string"


def rounds_by_hand(parts, ttl=None):
    """Rounds of messages that arrive in parts, session by session, one message after the other."""
    pending, found, clock = {}, [], None
    for part in parts:
        times = [m[2] for m in part if m[0] is not None and m[3] in ("user", "assistant")]
        clock = max([t for t in [clock, *times] if t is not None], default=None)
        for session, number, at, role, text in sorted(part, key=lambda m: (m[2], m[1])):
            if role == "user":
                pending[session] = (number, text, at)
            elif role == "assistant":
                asked = pending.pop(session, None)
                if session is not None and asked and asked[1]:
                    found.append((session, asked[0], number))
        if ttl is not None and clock is not None:
            pending = {k: q for k, q in pending.items() if q[2] >= clock - ttl}
    return sorted(found)


@pytest.mark.parametrize("group_limit, ttl", [(1000, None), (5, None), (5, 20)])
def test_rounds_without_a_session_in_one_task(spark, tmp_path, group_limit, ttl):
    """One session holds a third of all messages; some come late, some lack a session, a text or an answer."""
    rng = random.Random(8)
    parts = []
    for n in range(4):
        part = []
        for k in range(60):
            session = rng.choice([1, 1, 1, 2, 3, 4, 5, 6, None])
            role = rng.choice(["user", "user", "assistant", "assistant", "system"])
            part.append((session, n * 100 + k, n * 30 + rng.randint(-10, 25), role, rng.choice(["some text", "", None])))
        parts.append(part)
    parts.insert(2, [(9, 900, 0, "system", "no talk")])
    frames = [spark.createDataFrame(p, MESSAGE).withColumn("created_at", F.timestamp_seconds("created_at")) for p in parts]
    stream = feed(spark, frames, tmp_path / "in")
    J.stream_rounds(stream, str(tmp_path / "out"), str(tmp_path / "state"), ttl, group_limit).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    want = rounds_by_hand(parts, ttl)
    assert sorted((r.session_id, r.user_message_id, r.message_id) for r in found.collect()) == want and len(want) > 10
    assert len(list((tmp_path / "out-open").iterdir())) == 2


def test_an_open_question_expires(spark, tmp_path):
    """The answer to a question comes in time, later than that, and after a batch that moved the clock."""
    day = 86_400
    parts = [
        [(1, 1, 0, "user", "a"), (2, 2, 0, "user", "b")],
        [(1, 3, day, "assistant", "in time"), (3, 4, 9 * day, "user", "c")],
        [(2, 5, 9 * day, "assistant", "too late"), (3, 6, 10 * day, "assistant", "in time")],
    ]
    frames = [spark.createDataFrame(p, MESSAGE).withColumn("created_at", F.timestamp_seconds("created_at")) for p in parts]
    stream = feed(spark, frames, tmp_path / "in")
    J.stream_rounds(stream, str(tmp_path / "out"), str(tmp_path / "state"), 7 * day).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.user_message_id, r.message_id) for r in found) == [(1, 3), (4, 6)] == [r[1:] for r in rounds_by_hand(parts, 7 * day)]


def test_short_term_memory_over_batches(spark, tmp_path):
    J.use_rocksdb(spark)
    messages = M.messages(spark, SF)
    parts = [messages.filter(F.col("message_id") % 100 < 2), messages.filter(F.col("message_id") % 100 >= 2)]
    found = finish(spark, J.stream_short_term_memory(feed(spark, parts, tmp_path / "in"), 2), tmp_path, "memory", "update")
    last = found.groupBy("session_id").agg(F.max("batch").alias("batch"))
    kept = found.join(last, ["session_id", "batch"]).groupBy("session_id").agg(F.count("*").alias("n"))
    batch = conversations.short_term_window(messages, 2)
    expected = sorted((r.session_id, r.messages) for r in batch.collect())
    assert sorted((r.session_id, r.n) for r in kept.collect()) == expected


def test_dedup_over_batches(spark, tmp_path):
    rows = [(1, "u1", "a"), (2, "u1", "b"), (3, "u2", "a"), (4, "", ""), (5, "", ""), (6, "u3", "c"), (7, "u3/", "d")]
    rows = [(i, f"http://h/{u}" if u else "", t) for i, u, t in rows]
    parts = [spark.createDataFrame(rows[i : i + 1], "id long, url string, text string") for i in range(len(rows))]
    found = finish(spark, J.stream_dedup(feed(spark, parts, tmp_path / "in"), "id"), tmp_path, "dedup")
    expected = dedup_exact(spark.createDataFrame(rows, "id long, url string, text string"), "id", ["id"])
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in expected.collect()) == [1, 4, 5, 6]


def test_near_arrivals_over_batches(spark, tmp_path):
    """Chains of near texts over several batches, with a compaction and empty texts in between."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(150)] for _ in range(6)]
    texts = []
    for i in range(60):
        text = base[i % 6]
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(150)] = rng.choice(words)
        texts.append((i, " ".join(text) if i % 13 else rng.choice(["", None]), "extra"))
    schema = "id long, text string, _extra string"
    parts = [spark.createDataFrame(texts[i : i + 15], schema) for i in range(0, 60, 15)]
    out = str(tmp_path / "out")
    for n in range(4):
        stream = feed(spark, parts[n : n + 1], tmp_path / "in")
        J.stream_near_arrivals(stream, out, str(tmp_path / "state"), "id", ["id"], parts=8).awaitTermination()
        if n == 2:
            J.compact_near_keys(spark, out)
    found = spark.read.parquet(out)
    df = spark.createDataFrame(texts, schema)
    printed = df.filter("text <> ''").withColumn("simhash", simhash_column(F.col("text")))
    kept = {r.id for r in dedup_simhash_greedy(printed, "id", ["id"]).collect()}
    assert {r.id for r in found.collect()} == kept | {i for i, t, _ in texts if not t}
    assert 6 < len(kept) < 50 and found.columns == ["id", "text", "_extra", "batch"]


def page(i, words):
    return (i, f"http://h/{i}", f"<html><head><title>t</title></head><body><article><p>{'word ' * words}</p></article></body></html>")


def test_ingest_replaces_and_compacts(spark, tmp_path):
    bad = "<html><head><title>404 Not Found</title></head><body>gone</body></html>"
    batches = [[page(1, 700), page(2, 300)], [(1, "http://h/1", bad), page(3, 200)], [page(2, 80)]]
    parts = [spark.createDataFrame(b, "page_id long, url string, html string") for b in batches]
    out = str(tmp_path / "out")
    J.stream_ingest(feed(spark, parts, tmp_path / "in"), out, str(tmp_path / "state")).awaitTermination()

    def rows():
        found = J.ingested_chunks(spark, out)
        return sorted((r.page_id, r.chunk_index, r.content) for r in found.collect())

    last = spark.createDataFrame([page(2, 80), page(3, 200)], "page_id long, url string, html string")
    want = sorted((r.page_id, r.chunk_index, r.content) for r in J.ingest_pages(last).collect())
    assert rows() == want and {r[0] for r in want} == {2, 3}
    for _ in range(2):
        J.compact_ingested(spark, out)
        assert rows() == want
    left = spark.read.parquet(out + "-base/upto=1")
    assert {r.page_id for r in left.select("page_id").collect()} == {2, 3} and left.filter("page_id = 1").isEmpty()
    # the same page turns bad after the compaction
    again = spark.createDataFrame([(3, "http://h/3", bad)], "page_id long, url string, html string")
    again.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "page_id long, url string, html string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    J.stream_ingest(stream, out, str(tmp_path / "state")).awaitTermination()
    assert {r[0] for r in rows()} == {2}
    J.compact_ingested(spark, out)
    assert {r[0] for r in rows()} == {2}
