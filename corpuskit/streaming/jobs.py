"""Structured Streaming jobs over arriving pages and messages."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from corpuskit import runtime
from corpuskit.functions.text import content_hash
from corpuskit.functions.urls import url_key
from corpuskit.operators import chunking as K
from corpuskit.operators.conversations import round_text
from corpuskit.operators.dedup import block_keys, dedup_simhash_greedy, first_per_key
from corpuskit.operators.documents import chunk_text
from corpuskit.operators.embedding import simhash_column
from corpuskit.operators.pages import normalize_pages, quality_gate

# The process that sets up a stateful operator does not get shipped packages: send the code itself.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PENDING_TTL_MS = 7 * 24 * 3600 * 1000
# Folders of the stored block keys of fingerprints.
KEY_PARTS = 256


def ingest_pages(pages: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """Chunks of the pages that pass the quality gate. Stateless: the same for batch and stream."""
    good = quality_gate(normalize_pages(pages)).select("page_id", "url", "title", "quality_score", "text")
    return chunk_text(good, "text", size, overlap)


def one_per_page(pages: DataFrame, order: str | None = None) -> DataFrame:
    """One row per page of a micro-batch: the last by ``order``, else the largest (url, html)."""
    row = F.struct("url", "html")
    last = F.max_by(row, F.struct(order, row)) if order else F.max(row)
    return pages.filter("page_id IS NOT NULL").groupBy("page_id").agg(last.alias("r")).select("page_id", "r.url", "r.html")


def stream_ingest(pages: DataFrame, out: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Store the chunks of arriving pages; ``ingested_chunks`` reads them.

    Every micro-batch writes its own folder, and a repeated one replaces it. A page that arrives
    again takes the place of its earlier chunks. A page that gives no chunk (an error page, thin
    text) leaves a row without a chunk index, which takes their place as well.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        arrived = one_per_page(batch, order)
        rows = arrived.select("page_id").join(ingest_pages(arrived), "page_id", "left")
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = pages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def _last_rows(spark: SparkSession, out: str) -> DataFrame:
    """Rows of the last micro-batch of each page, batch number included."""
    stored, base = spark.read.parquet(out), _base(spark, out)
    if base is not None:
        merged = spark.read.parquet(f"{out}-base/upto={base}").select(stored.columns)
        stored = stored.filter(F.col("batch") > base).unionByName(merged)
    last = stored.groupBy("page_id").agg(F.max("batch").alias("batch"))
    return stored.join(last, ["page_id", "batch"], "left_semi").select(stored.columns)


def ingested_chunks(spark: SparkSession, out: str) -> DataFrame:
    """Chunks of the last micro-batch of each page; a page whose last arrival gave none has none.

    Only page ids and batch numbers are aggregated.
    """
    return _last_rows(spark, out).filter("chunk_index IS NOT NULL").drop("batch")


def compact_ingested(spark: SparkSession, out: str) -> None:
    """Rewrite the stored batches as one table without replaced chunks and delete what it replaces.

    Run it between two runs of the stream. The new table counts only once it is complete, and readers skip the
    batches that it covers, so a compaction that dies half way changes nothing and can be run again. The newest batch
    stays where it is, so that a repetition of it replaces its own rows.
    """
    batches = sorted(int(name.split("=")[1]) for name in runtime.folder_names(spark, out) if name.startswith("batch="))
    if len(batches) < 2:
        return
    upto, before = batches[-2], _base(spark, out)
    stored = spark.read.parquet(out)
    covered = stored.filter(F.col("batch") <= upto)
    if before is not None:
        covered = covered.filter(F.col("batch") > before).unionByName(spark.read.parquet(f"{out}-base/upto={before}").select(stored.columns))
    last = covered.groupBy("page_id").agg(F.max("batch").alias("batch"))
    kept = covered.join(last, ["page_id", "batch"], "left_semi").filter("chunk_index IS NOT NULL")
    kept.write.mode("overwrite").parquet(f"{out}-base/upto={upto}")
    for n in batches[:-1]:
        runtime.delete_folder(spark, f"{out}/batch={n}")
    for name in runtime.folder_names(spark, f"{out}-base"):
        if name != f"upto={upto}":
            runtime.delete_folder(spark, f"{out}-base/{name}")


def _base(spark: SparkSession, out: str) -> int | None:
    """Last batch that a complete compacted table covers."""
    done = []
    for name in runtime.folder_names(spark, f"{out}-base"):
        if name.startswith("upto=") and "_SUCCESS" in runtime.folder_names(spark, f"{out}-base/{name}"):
            done.append(int(name.split("=")[1]))
    return max(done, default=None)


def stream_first_arrivals(
    rows: DataFrame, out: str, checkpoint: str, row_id: str, order: list[str], url: str = "url", text: str = "text"
) -> StreamingQuery:
    """Store the rows that ``dedup_exact`` keeps when micro-batches arrive one after the other.

    First row per canonical URL, then per content hash; inside a micro-batch the smallest
    (order, id) is first. The keys that were seen are stored next to the rows, and a repeated
    micro-batch replaces its own. Rows without a key are kept and leave no key behind.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        keys, spark = f"{out}-keys", batch.sparkSession
        keyed = batch.withColumns({"_url": url_key(F.col(url)), "_hash": F.when(F.col(text) != "", content_hash(F.col(text)))})
        keyed = keyed.persist()
        known = spark.read.parquet(keys).filter(F.col("batch") < batch_id) if batch_id else None

        def first(df: DataFrame, key: str) -> DataFrame:
            fresh = df.join(first_per_key(df, key, row_id, order), row_id, "left_semi")
            if known is None:
                return fresh
            seen = known.filter(F.col("kind") == key).select(F.col("key").alias(key))
            return fresh.join(seen, key, "left_anti")

        by_url = first(keyed, "_url")
        kept = first(by_url, "_hash")
        parts = [(by_url, "_url"), (kept, "_hash")]
        found = [df.filter(F.coalesce(k, F.lit("")) != "").select(F.lit(k).alias("kind"), F.col(k).alias("key")) for df, k in parts]
        found[0].unionByName(found[1]).write.mode("overwrite").parquet(f"{keys}/batch={batch_id}")
        kept.drop("_url", "_hash").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        keyed.unpersist()

    writer = rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def stream_near_arrivals(
    rows: DataFrame, out: str, checkpoint: str, row_id: str, order: list[str], text: str = "text", parts: int = KEY_PARTS
) -> StreamingQuery:
    """Store the rows that ``dedup_simhash_greedy`` keeps when micro-batches arrive one after the other.

    A row is dropped when its text's fingerprint is within distance 3 of an earlier kept row's. The fingerprints that were
    kept are stored under their block keys, in ``parts`` folders by the key's hash; a batch reads the folders of its own
    keys and takes from them the fingerprints that share a key with one of its own. These come first in the greedy pass
    over the batch, so a key that many texts share costs no more than there. A repeated micro-batch replaces its own
    folders. Rows without text are kept and leave no key behind; ids are distinct and not null.
    ``compact_near_keys`` keeps the number of folders small.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        keys, spark = f"{out}-keys", batch.sparkSession
        printed = F.when(F.col(text) != "", simhash_column(F.col(text)))
        keyed = batch.withColumn("_fp", printed).persist()
        new = keyed.filter("_fp IS NOT NULL").select(row_id, *[c for c in order if c != row_id], "_fp")
        part = F.pmod(F.xxhash64("at", "key"), F.lit(parts)).cast("int").alias("part")
        ranked = new.withColumn("_new", F.lit(True))
        if batch_id:
            asked = block_keys(new.select("_fp").distinct(), "_fp").select("at", "key", part).distinct().persist()
            numbers = [r.part for r in asked.select("part").distinct().collect()]  # at most ``parts``
            stored = _near_keys(spark, keys, batch_id).filter(F.col("part").isin(numbers))
            met = stored.join(asked.drop("part"), ["at", "key"], "left_semi").select(F.col("fp").alias("_fp")).distinct()
            ranked = ranked.unionByName(met.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        kept = runtime.materialize(dedup_simhash_greedy(ranked, row_id, ["_new", *order], "_fp").filter("_new").select(row_id, "_fp"))
        block_keys(kept.select("_fp").distinct(), "_fp").withColumn("part", part).repartition("part").write.mode(
            "overwrite"
        ).partitionBy("part").parquet(f"{keys}/batch={batch_id}")
        left = keyed.join(kept.select(row_id), row_id, "left_semi").unionByName(keyed.filter("_fp IS NULL"))
        left.drop("_fp").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        keyed.unpersist()

    writer = rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


_NEAR_KEYS = "fp long, at int, key long, batch long, part int"


def _near_keys(spark: SparkSession, keys: str, until: int) -> DataFrame:
    """Stored keys of the batches before ``until``; the part is a folder."""
    stored, base = spark.read.schema(_NEAR_KEYS).parquet(keys), _base(spark, keys)
    if base is None:
        return stored.filter(F.col("batch") < until)
    merged = spark.read.schema("fp long, at int, key long, part int").parquet(f"{keys}-base/upto={base}")
    newer = stored.filter((F.col("batch") < until) & (F.col("batch") > base))
    return newer.drop("batch").unionByName(merged)


def compact_near_keys(spark: SparkSession, out: str) -> None:
    """Rewrite the stored keys of all batches but the newest as one folder per part. Run it between two runs of the stream.

    The new table counts only once it is complete; readers skip the batches that it covers.
    """
    keys = f"{out}-keys"
    batches = sorted(int(name.split("=")[1]) for name in runtime.folder_names(spark, keys) if name.startswith("batch="))
    if len(batches) < 2:
        return
    upto = batches[-2]
    if upto != _base(spark, keys):
        covered = _near_keys(spark, keys, upto + 1).select("fp", "at", "key", "part")
        covered.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{keys}-base/upto={upto}")
    for n in batches[:-1]:
        runtime.delete_folder(spark, f"{keys}/batch={n}")
    for name in runtime.folder_names(spark, f"{keys}-base"):
        if name != f"upto={upto}":
            runtime.delete_folder(spark, f"{keys}-base/{name}")


def stream_dedup(
    rows: DataFrame,
    row_id: str,
    url: str = "url",
    text: str = "text",
    arrival: str | None = None,
    delay: str | None = None,
) -> DataFrame:
    """First arrival per canonical URL, then per content hash. ``arrival`` and ``delay`` bound the state.

    A row without URL or text gets a key of its own in that stage, so it is kept. Which row of a
    micro-batch is first is not defined here; ``stream_first_arrivals`` follows an order.
    """
    own = F.concat(F.lit("row "), F.col(row_id).cast("string"))
    hashed = F.when(F.col(text) != "", content_hash(F.col(text)))
    keyed = rows.withColumns({"url_key": F.coalesce(url_key(F.col(url)), own), "hash_key": F.coalesce(hashed, own)})
    if arrival and delay:
        keyed = keyed.withWatermark(arrival, delay)
        return keyed.dropDuplicatesWithinWatermark(["url_key"]).dropDuplicatesWithinWatermark(["hash_key"])
    return keyed.dropDuplicates(["url_key"]).dropDuplicates(["hash_key"])


_MESSAGE = "created_at long, message_id long, role string, content string"


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["created_at", "message_id"], kind="stable")


class LastMessages(StatefulProcessor):
    """Keeps the newest messages of a session and emits them after every micro-batch."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", _MESSAGE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ["created_at", "message_id", "role", "content"]
        kept = pd.DataFrame(list(self.kept.get()) if self.kept.exists() else [], columns=columns)
        for part in rows:
            kept = _ordered(pd.concat([kept, part[columns]])).tail(self.keep)
        self.kept.put([(int(c), int(m), r, t) for c, m, r, t in kept.itertuples(index=False)])
        yield kept.assign(session_id=key[0])[["session_id", *columns]].reset_index(drop=True)

    def close(self) -> None:
        pass


class PendingQuestion(StatefulProcessor):
    """Pairs an assistant message with the user message right before it."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getValueState("pending", "message_id long, content string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.pending.get() if self.pending.exists() else None
        question = (stored[0], stored[1]) if stored is not None else None
        closed = []
        for m in _ordered(pd.concat(list(rows))).itertuples(index=False):
            if m.role == "user":
                question = (int(m.message_id), m.content)
            elif m.role == "assistant":
                if question is not None and question[1]:
                    closed.append((key[0], question[0], int(m.message_id), question[1], m.content))
                question = None
        if question is None:
            self.pending.clear()
        else:
            self.pending.update(question)
        yield pd.DataFrame(closed, columns=["session_id", "user_message_id", "message_id", "question", "answer"])

    def close(self) -> None:
        pass


def _flat(messages: DataFrame) -> DataFrame:
    """Messages with the time as microseconds, which the state keeps exactly."""
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    return messages.select("session_id", micros.alias("created_at"), "message_id", "role", "content")


def stream_short_term_memory(messages: DataFrame, max_turns: int = 10) -> DataFrame:
    """Last ``2 x max_turns`` messages per session, emitted again whenever a session changes."""
    return (
        _flat(messages)
        .groupBy("session_id")
        .transformWithStateInPandas(
            LastMessages(2 * max_turns),
            outputStructType=f"session_id long, {_MESSAGE}",
            outputMode="Update",
            timeMode="None",
        )
    )


def stream_conversation_rounds(messages: DataFrame, pending_ttl_ms: int | None = None) -> DataFrame:
    """Rounds as assistant messages close them. A micro-batch is sorted per session before pairing.

    ``pending_ttl_ms`` (for example ``PENDING_TTL_MS``) drops questions that stay open. It needs
    processing time, with which a query never runs out of batches: use it in continuous jobs, not
    with ``availableNow``.
    """
    talk = _flat(messages.filter(F.col("role").isin("user", "assistant")))
    rounds = talk.groupBy("session_id").transformWithStateInPandas(
        PendingQuestion(pending_ttl_ms),
        outputStructType="session_id long, user_message_id long, message_id long, question string, answer string",
        outputMode="Append",
        timeMode="None" if pending_ttl_ms is None else "ProcessingTime",
    )
    return rounds.select(
        "session_id", "user_message_id", "message_id", round_text(F.col("question"), F.col("answer")).alias("text")
    )


_OPEN = "session_id long, created_at long, message_id long, role string, content string"


def stream_rounds(
    messages: DataFrame, out: str, checkpoint: str, ttl: float | None = None, group_limit: int = runtime.GROUP_ROW_LIMIT
) -> StreamingQuery:
    """Store the rounds that assistant messages close, one folder per micro-batch; a repeated one replaces its own.

    The rounds of ``stream_conversation_rounds`` without a session in one task: messages are paired with the one before
    them by ``runtime.with_previous``, which spreads a session with more than ``group_limit`` messages by range. The
    question that a session leaves open goes to ``out-open`` and comes before the next batch's messages. With ``ttl``
    (seconds of event time) an open question is dropped at the end of the first batch whose messages, or earlier ones, are
    more than that later; that bounds the open questions and works with any trigger. Messages without a session are left out.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark, opened = batch.sparkSession, f"{out}-open"
        new = _flat(batch.filter(F.col("role").isin("user", "assistant") & F.col("session_id").isNotNull()))
        talk = new.withColumn("session_id", F.col("session_id").cast("long")).withColumn("_new", F.lit(True))
        clock = None
        if batch_id:
            before = spark.read.schema(_OPEN).parquet(f"{opened}/batch={batch_id - 1}")
            # the row without a session holds the newest time seen
            clock = before.filter("session_id IS NULL").agg(F.max("created_at")).first()[0]
            talk = talk.unionByName(before.filter("session_id IS NOT NULL").withColumn("_new", F.lit(False)))
        talk = talk.persist()
        newest = talk.agg(F.max("created_at")).first()[0]
        clock = max((t for t in (clock, newest) if t is not None), default=None)
        order = [F.asc("_new"), F.asc("created_at"), F.asc("message_id")]
        paired = runtime.with_previous(talk, ["session_id"], order, ["message_id", "role", "content"], group_limit)
        closes = (F.col("role") == "assistant") & (F.col("prev_role") == "user") & (F.col("prev_content") != "")
        rounds = paired.filter(closes).select(
            "session_id",
            F.col("prev_message_id").alias("user_message_id"),
            "message_id",
            round_text(F.col("prev_content"), F.col("content")).alias("text"),
        )
        rounds.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        last = F.max_by(F.struct("created_at", "message_id", "role", "content"), F.struct("_new", "created_at", "message_id"))
        left = talk.groupBy("session_id").agg(last.alias("m")).select("session_id", "m.*").filter("role = 'user'")
        if ttl is not None and clock is not None:
            left = left.filter(F.col("created_at") >= clock - int(ttl * 1_000_000))
        seen = spark.createDataFrame([(None, clock, None, None, None)], _OPEN)
        left.unionByName(seen).write.mode("overwrite").parquet(f"{opened}/batch={batch_id}")
        talk.unpersist()
        # only the batch before is needed, should this one be repeated
        runtime.delete_folder(spark, f"{opened}/batch={batch_id - 2}")

    writer = messages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is available, one Parquet folder per micro-batch."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def use_rocksdb(spark) -> None:
    """State store that ``transformWithState`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
