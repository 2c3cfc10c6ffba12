"""Sinks: upserts, versioned saves, idempotent appends, deletes and Markdown export."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskit import runtime
from corpuskit.functions import text as X
from corpuskit.operators.dedup import first_per_key
from corpuskit.operators.retrieval import collection_of

# Tasks per core of an export of one file per row.
FILE_TASKS = 4
# Bytes of files that a task reads at once.
READ_BYTES = 4 << 20
BLOCKING_STATUSES = ("queued", "claimed", "completed")


def upsert_chunks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored chunks after an upsert by chunk_id; of several incoming rows the highest batch wins.

    ``incoming`` has a ``batch`` column. The collection follows the document type. Only the ids of the
    batch meet the stored rows: a small batch is broadcast and the stored texts are not shuffled.
    """
    routed = incoming.withColumn("collection", collection_of(F.col("doc_type")))
    latest = Window.partitionBy("chunk_id").orderBy(F.desc("batch"))
    new = routed.withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r", "batch")
    kept = existing.join(new.select("chunk_id"), "chunk_id", "left_anti")
    return kept.select(*existing.columns).unionByName(new, allowMissingColumns=True)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Write chunks as Parquet, one folder per collection; only the written collections change."""
    writer = chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("collection").parquet(path)


def delete_chunks(
    chunks: DataFrame, ids: DataFrame | None = None, doc_type: str | None = None, collection: str | None = None
) -> DataFrame:
    """Chunks that stay after a delete by id, by document type or of a whole collection."""
    if ids is not None:
        chunks = chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti")
    if doc_type is not None:
        chunks = chunks.filter(~F.col("doc_type").eqNullSafe(F.lit(doc_type)))
    if collection is not None:
        chunks = chunks.filter(~F.col("collection").eqNullSafe(F.lit(collection)))
    return chunks


_DOC_KEY = ["user_id", "canonical_url", "source_type"]


def _same(left: str, right: str) -> Column:
    """Equal keys; a missing part equals a missing part."""
    tests = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in _DOC_KEY]
    return tests[0] & tests[1] & tests[2]


def upsert_document_version(
    docs: DataFrame, versions: DataFrame, incoming: DataFrame, group_limit: int = runtime.GROUP_ROW_LIMIT
) -> tuple[DataFrame, DataFrame]:
    """Save documents by (user, canonical URL, source type); every save appends a version.

    ``docs``: key, document_id, title, summary, last_fetched_at, current_version_id. ``versions``:
    document_id, version_id, version_no, content_hash, created_at. ``incoming``: key,
    document_id (used for a new document), version_id, title, summary, content_hash, fetched_at.
    """
    place = F.struct("fetched_at", "version_id")
    latest = incoming.groupBy(*_DOC_KEY).agg(
        F.max_by(F.struct("title", "summary", "fetched_at", "version_id"), place).alias("new"),
        F.min_by("document_id", place).alias("new_id"),
    )
    merged = docs.alias("d").join(latest.alias("l"), _same("d", "l"), "full").select(
        *[F.coalesce(f"d.{c}", f"l.{c}").alias(c) for c in _DOC_KEY],
        F.coalesce("document_id", "new_id").alias("document_id"),
        F.coalesce("new.title", "title").alias("title"),
        F.coalesce("new.summary", "summary").alias("summary"),
        F.coalesce("new.fetched_at", "last_fetched_at").alias("last_fetched_at"),
        F.coalesce("new.version_id", "current_version_id").alias("current_version_id"),
    )
    ids = merged.select(*_DOC_KEY, "document_id")
    saved = incoming.drop("document_id").alias("n").join(ids.alias("m"), _same("n", "m")).select("n.*", "m.document_id")
    numbered = runtime.ranked(
        saved, ["document_id"], [F.asc("fetched_at"), F.asc("version_id")], "_n", group_limit
    )
    last = versions.groupBy("document_id").agg(F.max("version_no").alias("_last"))
    added = numbered.join(last, "document_id", "left").select(
        "document_id",
        "version_id",
        (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("long").alias("version_no"),
        "content_hash",
        F.col("fetched_at").alias("created_at"),
    )
    return merged, versions.unionByName(added)


def backfill_source_version(sources: DataFrame, saved: DataFrame) -> DataFrame:
    """Set the document version on the sources of saved messages (message_id, document_version_id)."""
    # of several saves of a message the latest version counts, so that no source is doubled
    new = saved.groupBy("message_id").agg(F.max("document_version_id").alias("_new"))
    return (
        sources.join(new, "message_id", "left")
        .withColumn("document_version_id", F.coalesce("_new", "document_version_id"))
        .drop("_new")
    )


def append_idempotent(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Jobs to append: no queued, claimed or completed job and no earlier new one has the key.

    Jobs without a key are always appended.
    """
    blocked = existing.filter(F.col("status").isin(*BLOCKING_STATUSES)).select("idempotency_key").distinct()
    keyed = F.coalesce("idempotency_key", F.lit("")) != ""
    fresh = incoming.filter(keyed).join(blocked, "idempotency_key", "left_anti")
    fresh = fresh.unionByName(incoming.filter(~keyed))
    firsts = first_per_key(fresh, "idempotency_key", "job_id", ["created_at"])
    return fresh.join(firsts, "job_id", "left_semi").withColumn("status", F.lit("queued"))


def markdown_files(df: DataFrame) -> DataFrame:
    """(user_id, file_name, body) of rows with user_id, title, content, file_id."""
    title = X.strip(F.coalesce("title", F.lit("")))
    body = X.strip(F.col("content"))
    return df.filter(body != "").select(
        "user_id",
        F.concat(X.sanitize_filename(title), F.lit("-"), F.col("file_id").cast("string"), F.lit(".md")).alias("file_name"),
        F.when(title != "", F.concat(F.lit("# "), title, F.lit("\n\n"), body)).otherwise(body).alias("body"),
    )


# Folder of a missing value, and the characters that Spark escapes in names of folders.
_MISSING = b"__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(rb"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]")


def _folder(column: str) -> Column:
    """Bytes of a column's value in the name of its folder; nothing is a missing value."""
    text = F.nullif(F.col(column).cast("string"), F.lit(""))
    return F.coalesce(text, F.lit(_MISSING.decode())).cast("binary").alias(f"_{column}")


def export_markdown(df: DataFrame, out: str) -> DataFrame:
    """Write every row as its own Markdown folder ``out/user_id=.../file_name=.../`` and return the list.

    A folder per row suits exports of up to some 10^5 files; for more, write ``markdown_files`` as a table.
    The cost is that of the files, not of their bytes: every core writes its share, however few partitions the rows have.
    In a folder of the operating system tasks write the files themselves (Spark's writer starts a process or two per file
    there to set its mode); a file appears by a rename, under a name that a repeated task gives again. In any other store
    Spark's writer is used, and tasks move their own files into place instead of the driver moving all of them one by one.
    """
    spark, files = df.sparkSession, markdown_files(df)
    tasks = FILE_TASKS * spark.sparkContext.defaultParallelism
    root = runtime.local_folder(spark, out)
    if root is not None:
        rows = files.select(_folder("user_id"), _folder("file_name"), F.col("body").cast("binary").alias("value"))
        _write_files(rows.repartition(tasks, "_user_id", "_file_name").sortWithinPartitions("_user_id", "_file_name", "value"), out, root)
        return files.select("user_id", "file_name")
    by_file = files.select("user_id", "file_name", F.col("body").alias("value"))
    writer = by_file.repartition(tasks, "user_id", "file_name").write.mode("overwrite")
    writer = writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy("user_id", "file_name").text(out)
    return files.select("user_id", "file_name")


def _write_files(rows: DataFrame, out: str, root: str) -> None:
    """The files of ``rows`` (_user_id, _file_name, value), of which those of a file follow each other, as Spark's text writer names them."""
    spark, run, top = rows.sparkSession, uuid.uuid4().hex.encode(), os.fsencode(root)
    runtime.ship_package(spark)
    runtime.delete_folder(spark, out)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, bytes]]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("_user_id", "_file_name", "value")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = b"part-%05d-%s-c000.txt" % (task.partitionId(), run)
        made, n = set(), 0
        for (user, file), own in groupby(lines(batches), key=lambda line: line[:2]):
            user, file = [_ESCAPED.sub(lambda m: b"%%%02X" % m[0][0], part) for part in (user, file)]
            above = os.path.join(top, b"user_id=" + user)
            folder = os.path.join(above, b"file_name=" + file)
            if user not in made:
                os.makedirs(above, exist_ok=True)
                made.add(user)
            try:
                os.mkdir(folder)
            except FileExistsError:  # a repeated task
                pass
            part = os.path.join(folder, b".%s.%d" % (name, task.taskAttemptId()))
            with open(part, "wb") as to:
                for *_, value in own:
                    to.write(value + b"\n")
            os.replace(part, os.path.join(folder, name))
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    rows.mapInArrow(write, "files long").agg(F.sum("files")).collect()
    runtime.create_file(spark, f"{out}/_SUCCESS")


def read_markdown(spark: SparkSession, out: str) -> DataFrame:
    """user_id, file_name (both as texts), value: every file below ``out``, read whole.

    In a folder of the operating system the tasks list and read what the users' folders hold, a large one in shares;
    a task per few files, as Spark's reader plans them, takes longer than the files.
    """
    root = runtime.local_folder(spark, out)
    if root is None:
        found = spark.read.text(out, wholetext=True)
        return found.select(F.col("user_id").cast("string"), F.col("file_name").cast("string"), "value")
    runtime.ship_package(spark)
    tasks, top = FILE_TASKS * spark.sparkContext.defaultParallelism, os.fsencode(root)
    users = [e.name for e in os.scandir(top) if e.name.startswith(b"user_id=")]
    shares = max(1, -(-tasks // max(1, len(users))))
    work = spark.createDataFrame([(u, i) for u in users for i in range(shares)], "user binary, share int")

    def plain(name: bytes) -> bytes | None:
        value = name.partition(b"=")[2]
        return None if value == _MISSING else re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), value)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes | None, bytes | None, bytes]]:
        for batch in batches:
            for user, share in zip(*[batch.column(c).to_pylist() for c in ("user", "share")]):
                for folder in os.scandir(os.path.join(top, user)):
                    if not folder.name.startswith(b"file_name=") or zlib.crc32(folder.name) % shares != share:
                        continue
                    for file in os.scandir(folder.path):
                        if not file.name.startswith((b".", b"_")):
                            with open(file.path, "rb") as of:
                                yield plain(user), plain(folder.name), of.read()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in found(batches):
            rows.append(row)
            size += len(row[2]) + 100
            if size >= READ_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names)

    names = ["user_id", "file_name", "value"]
    files = work.repartition(max(1, min(tasks, len(users) * shares))).mapInArrow(read, ", ".join(f"{n} binary" for n in names))
    return files.select(*[F.col(n).cast("string") for n in names])
