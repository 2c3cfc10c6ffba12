"""Chunks stored in buckets of the chunk id's hash: an upsert or delete rewrites the buckets that it touches, no others.

Layout: ``path/of=<number of buckets>/bucket=<k>``. A change is written in two steps. The new rows of the touched buckets go
to ``path-change/rows``, then their numbers to ``path-change/touched``; from then on the change counts. It is applied by a
dynamic partition overwrite, which may be repeated. A change whose application was cut off is applied by the next call, so a
driver that dies in between loses nothing. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit import runtime
from corpuskit.operators.retrieval import collection_of

# Choose so many that a bucket holds some 100 MB: it is written by one task. Only bucket numbers come to the driver.
BUCKETS = 256
# Buckets that a change rewrites in one round; a round's shuffle files are deleted before the next, the new rows read again.
PER_ROUND = 64
# Rows of one id that an upsert takes to its bucket uncombined.
REPEATS = 1_000


def bucket_of(chunk_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(chunk_id), F.lit(buckets)).cast("int")


def write(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store chunks with distinct, non-null ids, at least one; what the folder held before is replaced.

    The store takes its columns from its files: it cannot start without a chunk, nor be read once all are deleted.
    """
    spark = chunks.sparkSession
    runtime.delete_folder(spark, f"{path}-change")
    placed = chunks.withColumns({"of": F.lit(buckets), "bucket": bucket_of(F.col("chunk_id"), buckets)})
    # a bucket is one task's work, so it is one file
    _store(placed.repartition("of", "bucket"), path, "overwrite")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored chunks. A change that was cut off is applied first."""
    _apply(spark, path)
    return spark.read.parquet(path).drop("of", "bucket")


def upsert(spark: SparkSession, path: str, incoming: DataFrame, per_round: int = PER_ROUND) -> int:
    """Replace or add chunks by id, and return the number of buckets rewritten.

    ``incoming`` has a ``batch`` column; of rows with the same id the highest batch counts, then the largest other columns
    in the order of the store. The collection follows the document type. Columns that are missing become null, columns that
    the store lacks are an error; rows without an id are left out, as nothing could replace them.
    """

    _apply(spark, path)
    stored = spark.read.parquet(path)
    routed = incoming.withColumn("collection", collection_of(F.col("doc_type")))
    unknown = set(routed.columns) - {"batch"} - set(stored.columns)
    if unknown:
        raise ValueError(f"the store has no columns {sorted(unknown)}")
    own = [f for f in stored.schema if f.name not in ("chunk_id", "of", "bucket")]
    row = F.struct(*[(F.col(f.name) if f.name in routed.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in own])
    id_type = stored.schema["chunk_id"].dataType
    rows = routed.select(F.col("chunk_id").cast(id_type).alias("chunk_id"), "batch", row.alias("r"))
    return _change(spark, path, rows.filter("chunk_id IS NOT NULL"), per_round)


def delete(spark: SparkSession, path: str, ids: DataFrame, per_round: int = PER_ROUND) -> int:
    """Remove chunks by id, and return the number of buckets rewritten. Ids that are not stored change no bucket."""
    _apply(spark, path)
    stored = spark.read.parquet(path)
    wanted = ids.select(F.col("chunk_id").cast(stored.schema["chunk_id"].dataType).alias("chunk_id")).distinct()
    nothing = F.lit(None).cast(_row(stored).schema["r"].dataType)
    gone = stored.select("chunk_id").join(wanted, "chunk_id", "left_semi")
    return _change(spark, path, gone.select("chunk_id", F.lit(0).alias("batch"), nothing.alias("r")), per_round)


def _row(stored: DataFrame) -> DataFrame:
    """Stored chunks as id, bucket and the struct of all other columns."""
    return stored.select("chunk_id", "bucket", F.struct(*_own(stored)).alias("r"))


def _own(stored: DataFrame) -> list[str]:
    return [c for c in stored.columns if c not in ("chunk_id", "of", "bucket")]


def _change(spark: SparkSession, path: str, new: DataFrame, per_round: int) -> int:
    """Write the touched buckets aside with the new rows (chunk_id, batch, r), then apply them.

    A row whose ``r`` is null removes its id. Stored and new rows meet in one shuffle by bucket, where a new row beats the
    stored one; ids with more than REPEATS new rows are combined before. New rows are read once for the numbers and once per round.
    """
    number = _buckets(spark, path)
    new = new.withColumn("bucket", bucket_of(F.col("chunk_id"), number))
    ids = new.groupBy("bucket", "chunk_id").count()
    touched = runtime.materialize(ids.groupBy("bucket").agg(F.max("count").alias("most")))
    found = touched.collect()  # at most the number of buckets
    if found:
        if max(r.most for r in found) > REPEATS:
            new = new.groupBy("bucket", "chunk_id").agg(F.max(F.struct("batch", "r")).alias("m"))
            new = new.select("bucket", "chunk_id", "m.batch", "m.r")
        stored = spark.read.parquet(path)
        # null (stored) is smaller than true (new)
        kept = _row(stored).withColumns({"batch": F.lit(None).cast(new.schema["batch"].dataType), "new": F.lit(None).cast("boolean")})
        both = kept.unionByName(new.withColumn("new", F.lit(True)))
        own = [F.col(f"m.r.`{c}`") for c in _own(stored)]
        numbers = sorted(r.bucket for r in found)
        for k in range(0, len(numbers), per_round):
            part = both.filter(F.col("bucket").isin(numbers[k : k + per_round])).repartition("bucket")
            last = part.groupBy("bucket", "chunk_id").agg(F.max(F.struct("new", "batch", "r")).alias("m"))
            rows = last.filter("m.r IS NOT NULL").select("chunk_id", *own, F.lit(number).alias("of"), "bucket")
            _store(rows.select(stored.columns), f"{path}-change/rows", "append" if k else "overwrite")
        touched.select("bucket").coalesce(1).write.mode("overwrite").parquet(f"{path}-change/touched")
        _apply(spark, path)
    return len(found)


def _apply(spark: SparkSession, path: str) -> None:
    """Apply the change that is written aside, if it is complete."""
    if "_SUCCESS" not in runtime.folder_names(spark, f"{path}-change/touched"):
        return
    number = _buckets(spark, path)
    stored = spark.read.parquet(path).schema
    rows = spark.read.schema(stored).parquet(f"{path}-change/rows")
    # the rows lie in buckets already and are not shuffled again
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("of", "bucket").parquet(path)
    # an overwrite leaves alone the buckets for which it has no rows
    filled = rows.select("bucket").distinct()
    for r in spark.read.parquet(f"{path}-change/touched").join(filled, "bucket", "left_anti").collect():
        runtime.delete_folder(spark, f"{path}/of={number}/bucket={r.bucket}")
    runtime.delete_folder(spark, f"{path}-change/touched")
    runtime.delete_folder(spark, f"{path}-change")


def _buckets(spark: SparkSession, path: str) -> int:
    return next(int(name[3:]) for name in runtime.folder_names(spark, path) if name.startswith("of="))


def _store(placed: DataFrame, path: str, mode: str) -> None:
    with runtime.shuffles_deleted(placed.sparkSession):
        placed.write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("of", "bucket").parquet(path)
