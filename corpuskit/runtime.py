"""Session helpers shared by the operators: lineage cuts, size checks, ranking of hot groups."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Rows of one window group that a single task may rank; larger groups are split by range.
GROUP_ROW_LIMIT = 2_000_000
# Limits for data that is shipped to every task (queries of a batch search).
SHIPPED_ROW_LIMIT = 5_000
SHIPPED_CHAR_LIMIT = 16_000_000

_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpuskit-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, used by iterative operators."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame) -> DataFrame:
    """Write to a new table in the shared folder and read it back: computed once, for costly rows.

    (A checkpoint runs its last stage twice.)
    """
    path = f"{shared_dir(df.sparkSession)}/corpuskit-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete their shuffle files when they end, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` wrote. Call it when their results are stored."""
    while _tables:
        delete_folder(spark, _tables.pop())


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, none if it does not exist. For folders whose entries do not grow with the data."""
    at, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def local_folder(spark: SparkSession, path: str) -> str | None:
    """Path of a folder that the operating system reaches (local or mounted on every executor), None in any other store."""
    at, fs = _path(spark, path)
    found = fs.makeQualified(at).toUri()
    return found.getPath() if found.getScheme() == "file" else None


def create_file(spark: SparkSession, path: str) -> None:
    """An empty file, with the folders above it."""
    at, fs = _path(spark, path)
    fs.create(at, True).close()


def delete_folder(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest group (map-side combined count, one number to the driver)."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str,
    group_limit: int = GROUP_ROW_LIMIT,
) -> DataFrame:
    """``row_number`` per key. A key with more than ``group_limit`` rows is spread over tasks.

    Large groups: range-partition on key and order, number the rows inside each partition and
    add the row counts of the key's earlier partitions. No task sees a whole hot group.
    """
    if largest_group(df, keys) <= group_limit:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    by = [F.col(k) for k in keys] + list(order)
    placed = cut_lineage(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_pos", F.monotonically_increasing_id())
    ).withColumn("_block", F.shiftright("_pos", 33))
    blocks = placed.groupBy(*keys, "_block").agg(F.min("_pos").alias("_start"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    on = [*keys, "_block"]
    offsets = offsets.select(*[F.col(k).alias(f"_of_{k}") for k in on], "_start", "_offset")
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in on]
    return placed.join(offsets, same).select(
        *df.columns,
        (F.col("_offset") + F.col("_pos") - F.col("_start") + 1).cast("long").alias(out),
    )


def fits_in_tasks(df: DataFrame, size_of_row: Column, row_limit: int, char_limit: int) -> bool:
    """True when ``df`` is small enough to be shipped to every task."""
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size_of_row), F.lit(0)).alias("chars")).first()
    return size["n"] <= row_limit and size["chars"] <= char_limit


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    columns: Sequence[str],
    group_limit: int = GROUP_ROW_LIMIT,
) -> DataFrame:
    """Add ``prev_<column>`` of the row before, per key; large groups are joined on their rank."""
    if largest_group(df, keys) <= group_limit:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({f"prev_{c}": F.lag(c).over(window) for c in columns})
    numbered = ranked(df, keys, order, "_rank", group_limit)
    before = numbered.select(*keys, (F.col("_rank") + 1).alias("_rank"), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return numbered.join(before, [*keys, "_rank"], "left").drop("_rank")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corpuskit-code-")) / "corpuskit.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in package.rglob("*.py"):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores when it has fewer partitions than that (few row groups).

    A large input has more splits than cores and is read as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
