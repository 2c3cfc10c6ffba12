"""Helpers of the operators: inputs, tables between steps, word hashes, connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit import runtime

# The white space of the contracts, [\x20\x09-\x0D].
SPACE = r"[\x20\x09-\x0D]+"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# Bytes of text that one vectorised step handles: bounds the memory of a task.
STEP_BYTES = 500_000
# Distinct words whose results a worker keeps, in each of two generations.
CACHED_WORDS = 700_000
U64 = np.uint64


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``doc_id`` (long), ``text`` (null becomes empty) and the named columns; whatever else the table has stays out."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more
    )


def one_row_per_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows without an id are left out; of rows that repeat an id the one with the smallest text stays.

    The ids alone are counted first, so texts are shuffled only where an id does repeat.
    """
    df = df.filter(F.col(id_col).isNotNull())
    repeated = df.groupBy(id_col).count().filter("count > 1")
    if repeated.isEmpty():
        return df
    others = [F.first(c).alias(c) for c in df.columns if c not in (id_col, text_col)]
    return df.groupBy(id_col).agg(F.min(text_col).alias(text_col), *others).select(*df.columns)


class Steps:
    """Tables between the steps of one operator, written to the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{runtime.shared_dir(spark)}/llm-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        """Compute once and read back; the shuffle files of the finished step are released."""
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        back._keep = self
        release_shuffles(self.spark)
        return back

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        delete(self.spark, self.paths.pop(id(df)))


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def release_shuffles(spark: SparkSession) -> None:
    """Spark deletes shuffle files once the driver has collected the plans that made them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partition count that grows with the data, at least the session's own."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


# ---- bytes of Arrow batches -------------------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls, not copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None:
        return np.empty(0, np.uint8), offsets
    return np.frombuffer(column.buffers()[2], np.uint8), offsets


def slices(offsets: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``step`` bytes; a longer document is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + step, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


_BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_CODES = _BYTE_CODES[_LOWER]


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, separates: np.ndarray = IS_SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (bytes between separators, A-Z lowered) of consecutive documents, and their word offsets.

    data: the bytes; offsets: len(documents) + 1 ends into them; separates: by byte, white space unless given.
    Returns (hash per word, offsets of each document's words).
    """
    begin, end = int(offsets[0]), int(offsets[-1])
    part = data[begin:end]
    word = ~separates[part]
    at = np.flatnonzero(word)
    if not len(at):
        return np.empty(0, U64), np.zeros(len(offsets), np.int64)
    first = np.empty(len(part), bool)
    first[0] = True
    np.logical_not(word[:-1], out=first[1:])
    bounds = offsets[:-1] - begin
    first[bounds[bounds < len(part)]] = True
    first &= word
    starts = np.flatnonzero(first)
    # index among the word bytes at which each word starts
    rank = np.searchsorted(at, starts)
    lengths = np.diff(np.append(rank, len(at)))
    place = np.arange(len(at)) - np.repeat(rank, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), 0x9FB21C651E98DF25, U64))
    h = np.add.reduceat(_LOWER_CODES[part[at]] * powers[place], rank)
    return mix(h + lengths.astype(U64)), np.searchsorted(starts, offsets - begin)


def sorted_groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of equal ``by`` from sorted batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for k, (first, last) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            part = batch.slice(first, last - first)
            if k == 0 and rest and any(rest[-1].column(c)[0].as_py() != part.column(c)[0].as_py() for c in by):
                yield pa.Table.from_batches(rest)
                rest = []
            elif k:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(part)
    if rest:
        yield pa.Table.from_batches(rest)


# ---- words -----------------------------------------------------------------------------------------------------------


class WordCache:
    """Results of ``make`` by word. The older of two generations is given up when the younger is full."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], size: int = CACHED_WORDS):
        self.make, self.size = make, size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def table(self, lists: list[list[str]]) -> dict[str, bytes]:
        """Results of the distinct words of a bundle of texts. Each is looked up here once, however often it occurs."""
        young, old = self.young, self.old
        words = set().union(*lists)
        found = dict(zip(words, map(young.get, words), strict=True))
        missing = [w for w, x in found.items() if x is None]
        if missing:
            known = {w: old[w] for w in missing if w in old}
            new = [w for w in missing if w not in known]
            known.update(zip(new, self.make(new), strict=True))
            if len(young) + len(known) > self.size:
                self.old, self.young = young, {}
            self.young.update(known)
            found.update(known)
        return found


def bundles(texts: list[str], size: int = STEP_BYTES) -> Iterator[list[str]]:
    """Consecutive texts of about ``size`` characters together; a longer one alone."""
    own: list[str] = []
    count = 0
    for t in texts:
        if own and count + len(t) > size:
            yield own
            own, count = [], 0
        own.append(t)
        count += len(t)
    if own:
        yield own


# ---- connected components ---------------------------------------------------------------------------------------


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for the nodes of ``edges`` (a, b), long.

    Alternating large and small stars: every round is two grouped minima and two joins, the edges are written to the
    shared folder, and rounds grow with the logarithm of the largest component. Nothing but the answer whether a round
    is the last comes to the driver.
    """
    now = steps.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(now):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(_edge("a", "m"), _edge("b", "m"))).alias("e")).select("e.*")
        new = steps.write(small.filter("a <> b").distinct())
        steps.drop(now)
        now = new
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """True when every node has one smaller neighbour, which has none itself: then that one is the component."""
    heads = edges.select(F.col("b").alias("a")).distinct()
    return edges.select("a").union(heads).groupBy("a").count().filter("count > 1").isEmpty()


def _edge(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


# ---- members of groups ------------------------------------------------------------------------------------------

# Groups above this share of all rows are joined by broadcast: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def look_up(members: DataFrame, groups: DataFrame, on: list[str], size: str, rows: int) -> DataFrame:
    """Inner join of ``members`` with their group (unique by ``on``); ``size`` is the group's number of members.

    Groups above HOT_SHARE of all ``rows`` are at most 1,000 and are broadcast, so a group that holds a third of all
    rows is never shuffled into one task; the others are joined by a shuffle.
    """
    hot = max(1, int(rows * HOT_SHARE))
    extra = [c for c in groups.columns if c not in on]
    large = groups.filter(F.col(size) > hot).withColumn("_large", F.lit(True))
    marked = members.join(F.broadcast(large), on, "left")
    found = marked.filter("_large").select(*members.columns, *extra)
    rest = marked.filter("_large is null").select(*members.columns)
    return found.unionByName(rest.join(groups.filter(F.col(size) <= hot), on).select(*members.columns, *extra))
