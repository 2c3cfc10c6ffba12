"""Best-fit packing of documents into training sequences, with conflicts by source and by duplicate cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm import common, exact_dedup

# Units of a sequence, documents of one source that it may hold, and documents that are packed together.
CAPACITY, PER_SOURCE, SHARD_ROWS = 2_048, 2, 2_000
OUT = "doc_id long, piece long, start long, n_units long, bin_id long, place long"


class Bins:
    """Open bins by what they have left. A bin has a bitmap of sources and one of duplicate clusters.

    Bins with equal rest share a list; its intersections of bitmaps tell when none of them can take a document, and a
    bitmap of the rests that occur gives the next larger one.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.by_rest: dict[int, list[int]] = {}
        self.common: dict[int, tuple[int, int]] = {}
        self.rests = 0
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.filled: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, place in it) of a document; source and cluster are bit numbers, -1 for none.

        The tightest compatible bin takes it, the oldest of equals; a new one if there is none. A source has
        ``per_source`` bits, and a bin where the last of them is set is full for that source.
        """
        full = 1 << (source * self.per_source + self.per_source - 1) if source >= 0 else 0
        twin = 1 << cluster if cluster >= 0 else 0
        left = self.rests >> size
        at = size
        while left:
            skip = (left & -left).bit_length() - 1
            at += skip
            left >>= skip
            all_sources, all_clusters = self.common[at]
            if not (all_sources & full or all_clusters & twin):
                for b in self.by_rest[at]:
                    if not (self.sources[b] & full or self.clusters[b] & twin):
                        self._move(b, at, at - size, source, twin)
                        return b, self.filled[b] - 1
            left >>= 1
            at += 1
        b = len(self.sources)
        self.sources.append(0)
        self.clusters.append(0)
        self.filled.append(0)
        self._move(b, None, self.capacity - size, source, twin)
        return b, 0

    def _move(self, b: int, before: int | None, rest: int, source: int, twin: int) -> None:
        if before is not None:
            self.by_rest[before].remove(b)
            self._sum_up(before)
        self.filled[b] += 1
        self.clusters[b] |= twin
        if source >= 0:
            own = self.sources[b] >> (source * self.per_source)
            used = (~own & -~own).bit_length() - 1  # lowest bit that is free
            self.sources[b] |= 1 << (source * self.per_source + used)
        if rest:
            self.by_rest.setdefault(rest, []).append(b)
            self.by_rest[rest].sort()
            self._sum_up(rest)

    def _sum_up(self, rest: int) -> None:
        own = self.by_rest[rest]
        if not own:
            self.rests &= ~(1 << rest)
            return
        self.rests |= 1 << rest
        sources, clusters = self.sources[own[0]], self.clusters[own[0]]
        for b in own[1:]:
            sources &= self.sources[b]
            clusters &= self.clusters[b]
        self.common[rest] = (sources, clusters)


def pack(
    docs: DataFrame,
    size: Column,
    source: Column,
    cluster: Column,
    id_col: str = "doc_id",
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """doc_id, piece, start, n_units, bin_id, place: where every unit of every document goes.

    A document of more than ``capacity`` units is cut: full pieces are sequences of their own, the last piece is packed.
    A sequence holds no two documents of one ``cluster`` and at most ``per_source`` of one ``source``; a null value
    conflicts with nothing. A null or negative size counts as 0 and takes a place but no room. Rows without an id are
    left out; every other row is placed, repeated ones each for themselves.

    Documents are dealt by the hash of their id into shards of about ``shard_rows``, so every shard has its share of a
    large source or cluster, and each shard is packed in decreasing order of size by one task. A shard's bins are not
    shared with other shards, which costs a part of a bin or so per shard.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(source.cast("string")).alias("source"),
        source.isNotNull().alias("has_source"),
        F.xxhash64(cluster.cast("string")).alias("cluster"),
        cluster.isNotNull().alias("has_cluster"),
    ).filter("doc_id is not null")
    shards = max(1, -(-docs.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(shards)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.sorted_groups(batches, ("shard",)):
            out = pack_shard(group, capacity, per_source)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], OUT.replace(" long", "").split(", "))

    tasks = min(shards, common.partitions(spark, shards, 4))
    return rows.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(run, OUT)


def pack_shard(group: pa.Table, capacity: int, per_source: int) -> np.ndarray:
    """Rows of one shard, as columns of OUT."""
    ids, sizes, shard = (group.column(c).to_numpy() for c in ("doc_id", "size", "shard"))
    bits = []
    for name in ("source", "cluster"):
        _, own = np.unique(group.column(name).to_numpy(), return_inverse=True)
        bits.append(np.where(group.column(f"has_{name}").to_numpy(zero_copy_only=False), own, -1))
    rest = np.where(sizes > 0, (sizes - 1) % capacity + 1, 0)
    bins = Bins(capacity, per_source)
    out: list[tuple[int, int, int, int, int, int]] = []
    base = int(shard[0]) << 32
    later: list[tuple[int, int, int, int, int]] = []
    for k in np.lexsort((bits[1], sizes, ids, -rest)):
        full = int(sizes[k] - rest[k]) // capacity
        b, place = bins.put(int(rest[k]), int(bits[0][k]), int(bits[1][k]))
        out.append((int(ids[k]), full, full * capacity, int(rest[k]), base + b, place))
        later += [(int(ids[k]), p, p * capacity, capacity, 0) for p in range(full)]
    first = base + len(bins.sources)
    out += [(i, p, s, n, first + j, place) for j, (i, p, s, n, place) in enumerate(later)]
    return np.array(out, np.int64).reshape(-1, 6).T


def words(text: Column) -> Column:
    """Words of a text and one for its end."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1


def copies(text: Column) -> Column:
    """Duplicate cluster of a text: the digest that op3 compares, so white-space variants are one cluster."""
    return F.sha2(exact_dedup.normalised(text), 256)
