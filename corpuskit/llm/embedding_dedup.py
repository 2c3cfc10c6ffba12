"""Near-duplicate vectors: Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm import common

# Tables, projections per table, and the width that projections of unit vectors are quantised by. Unit vectors of cosine
# 0.9 are 0.447 apart, meet in one projection with probability 0.82 and in some table with 0.97; unrelated ones (distance
# 1.41) meet in a given table with 0.0007.
TABLES, PROJECTIONS, WIDTH = 24, 10, 2.0
LEAST = 0.9
# Members of a block, and parts by which the rows of one bucket are dealt out to learn its number of blocks.
BLOCK, SALTS = 512, 16


@functools.cache
def _projections(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(size)
    a = rng.normal(size=(size, TABLES * PROJECTIONS))
    shift = rng.uniform(0, WIDTH, TABLES * PROJECTIONS)
    codes = rng.integers(1, 2**63, (TABLES, PROJECTIONS), dtype=np.int64).astype(np.uint64) | np.uint64(1)
    return a, shift, codes


def buckets(units: np.ndarray) -> np.ndarray:
    """(vectors, TABLES) bucket hashes of unit vectors: floor((a x + b) / WIDTH) of the table's projections."""
    a, shift, codes = _projections(units.shape[1])
    cells = np.floor((units @ a + shift) / WIDTH).astype(np.int64).astype(np.uint64).reshape(-1, TABLES, PROJECTIONS)
    h = (common.mix(cells + np.uint64(0x9E3779B97F4A7C15)) * codes).sum(axis=2, dtype=np.uint64)
    return common.mix(h + np.uint64(units.shape[1])).view(np.int64)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector with an id.

    Two vectors are linked when some table puts them in one bucket and their cosine, in double precision, is at least
    ``least``. Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors
    of different lengths neither. Of rows that repeat an id the one with the smallest vector counts.

    Equal vectors are one class with a count, so copies cost nothing. A bucket of many classes is cut into blocks that
    are compared pair by pair of blocks, in as many tasks; a comparison gives link counts and the edges of a spanning
    forest, not the pairs. A pair that an earlier table has put together is counted there.
    """
    spark = vectors.sparkSession
    steps = common.Steps(spark)
    rows = common.one_row_per_id(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")), "vec_id", "v")
    read = steps.write(rows.mapInArrow(_read, "vec_id long, key binary, unit binary"))
    good = read.filter("key is not null")
    classes = steps.write(good.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit")))
    placed = classes.select("rep", "copies", "unit").mapInArrow(_place, "rep long, copies long, unit binary, cells binary, t int, bucket long")
    placed = placed.withColumn("_salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    narrow = placed.select("t", "bucket")
    large = narrow.groupBy("t", "bucket").count().filter(F.col("count") > BLOCK)
    large = large.select("t", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    placed = placed.join(large, ["t", "bucket", "_salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep", "t"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks", "_salt")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.sorted_groups(batches, ("t", "bucket", "i", "j")):
            if group.num_rows > 1:
                yield from _compare(group, least)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = placed.repartition(tasks, "t", "bucket", "i", "j").sortWithinPartitions("t", "bucket", "i", "j")
    found = steps.write(met.mapInArrow(compare, "kind int, a long, b long"))
    links = found.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("linked"))
    component = steps.write(common.components(found.filter("kind = 1").select("a", "b"), steps))
    known = classes.drop("unit").join(links, "rep", "left").join(component, classes["rep"] == component["node"], "left")
    known = known.select(
        "key",
        "copies",
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    joined = common.look_up(good.select("vec_id", "key"), known, ["key"], "copies", read.count())
    alone = read.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = joined.select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vector and a digest of the vector; null for vectors that link with nothing."""
    for batch in batches:
        keys, units = [], []
        for value in batch.column(1):
            v = np.array([np.nan if x is None else x for x in value.as_py() or ()], float)
            scale = np.abs(v).max() if len(v) else 0.0
            if not scale > 0 or not np.isfinite(scale):
                keys.append(None)
                units.append(None)
                continue
            w = v / scale  # no overflow in the norm
            keys.append(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest())
            units.append((w / np.sqrt(w @ w)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "key", "unit"])


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class and table, with the hashes of all tables."""
    names = ["rep", "copies", "unit", "cells", "t", "bucket"]
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column("unit")).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            own = batch.filter(pa.array(sizes == size))
            for first in range(0, own.num_rows, 1000):
                part = own.slice(first, 1000)
                units = np.frombuffer(b"".join(part.column("unit").to_pylist())).reshape(part.num_rows, -1)
                h = buckets(units)
                cells = pa.array([row.tobytes() for row in h.astype("<i4")], pa.binary())
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, cells, pa.array(np.full(part.num_rows, t, np.int32)), pa.array(np.ascontiguousarray(h[:, t]))], names
                    )


def _compare(group: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """kind 0: class a links with b more vectors; kind 1: edge (a, b)."""
    t, i, j = (group.column(c)[0].as_py() for c in ("t", "i", "j"))
    own = group.column("own").to_numpy()
    ids, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
    units = np.frombuffer(b"".join(group.column("unit").to_pylist())).reshape(len(ids), -1)
    cells = np.frombuffer(b"".join(group.column("cells").to_pylist()), "<i4").reshape(len(ids), -1)
    near = np.triu(units @ units.T >= least, 1)
    if i != j:
        near &= own[:, None] != own[None, :]
    x, y = np.nonzero(near)
    if t and len(x):
        earlier = np.concatenate([(cells[x[k : k + 20_000], :t] == cells[y[k : k + 20_000], :t]).any(axis=1) for k in range(0, len(x), 20_000)])
        x, y = x[~earlier], y[~earlier]
    if not len(x):
        return
    counts = np.zeros(len(ids), np.int64)
    np.add.at(counts, x, copies[y])
    np.add.at(counts, y, copies[x])
    some = np.flatnonzero(counts)
    root = _roots(len(ids), x, y)
    edge = np.flatnonzero(root != np.arange(len(ids)))
    kinds = np.repeat(np.array([0, 1], np.int32), [len(some), len(edge)])
    a = np.concatenate([ids[some], ids[edge]])
    b = np.concatenate([counts[some], ids[root[edge]]])
    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(a), pa.array(b)], ["kind", "a", "b"])


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest index reachable, by passing minima along the pairs."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if (new == root).all():
            return root
        root = new
