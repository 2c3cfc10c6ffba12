"""Exact Jaccard join over word shingles with parity sketches.

A set's sketch has as many lanes as its size band asks for. A shingle is XORed into the lane that its hash names, so two
sketches differ in at most as many lanes as the sets' symmetric difference has members, and two sets that link must
agree on the other lanes (pigeonhole). Each set therefore publishes its first d + 1 filled lanes in one global order,
where d is the largest difference that a partner may have; sets that publish the same lane are candidates. A second
parity sketch of single bits, whose Hamming distance also bounds the difference from below, discards most candidates;
the others are verified on their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm import common

WORDS, PERCENT = 5, 75
# Published lanes of one reducing task, and parts of the lanes per task.
LANES_EACH, PARTS_EACH = 1_000_000, 8
# Members of lanes of one task that compares them, and documents to be verified whose ids are broadcast.
ROWS_EACH, SHIPPED_IDS = 100_000, 2_000_000
# Documents and lanes that a reading task gathers before it sends them on.
FLUSH_LANES = 700_000
# Members of a lane within one such bundle beyond which only the smallest goes to the lane's common task.
LOCAL_GROUP = 64
# Members of a block where the sets of a lane are compared block by block, and members of a lane beyond which a pair is
# reported by one of its common lanes only.
BLOCK, WIDE = 128, 128
LOW39, MARK = np.uint64((1 << 39) - 1), np.uint64(1 << 39)


# ---- sets and sketches ------------------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; fewer words than ``words`` are one shingle, none no shingle."""
    w, bounds = common.word_hashes(data, offsets)
    if len(w) >= words:
        h = np.zeros(len(w) - words + 1, np.uint64)
        for j in range(words):
            h = h * np.uint64(0x9FB21C651E98DF25) + w[j : j + len(h)]
        h = common.mix(h)
    out = []
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        if last - first >= words:
            out.append(np.unique(h[first : last - words + 1]))
        elif last > first:
            one = np.array([last - first], np.uint64)
            for x in w[first:last]:
                one = common.mix(one * np.uint64(0xA24BAED4963EE407) + x)
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two order-free sums: equal sets have equal ones, and different sets different ones but for chance of 2**-128."""
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(common.mix(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def bit_sketch(s: np.ndarray) -> bytes:
    """Parity bits at least twice as many as members, a power of two: hash h flips bit h mod size."""
    size = max(64, 1 << int(2 * len(s) - 1).bit_length()) if len(s) else 64
    bits = (np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch with fewer bits: halves XORed until ``size`` bytes are left."""
    a = np.frombuffer(sketch, np.uint64)
    while len(a) * 8 > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def largest_difference(total: int, percent: int = PERCENT) -> int:
    """Members that may differ between two linked sets whose sizes sum to ``total``."""
    return (100 - percent) * total // (100 + percent)


def size_bands(top: int, percent: int = PERCENT) -> list[int]:
    """Least size of each band; sets that link are in one band or in neighbouring ones."""
    bands = [1]
    while bands[-1] <= top:
        bands.append(100 * bands[-1] // percent + 1)
    return [*bands, 100 * bands[-1] // percent + 1]


def published(s: np.ndarray, bands: list[int], percent: int = PERCENT) -> np.ndarray:
    """Keys of the lanes that a set publishes: in its own band as the smaller of a pair, in the one below as the larger."""
    n = len(s)
    own = int(np.searchsorted(bands, n, "right")) - 1
    keys = []
    for band in (own, own - 1):
        if band < 0:
            continue
        top = bands[band + 1] - 1
        most = largest_difference(n + (100 * n // percent if band == own else top), percent)
        lanes = 135 * largest_difference(top + 100 * top // percent, percent) // 100 + 12
        lane = (common.mix(s ^ np.uint64(0x2545F4914F6CDD1D + band)) % np.uint64(lanes)).astype(np.int64)
        order = np.argsort(lane)
        lane = lane[order]
        starts = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
        values = np.bitwise_xor.reduceat(s[order], starts)
        salt = np.uint64((band + 1) * 0xD6E8FEB86659FD93 % 2**64)
        filled = np.sort(common.mix(common.mix(values + salt) + lane[starts].astype(np.uint64)))
        keys.append(filled[: most + 1])
        if len(filled) <= most:  # too few filled lanes to be sure of a common one: the empty lanes count as well
            empty = np.setdiff1d(np.arange(lanes), lane[starts]).astype(np.uint64)
            keys.append(common.mix(common.mix(salt + np.zeros(len(empty), np.uint64)) + empty))
    return np.concatenate(keys)


# ---- the join ---------------------------------------------------------------------------------------------------


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles, component_id: documents are linked when 100 * intersection >= percent * union.

    Words are runs of bytes other than \\x20 and \\x09-\\x0D with A-Z lowered; a set holds the distinct shingles of
    ``words`` words, or the whole sequence where there are fewer. A null text is empty; an empty set links with nothing.
    Rows without an id are left out, of rows that repeat an id the one with the smallest text counts.

    1. Every text is read for its set's size, signature and bit sketch. Equal sets are one class.
    2. Lanes are published and met in tasks by their hash. A lane of two gives a pair; of a larger lane the members are
       paired with the one that shares most lanes (of copies with changes, that is the text they were made from).
    3. Pairs that pass sizes and bit sketches are verified; components follow from the links.
    4. Lanes whose members are still in several components are compared in blocks, across components: this finds the
       links that a star leaves out, so the result is that of all pairs.
    """
    spark = docs.sparkSession
    steps = common.Steps(spark)
    docs = common.one_row_per_id(common.texts(docs, id_col, text_col))
    sets = steps.write(_sketches(docs, words))
    filled = sets.filter("n > 0")
    same = ["n", "s1", "s2"]
    classes = steps.write(filled.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")))
    total = sets.agg(F.sum("n").alias("shingles"), F.max("n").alias("top"), F.count("*").alias("rows")).first()
    if not total["shingles"]:
        return sets.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    bands = size_bands(total["top"], percent)
    reps = steps.write(common.look_up(filled.select("doc_id", *same), classes, same, "members", total["rows"]).select("doc_id", "rep"))
    info = filled.join(reps.filter("doc_id = rep"), "doc_id", "left_semi").select("doc_id", "n", "sketch")

    tasks = common.partitions(spark, int(total["shingles"] * 0.6), LANES_EACH)
    met = steps.write(_meet(docs, words, percent, bands, tasks))
    to_rep = reps.filter("doc_id <> rep").select(F.col("doc_id").alias("_id"), "rep")

    def as_rep(df: DataFrame, column: str) -> DataFrame:
        joined = df.join(to_rep, df[column] == to_rep["_id"], "left")
        return joined.withColumn(column, F.coalesce("rep", column)).drop("_id", "rep")

    members = met.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("id")).distinct()
    members = steps.write(as_rep(members, "id").distinct())
    pairs = as_rep(as_rep(met.filter("kind = 0").select("a", "b").distinct(), "a"), "b")
    pairs = pairs.union(_with_centre(members)).filter("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tested = steps.write(_possible(pairs, info, percent))
    steps.drop(met)
    links = _verify(tested, docs, words, percent, steps)
    found = steps.write(common.components(links, steps))

    # stored before the anti-join, which would otherwise be done for every lane that a pair has in common
    met = steps.write(_across(members, found, info, percent))
    more = steps.write(met.join(tested, ["a", "b"], "left_anti"))
    steps.drop(met)
    new = _verify(more, docs, words, percent, steps)
    if not new.isEmpty():
        stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = steps.write(common.components(stars.union(new), steps))
    of_class = classes.join(found, classes["rep"] == found["node"], "left").select(
        *same, "members", F.coalesce("component", "rep").alias("component_id")
    )
    joined = common.look_up(filled.select("doc_id", *same), of_class, same, "members", total["rows"])
    empty = sets.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return joined.select("doc_id", "n", "component_id").union(empty).withColumnRenamed("n", "n_shingles")


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    names = ["doc_id", "n", "s1", "s2", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            for first, last in common.slices(offsets):
                own = shingle_sets(data, offsets[first : last + 1], words)
                signs = [signature(s) for s in own]
                columns = [
                    pa.array([len(s) for s in own], pa.int64()),
                    pa.array([x for x, _ in signs], pa.int64()),
                    pa.array([x for _, x in signs], pa.int64()),
                    pa.array([bit_sketch(s) for s in own], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *columns], names)

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sketch binary")


def _meet(docs: DataFrame, words: int, percent: int, bands: list[int], tasks: int) -> DataFrame:
    """Candidates by common lanes. kind 0: pair (a < b); kind 1: lane a has member b (lanes of three and more).

    Lanes with the same members are one.

    Lanes travel packed: a row holds the lanes of one part from one bundle of documents, as 40-bit hashes, and their
    documents. Texts whose set a task has seen before publish nothing: their class is known from the signature. Lanes
    with many members in one bundle send on the smallest alone, the others skip the common task (``local``).
    """
    parts = tasks * PARTS_EACH

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        keys: list[np.ndarray] = []
        ids: list[int] = []
        waiting = 0
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            numbers = batch.column(0).to_pylist()
            for first, last in common.slices(offsets):
                for k, s in enumerate(shingle_sets(data, offsets[first : last + 1], words), first):
                    if not len(s) or (sign := (len(s), *signature(s))) in seen:
                        continue
                    seen.add(sign)
                    keys.append(published(s, bands, percent))
                    ids.append(numbers[k])
                    waiting += len(keys[-1])
                    if waiting >= FLUSH_LANES:
                        yield from _bundle(keys, ids, parts)
                        keys, ids, waiting = [], [], 0
        if keys:
            yield from _bundle(keys, ids, parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = [], []
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["keys"], np.uint8).reshape(-1, 5)
                wide = np.zeros((len(own), 8), np.uint8)
                wide[:, :5] = own
                k = wide.view("<u8").reshape(-1) | (np.uint64(row["part"]) << np.uint64(40))
                i = np.frombuffer(row["ids"], "<i8" if row["wide"] else "<u4").astype(np.int64) + row["base"]
                if row["local"]:
                    yield from _members(k, i)
                else:
                    keys.append(k)
                    ids.append(i)
        if keys:
            yield from _lanes(np.concatenate(keys), np.concatenate(ids))

    sent = docs.mapInArrow(publish, "part int, local boolean, base long, wide boolean, keys binary, ids binary")
    return sent.repartition(tasks, "part").mapInArrow(meet, "kind int, a long, b long")


def _bundle(keys: list[np.ndarray], ids: list[int], parts: int) -> Iterator[pa.RecordBatch]:
    """Pack lanes by part."""
    own = np.repeat(np.array(ids, np.int64), [len(k) for k in keys])
    key = np.concatenate(keys)
    part = ((key >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
    key = key & LOW39
    order = np.lexsort((own, key, part))
    part, key, own = part[order], key[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
    size = np.diff(np.append(first, len(key)))
    local = np.repeat(size > LOCAL_GROUP, size)
    sent = ~local
    sent[first] = True
    for mask, flag in ((sent, False), (local, True)):
        p, k, i = part[mask], key[mask], own[mask]
        if not flag:
            k = np.where(local[mask], k | MARK, k)
        if not len(p):
            continue
        cuts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        rows = []
        for a, b in zip(cuts, np.append(cuts[1:], len(p)), strict=True):
            base = int(i[a:b].min())
            wide = int(i[a:b].max()) - base >= 1 << 32
            rows.append(
                {
                    "part": int(p[a]),
                    "local": flag,
                    "base": base,
                    "wide": wide,
                    "keys": k[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes(),
                    "ids": (i[a:b] - base).astype("<i8" if wide else "<u4").tobytes(),
                }
            )
        schema = pa.schema([("part", pa.int32()), ("local", pa.bool_()), ("base", pa.int64()), ("wide", pa.bool_()), ("keys", pa.binary()), ("ids", pa.binary())])
        for a in range(0, len(rows), 256):
            yield pa.RecordBatch.from_pylist(rows[a : a + 256], schema)


def _lanes(key: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs from lanes of two, and the members of larger lanes.

    A lane is named by its members, unless some of them (MARK) have gone another way and know it by its key.
    """
    marked, key = (key & MARK) > 0, key & ~MARK
    order = np.lexsort((own, key))
    key, own, marked = key[order], own[order], marked[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    some = np.maximum.reduceat(marked, first)
    two = first[(size == 2) & ~some]
    pairs = np.unique(np.stack([own[two], own[two + 1]]), axis=1) if len(two) else np.empty((2, 0), np.int64)
    yield from _rows(0, pairs[0], pairs[1])
    large = np.repeat(some, size)
    yield from _members(key[large], own[large])
    name = np.add.reduceat(common.mix(own.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), first)
    wanted = np.flatnonzero((size > 2) & ~some)
    _, once = np.unique(name[wanted], return_index=True)
    keep = np.zeros(len(first), bool)
    keep[wanted[once]] = True
    large = np.repeat(keep, size)
    yield from _members(np.repeat(common.mix(name) | (np.uint64(1) << np.uint64(63)), size)[large], own[large])


def _members(key: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from _rows(1, key.view(np.int64), own)


def _rows(kind: int, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(a), 100_000):
        part = slice(k, k + 100_000)
        kinds = np.full(len(a[part]), kind, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(a[part]), pa.array(b[part])], ["kind", "a", "b"])


def _with_centre(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each lane's members with the one that is in most lanes, the smallest id of equals."""
    lanes = members.groupBy("id").agg(F.count("*").alias("lanes"))
    place = F.struct(F.col("lanes").alias("n"), (-F.col("id")).alias("i"))
    centre = members.join(lanes, "id").groupBy("key").agg(F.max(place).alias("c")).select("key", (-F.col("c.i")).alias("a"))
    return members.join(centre, "key").select("a", F.col("id").alias("b"))


def _possible(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and bit sketches allow a link."""
    left = info.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    right = info.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    wide = pairs.join(right, "b").join(left, "a").filter(
        (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_pylist() for c in ("na", "nb"))
            keep = [
                _close(x.as_py(), y.as_py(), largest_difference(m + n, percent))
                for x, y, m, n in zip(batch.column("ka"), batch.column("kb"), na, nb, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return wide.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, "a long, b long")


def _close(x: bytes, y: bytes, most: int) -> bool:
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= most


def _verify(pairs: DataFrame, docs: DataFrame, words: int, percent: int, steps: common.Steps) -> DataFrame:
    """The pairs whose sets link, by their shingles, stored; the shingles are deleted before the next step."""
    ids = steps.write(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    wanted = F.broadcast(ids) if ids.count() <= SHIPPED_IDS else ids  # the texts stay where they are

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            for first, last in common.slices(offsets):
                own = [s.tobytes() for s in shingle_sets(data, offsets[first : last + 1], words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(own, pa.binary())], ["doc_id", "members"])

    stored = steps.write(docs.join(wanted, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, members binary"))
    left = stored.select(F.col("doc_id").alias("a"), F.col("members").alias("ma"))
    right = stored.select(F.col("doc_id").alias("b"), F.col("members").alias("mb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ma"), batch.column("mb"), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = steps.write(pairs.join(right, "b").join(left, "a").select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long"))
    steps.drop(stored)
    steps.drop(ids)
    return links


def _across(members: DataFrame, found: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one lane in different components that sizes and bit sketches allow, compared in blocks.

    Near copies share many lanes, so a pair met in a wide lane is reported by the first lane of both alone.
    """
    rows_in = members.count()
    placed = members.join(found, members["id"] == found["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m"))
    mixed = mixed.filter("x < y").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"), (F.col("m") > WIDE).alias("wide"))
    inside = placed.join(mixed, "key")
    # a document's wide lanes: of those that a pair has in common the first reports it
    wide = inside.filter("wide").groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("lanes"))
    rows = inside.join(info, F.col("id") == F.col("doc_id")).join(wide, "id", "left")
    rows = rows.withColumn("lanes", F.when(F.col("wide"), F.col("lanes")).otherwise(F.array().cast("array<long>")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("key", "id", "component", "n", "sketch", "lanes", "own", others)
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.sorted_groups(batches, ("key", "i", "j")):
            a, b = _block_pairs(group, percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    tasks = common.partitions(members.sparkSession, rows_in, ROWS_EACH)
    met = rows.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return met.mapInArrow(run, "a long, b long").distinct()


def _block_pairs(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    ids, comp, n, own = (group.column(c).to_numpy() for c in ("id", "component", "n", "own"))
    x, y = np.triu_indices(len(ids), 1)
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    good = comp[x] != comp[y]
    if i != j:
        good &= own[x] != own[y]
    low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
    good &= low * 100 >= high * percent
    x, y = x[good], y[good]
    if not len(x):
        return x, y
    sketches = group.column("sketch").to_pylist()
    size = min(map(len, sketches))
    bits = np.stack([folded(s, size) for s in sketches])
    most = (100 - percent) * (n[x] + n[y]) // (100 + percent)
    close = np.concatenate(
        [np.bitwise_count(bits[x[k : k + 4096]] ^ bits[y[k : k + 4096]]).sum(axis=1) for k in range(0, len(x), 4096)]
    )
    keep = np.flatnonzero(close <= most)
    key = group.column("key")[0].as_py()
    lanes = {int(k): group.column("lanes")[int(k)].values.to_numpy() for k in np.union1d(x[keep], y[keep])}
    keep = [k for k in keep if not len(lanes[int(x[k])]) or np.intersect1d(lanes[int(x[k])], lanes[int(y[k])], assume_unique=True)[0] == key]
    a, b = ids[x[keep]], ids[y[keep]]
    return np.minimum(a, b), np.maximum(a, b)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are the smallest id of their component; columns as they were, rows without an id left out."""
    kept = jaccard_components(docs, id_col, text_col).filter("doc_id = component_id").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, docs[id_col].cast("long") == kept["_kept"], "left_semi")
