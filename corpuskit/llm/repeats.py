"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Every string of LENGTH bytes belongs to one anchor: the smallest hash of the GRAM-byte grams in it (leftmost of equals).
Neighbouring strings of a document mostly share their anchor, so a document falls into short segments. Equal strings have
equal anchors, so only segments that meet in a common gram can share strings, and all of them meet in one bucket. There
the segments are sorted in shards, and the shards' Burrows-Wheeler transforms are merged by refining their interleave:
round t sorts all suffixes by t bytes with one stable pass over the merged transform, and the places where the order is
decided give the common prefixes. Suffixes that are decided leave the rounds. After LENGTH rounds a block of suffixes is a
repeated interval.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm import common

LENGTH, GRAM = 100, 50
SPREAD = LENGTH - GRAM  # of the gram's place in a string
# Bytes that one vectorised step hashes (its arrays stay in the processor's cache), and starts per piece of a long text.
HASH_BYTES, PIECE = 150_000, 4_000_000
# Segments that a reading task gathers before it sends them on; of one reducing task; parts per task.
FLUSH, SEGMENTS_EACH, PARTS_EACH = 1_000_000, 1_000_000, 8
# Different segments of a gram in one bundle beyond which they skip the gram's common task.
LOCAL_GROUP = 64
# Segments of a gram beyond which it is split by longer grams, and bytes of a bucket whose transforms are merged.
GROUP, BUCKET = 2_000, 150_000
# Parts of a string's rows in which its earliest is sought first.
SALTS = 64
SHARDS = 2
PLACE = np.uint64((1 << 24) - 1)


# ---- anchors ----------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place, by doubling."""
    h, size, parts = common._BYTE_CODES[data], 1, {}
    for k in range(GRAM.bit_length()):
        if GRAM >> k & 1:
            parts[size] = h
        if size * 2 <= GRAM:
            h = h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:]
            h ^= h >> np.uint64(32)
            size *= 2
    n, done, out = len(data) - GRAM + 1, 0, None
    for size in sorted(parts, reverse=True):
        part = parts[size][done : done + n]
        out = part if out is None else (out * np.uint64(0xD6E8FEB86659FD93) + part)
        done += size
    return common.mix(out)


def segments(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Segments of consecutive texts: text, anchor's gram hash, content hash, first start, further starts, anchor's place."""
    begin = int(offsets[0])
    part = data[begin : int(offsets[-1])]
    empty = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3]
    if len(part) < LENGTH:
        return empty
    v = gram_hashes(part)
    low = (v & ~PLACE) | np.arange(len(v), dtype=np.uint64)
    size = 1
    while size * 2 <= SPREAD + 1:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = SPREAD + 1 - size
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    anchor = (low & PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    starts = np.arange(len(anchor))
    ends = offsets[1:] - begin
    inside = starts + LENGTH <= ends[text]
    new = np.empty(len(anchor), bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    if not len(first):
        return empty
    # the run of a segment ends before the next one, or where its text has no further start
    until = np.minimum(np.append(first[1:], len(anchor)), ends[text[first]] - LENGTH + 1)
    more = until - 1 - first
    place = anchor[first] - first
    content = v[first] * np.uint64(0xA24BAED4963EE407) + v[first + GRAM] * np.uint64(0x9FB21C651E98DF25)
    content += v[first + more + GRAM] * np.uint64(0xC2B2AE3D27D4EB4F)
    content = common.mix(content + (more * 128 + place).astype(np.uint64))
    return [text[first], common.mix(v[anchor[first]]), content, first - (offsets[:-1] - begin)[text[first]], more, place]


def all_segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[np.ndarray]]:
    """``segments`` in steps of bounded size; a long text is cut into pieces that overlap by LENGTH - 1 bytes."""
    for first, last in common.slices(offsets, HASH_BYTES):
        begin, end = int(offsets[first]), int(offsets[last])
        if end - begin <= PIECE + LENGTH or last - first > 1:
            found = segments(data, offsets[first : last + 1])
            found[0] = found[0] + first
            yield found
            continue
        for at in range(begin, end - LENGTH + 1, PIECE):
            found = segments(data, np.array([at, min(end, at + PIECE + LENGTH - 1)]))
            found[0] = found[0] + first
            found[3] = found[3] + (at - begin)
            yield found


# ---- Burrows-Wheeler transforms ---------------------------------------------------------------------------------


def transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and transform of a shard; texts end with symbol 0, bytes are symbols 1 to 255 (UTF-8 has no 0xFF)."""
    lengths = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(lengths) - 1
    n = int(ends[-1]) + 1
    symbols = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)
    left = np.repeat(ends, lengths) - np.arange(n)  # symbols before the end
    padded = np.concatenate([symbols, np.zeros(8, np.uint8)]).astype(np.uint64)
    rank = np.zeros(n, np.uint64)
    for j in range(8):
        rank = (rank << np.uint64(8)) | np.where(left >= j, padded[j : j + n], np.uint64(0))
    order = np.argsort(rank, kind="stable")
    rank = _dense(rank, order)
    size, top = 8, int(lengths.max())
    while size < top:
        next_ = np.zeros(n, np.int64)
        inside = np.flatnonzero(left >= size)
        next_[inside] = rank[inside + size]
        pair = rank * (n + 1) + next_
        order = order[np.argsort(pair[order], kind="stable")]  # in order already by the first half
        rank = _dense(pair, order)
        size *= 2
    before = np.concatenate([symbols[-1:], symbols[:-1]])
    return order, before[order]


def _dense(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
    return rank


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes by their first ``depth`` symbols, and the block of equal prefixes of each.

    Each round reads the next symbol of the shard that the interleave names, sorts stably by symbol, and starts a new
    block where the symbol or the old block changes. Suffixes that have ended are blocks of their own.
    """
    source = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    block = np.zeros(len(source), np.int32)
    symbol = np.empty(len(source), np.uint8)
    ended = sum(int((t == 0).sum()) for t in transforms)
    start = np.empty(len(source), bool)
    for _ in range(depth):
        if len(transforms) == 2:
            second = source.view(bool)
            symbol[second] = transforms[1]
            symbol[~second] = transforms[0]
        else:
            for k, t in enumerate(transforms):
                symbol[source == k] = t
        order = np.argsort(symbol, kind="stable")
        source, block, ordered = source[order], block[order], symbol[order]
        start[0] = False
        np.not_equal(block[1:], block[:-1], out=start[1:])
        start[1:] |= ordered[1:] != ordered[:-1]
        start[1:ended] = True
        block = np.cumsum(start, dtype=np.int32)
    return source, block


def undecided(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of two and more that ``merge`` ends with: places in the joined transforms, and the block of each.

    A prefix that one suffix has alone is decided, and so is every prefix that extends it to the left: such suffixes leave
    the rounds. The others carry their place in their shard, and a round moves it to the place of the suffix that is one
    symbol longer. So a round costs what is still undecided, not the whole interleave.
    """
    symbols = np.concatenate(transforms)
    longer = np.empty(len(symbols), np.int32)
    begin = 0
    for t in transforms:
        longer[begin + np.argsort(t, kind="stable")] = np.arange(begin, begin + len(t), dtype=np.int32)
        begin += len(t)
    at, block = np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), np.int32)
    for _ in range(depth):
        symbol = symbols[at]
        order = np.argsort(symbol, kind="stable")[np.count_nonzero(symbol == 0) :]
        symbol, block = symbol[order], block[order]
        start = np.ones(len(order) + 1, bool)  # with the end as a start
        start[1:-1] = (block[1:] != block[:-1]) | (symbol[1:] != symbol[:-1])
        shared = np.flatnonzero(~(start[:-1] & start[1:]))
        at, block = longer[at[order[shared]]], np.cumsum(start[:-1], dtype=np.int32)[shared]
    return at, block


def repeated_starts(texts: list[bytes], key: np.ndarray) -> np.ndarray:
    """(text, place) of the strings of LENGTH bytes that occur at a smaller key; key[text] + place orders them."""
    shards = [np.arange(k, len(texts), SHARDS) for k in range(min(SHARDS, len(texts)))]
    orders, transforms = zip(*(transform([texts[i] for i in s]) for s in shards), strict=True)
    at, block = undecided(list(transforms), LENGTH)
    if not len(at):
        return np.empty((0, 2), np.int64)
    lengths = np.array([len(t) + 1 for s in shards for t in (texts[i] for i in s)])
    ends = np.cumsum(lengths)
    begins = np.repeat(np.cumsum([0, *map(len, orders)])[:-1], [len(o) for o in orders])
    where = begins[at] + np.concatenate(orders)[at]  # in the joined texts
    own = np.searchsorted(ends, where, side="right")
    text, place = np.concatenate(shards)[own], where - (ends - lengths)[own]
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    size = np.diff(np.append(first, len(block)))
    when = key[text] + place
    earliest = np.repeat(np.minimum.reduceat(when, first), size)
    again = np.flatnonzero(when > earliest)
    return np.stack([text[again], place[again]], axis=1)


# ---- Spark jobs -------------------------------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay).

    A byte goes when a string of LENGTH bytes over it also starts earlier: in a document of smaller id, or earlier in the
    same document. Overlaps count; strings are judged on the input; none crosses documents. A null text is empty. Rows
    without an id are left out, of rows that repeat an id the one with the smallest text counts.
    """
    spark = docs.sparkSession
    steps = common.Steps(spark)
    docs = common.one_row_per_id(common.texts(docs, id_col, text_col))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    tasks = common.partitions(spark, size // 25, SEGMENTS_EACH)
    met = steps.write(_meet(docs, tasks))
    covered = met.filter("kind = 0").select("doc_id", "start", F.col("more").alias("end"))
    found = steps.write(_segment_bytes(docs, met.filter("kind = 1").drop("kind")))
    rows, again = _split_large(found, steps)
    covered = covered.union(steps.write(_buckets(rows, tasks)))
    if again is not None:
        covered = covered.union(again)
    spans = covered.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return _result(docs.join(spans, "doc_id", "left"), with_text)


_SENT = "part int, kind int, base long, wide boolean, gram binary, content binary, ids binary, start binary, more binary, place binary"
_MET = "kind int, doc_id long, start long, more long, place int, gram long"


def _meet(docs: DataFrame, tasks: int) -> DataFrame:
    """Segments by common grams. kind 0: (doc_id, start, end) is covered; kind 1: a segment to be compared.

    Segments travel packed by part of the gram's hash. Of equal segments in one bundle only the first is sent, the others
    are covered at once. A gram with many different segments in a bundle sends one of them, marked, and the others go
    on to the comparison directly; so no task meets more than a few segments per bundle of any gram.
    """
    parts = tasks * PARTS_EACH

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        count = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for found in all_segments(*common.utf8(batch.column(1))):
                found[0] = ids[found[0]]
                waiting.append(found)
                count += len(found[0])
                if count >= FLUSH:
                    yield from _bundle(waiting, parts)
                    waiting, count = [], 0
        if count:
            yield from _bundle(waiting, parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[np.ndarray]] = []
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8" if row["wide"] else "<u4").astype(np.int64) + row["base"]
                start, more = np.frombuffer(row["start"], "<u4").astype(np.int64), row["more"]
                if row["kind"] == 0:
                    yield _met_rows(0, ids, start, np.frombuffer(more, "<u4").astype(np.int64))
                    continue
                gram = np.frombuffer(row["gram"], "<u4").astype(np.uint64)
                if row["kind"] == 1:  # with the part of each in the upper half
                    gram |= np.frombuffer(row["content"], "<u4").astype(np.uint64) << np.uint64(32)
                    yield _met_rows(1, ids, start, np.frombuffer(more, np.uint8).astype(np.int64), np.frombuffer(row["place"], np.uint8), gram)
                    continue
                gram |= np.uint64(row["part"]) << np.uint64(32)
                rows.append([gram, np.frombuffer(row["content"], "<u8"), ids, start, np.frombuffer(more, np.uint8), np.frombuffer(row["place"], np.uint8)])
        if rows:
            yield from _compare(*(np.concatenate(c) for c in zip(*rows, strict=True)))

    return docs.mapInArrow(publish, _SENT).repartition(tasks, "part").mapInArrow(meet, _MET)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """True where any of the sorted keys changes."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _bundle(waiting: list[list[np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    ids, gram, content, start, more, place = (np.concatenate(c) for c in zip(*waiting, strict=True))
    part = ((gram >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    gram = gram & np.uint64(0xFFFFFFFF)
    order = np.lexsort((start, ids, content, gram, part))
    ids, gram, content, start, more, place, part = (a[order] for a in (ids, gram, content, start, more, place, part))
    head = _firsts(part, gram)
    first = head | _firsts(content)
    group = np.cumsum(head) - 1
    different = np.bincount(group[first], minlength=group[-1] + 1)
    large = different[group] > LOCAL_GROUP
    sent = first & (~large | head)
    direct = first & large & ~head
    rows = []
    c_ids, c_start, c_end = _merged(ids[~first], start[~first], start[~first] + more[~first] + LENGTH)
    for k in range(0, len(c_ids), 20_000):
        s = slice(k, k + 20_000)
        rows.append(_row(0, int(c_ids[s][0]) % parts, c_ids[s], start=c_start[s].astype("<u4"), more=c_end[s].astype("<u4")))
    at = np.flatnonzero(direct)
    for k in range(0, len(at), 20_000):
        s = at[k : k + 20_000]
        rows.append(_row(1, int(ids[s[0]]) % parts, ids[s], gram[s].astype("<u4"), part[s].astype("<u4"), start[s].astype("<u4"), more[s].astype(np.uint8), place[s].astype(np.uint8)))
    at = np.flatnonzero(sent)
    cuts = np.flatnonzero(_firsts(part[at]))
    marked = more + 128 * large
    for a, b in zip(cuts, np.append(cuts[1:], len(at)), strict=True):
        s = at[a:b]
        rows.append(_row(2, int(part[s[0]]), ids[s], gram[s].astype("<u4"), content[s].astype("<u8"), start[s].astype("<u4"), marked[s].astype(np.uint8), place[s].astype(np.uint8)))
    names = ["part", "kind", "base", "wide", "gram", "content", "ids", "start", "more", "place"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 6]
    schema = pa.schema(list(zip(names, types, strict=True)))
    for k in range(0, len(rows), 128):
        yield pa.RecordBatch.from_pylist(rows[k : k + 128], schema)


_NONE = np.empty(0, np.uint8)


def _row(kind: int, part: int, ids: np.ndarray, gram=_NONE, content=_NONE, start=_NONE, more=_NONE, place=_NONE) -> dict:
    base = int(ids.min())
    wide = int(ids.max()) - base >= 1 << 32
    packed = {"gram": gram, "content": content, "start": start, "more": more, "place": place, "ids": (ids - base).astype("<i8" if wide else "<u4")}
    return {"part": part, "kind": kind, "base": base, "wide": wide} | {k: a.tobytes() for k, a in packed.items()}


def _merged(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans per document without overlaps or touching neighbours, in order."""
    if not len(ids):
        return ids, start, end
    order = np.lexsort((start, ids))
    ids, start, end = ids[order], start[order], end[order]
    doc = np.cumsum(_firsts(ids)) - 1
    reach = np.maximum.accumulate(end + doc * (1 << 40)) - doc * (1 << 40)
    new = _firsts(ids)
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return ids[at], start[at], np.maximum.reduceat(end, at)


def _met_rows(kind: int, ids, start, more, place=None, gram=None) -> pa.RecordBatch:
    n = len(ids)
    place = np.zeros(n, np.int32) if place is None else place.astype(np.int32)
    gram = np.zeros(n, np.int64) if gram is None else gram.view(np.int64)
    columns = [np.full(n, kind, np.int32), ids, start, more, place, gram]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "doc_id", "start", "more", "place", "gram"])


def _compare(gram, content, ids, start, more, place) -> Iterator[pa.RecordBatch]:
    """Of equal segments all but the first are covered; a gram's different segments are to be compared."""
    order = np.lexsort((start, ids, content, gram))
    gram, content, ids, start, more, place = (a[order] for a in (gram, content, ids, start, more, place))
    head = _firsts(gram)
    first = head | _firsts(content)
    group = np.cumsum(head) - 1
    different = np.bincount(group[first], minlength=group[-1] + 1)
    marked = np.bincount(group, more >= 128, minlength=group[-1] + 1) > 0
    wanted = first & ((different > 1) | marked)[group]
    more = (more & 127).astype(np.int64)
    c = _merged(ids[~first], start[~first], start[~first] + more[~first] + LENGTH)
    for k in range(0, len(c[0]), 50_000):
        yield _met_rows(0, *(a[k : k + 50_000] for a in c))
    at = np.flatnonzero(wanted)
    for k in range(0, len(at), 50_000):
        s = at[k : k + 50_000]
        yield _met_rows(1, ids[s], start[s], more[s], place[s], gram[s])


_SEGMENTS = "gram long, doc_id long, start long, place int, bytes binary"


def _segment_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the segments to be compared."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "start", "more", "place")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = batch.column(1)[k].as_py().encode()
                found = batch.column(2).slice(k, 1).flatten()
                gram, start, more, place = found.flatten()
                own = [data[s : s + m + LENGTH] for s, m in zip(start.to_pylist(), more.to_pylist(), strict=True)]
                ids = pa.array(np.full(len(own), batch.column(0)[k].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([gram, ids, start, place, pa.array(own, pa.binary())], ["gram", "doc_id", "start", "place", "bytes"])

    return docs.join(lists, "doc_id").select("doc_id", "text", "found").mapInArrow(run, _SEGMENTS)


def _split_large(found: DataFrame, steps: common.Steps) -> tuple[DataFrame, DataFrame | None]:
    """Segments with a bucket key that at most GROUP segments share, and (doc_id, start, end) that are covered already.

    Strings whose anchor lies in one half of the possible places have a longer gram in common. A key that too many
    segments share is replaced by such longer grams, halving the places until the gram is the string itself; then equal
    strings are reduced to the earliest, and the others are covered.
    """
    done, again, now, level = [], None, found.withColumn("key", F.col("gram")), 0
    while True:
        large = now.groupBy("key").count().filter(F.col("count") > GROUP).select("key")
        if large.isEmpty():
            done.append(now)
            break
        large = steps.write(large)
        if level == SPREAD.bit_length():  # a class is one place now; the keys are at most one in GROUP of the rows
            done.append(now.join(F.broadcast(large), "key", "left_anti"))
            firsts, again = _one_per_string(now.join(F.broadcast(large), "key", "left_semi"), steps)
            done.append(firsts)
            break
        done.append(now.join(large, "key", "left_anti"))
        level += 1
        now = steps.write(_longer(now.join(large, "key", "left_semi"), level))
    out = done[0].select("key", "doc_id", "start", "bytes")
    for df in done[1:]:
        out = out.union(df.select("key", "doc_id", "start", "bytes"))
    return out, again


def _one_per_string(rows: DataFrame, steps: common.Steps) -> tuple[DataFrame, DataFrame]:
    """The earliest row of each string, and (doc_id, start, end) of the others.

    A string that a third of all rows hold arrives as at most SALTS rows, and its rows look the earliest up by broadcast.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    parts = rows.groupBy("key", "bytes", salt.alias("_salt")).agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n"))
    strings = steps.write(parts.groupBy("key", "bytes").agg(F.min("first").alias("first"), F.sum("n").alias("n")))
    total = strings.agg(F.sum("n")).first()[0] or 0
    found = common.look_up(rows.select("key", "bytes", "doc_id", "start"), strings, ["key", "bytes"], "n", total)
    others = found.filter(F.struct("doc_id", "start") != F.col("first"))
    again = steps.write(others.select("doc_id", "start", (F.col("start") + LENGTH).alias("end")))
    return strings.select("key", "first.doc_id", "first.start", "bytes"), again


def _longer(rows: DataFrame, level: int) -> DataFrame:
    """Cut segments by the place of their anchor into 2**level classes, keyed by the bytes common to a class."""
    edges = [(SPREAD + 1) * k // (1 << level) for k in range((1 << level) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("gram", "doc_id", "start", "place", "bytes", "key")}
            for r in batch.to_pylist():
                data, place = r["bytes"], r["place"]  # starts have the anchor at place, place - 1, ...
                low = place - (len(data) - LENGTH)
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    top, bottom = min(place, b - 1), max(low, a)
                    if top < bottom:
                        continue
                    # strings of the class hold the bytes from (anchor - a) to (anchor - (b - 1) + LENGTH)
                    common_ = data[place - a : place - (b - 1) + LENGTH]
                    digest = hashlib.blake2b(common_ + a.to_bytes(2, "little") + level.to_bytes(1, "little"), digest_size=8).digest()
                    cut = place - top
                    own = {"gram": r["gram"], "doc_id": r["doc_id"], "start": r["start"] + cut, "place": top}
                    own |= {"bytes": data[cut : place - bottom + LENGTH], "key": int.from_bytes(digest, "little", signed=True)}
                    for k, x in own.items():
                        out[k].append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    return rows.select("gram", "doc_id", "start", "place", "bytes").mapInArrow(run, _SEGMENTS + ", key long")


def _buckets(rows: DataFrame, tasks: int) -> DataFrame:
    """(doc_id, start, end) that the merged transforms find repeated. A bucket holds whole keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), batch.num_rows]
            lengths = np.concatenate([[0], np.cumsum(pa.compute.binary_length(batch.column("bytes")).to_numpy())])
            begin = 0
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                ended = a > 0 or (waiting and waiting[-1].column("key")[-1].as_py() != key[0])
                if ended and size + lengths[a] - lengths[begin] >= BUCKET:
                    yield from _bucket([*waiting, batch.slice(begin, a - begin)])
                    waiting, size, begin = [], 0, a
            if batch.num_rows > begin:
                waiting.append(batch.slice(begin))
                size += int(lengths[-1] - lengths[begin])
        if waiting:
            yield from _bucket(waiting)

    placed = rows.repartition(tasks, "key").sortWithinPartitions("key")
    return placed.mapInArrow(run, "doc_id long, start long, end long")


def _bucket(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches([b for b in batches if b.num_rows])
    if not table.num_rows:
        return
    ids, start = table.column("doc_id").to_numpy(), table.column("start").to_numpy()
    order = np.lexsort((start, ids))
    ids, start = ids[order], start[order]
    texts = table.column("bytes").take(pa.array(order)).to_pylist()
    doc = np.cumsum(_firsts(ids)) - 1
    again = repeated_starts(texts, (doc << 40) + start)
    if len(again):
        at = start[again[:, 0]] + again[:, 1]
        merged = _merged(ids[again[:, 0]], at, at + LENGTH)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged], ["doc_id", "start", "end"])


def _result(rows: DataFrame, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data, at, kept, n = text.as_py().encode(), 0, [], 0
                found = spans.as_py() or []
                if found:
                    s, e = (np.array([x[c] for x in found], np.int64) for c in ("start", "end"))
                    _, s, e = _merged(np.zeros(len(s), np.int64), s, e)
                    for a, b in zip(s.tolist(), e.tolist(), strict=True):
                        kept.append(data[at:a])
                        at = b
                    n = len(s)
                kept.append(data[at:])
                left = b"".join(kept)
                for k, x in zip(out, (len(data), len(data) - len(left), n, hashlib.sha256(left).hexdigest(), left), strict=True):
                    out[k].append(x)
            if not with_text:
                del out["kept"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [pa.array(v, t) for v, t in zip(out.values(), types, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *out])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return rows.select("doc_id", "text", "spans").mapInArrow(run, schema)
