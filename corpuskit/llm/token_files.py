"""Token ids as binary shard files with a minimal perfect hash index over the document keys."""

from __future__ import annotations

import json
import posixpath
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskit.llm import common
from corpuskit.llm.bpe import byte_letters

MAGIC = b"TOKSHRD1"
# Documents of a shard, on average.
SHARD_ROWS = 20_000
# Bits of a hash level per key, and levels before a build counts as failed (keys that repeat).
GAMMA, LEVELS = 2, 64
# Bytes read at once from a payload.
READ_BYTES = 8_000_000
# Marks that may end a word; texts that tell how a
# vocabulary splits.
MARKS = ".,!?;:"
PROBES = ("ab", "AB", " ab\n\tab \x0b\x0cab\r", *(f"ab{m}" for m in MARKS), *MARKS, "thereof", *map(chr, range(0xDF, 0x100)))
# Words of small letters up to U+00FF, and the letters that byte-level vocabularies write the bytes of the last ones with.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
BYTE_LETTERS = {c: "".join(byte_letters()[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}

_tokenizers: dict = {}


# ---- minimal perfect hash ---------------------------------------------------------------------------------------


def key_hash(keys: np.ndarray, salt: int) -> np.ndarray:
    return common.mix(keys.astype(np.int64).view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1)))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (key_hash(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def build(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays by level, of 64-bit words: a key's bit is in the first level where no other remaining key hits it."""
    levels, left = [], keys
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("keys repeat")
        words = -(-GAMMA * len(left) // 64)
        at = (key_hash(left, len(levels) + 1) % np.uint64(words * 64)).astype(np.int64)
        alone = np.bincount(at, minlength=words * 64) == 1
        levels.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = left[~alone[at]]
    return levels


def slots(levels: list[np.ndarray], ranks: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key, 0 to n - 1 without gaps for the keys that were built in, -1 for keys that hit no bit."""
    found = np.full(len(keys), -1, np.int64)
    open_ = np.arange(len(keys))
    for k, (bits, rank) in enumerate(zip(levels, ranks, strict=True)):
        if not len(open_):
            break
        at = (key_hash(keys[open_], k + 1) % np.uint64(len(bits) * 64)).astype(np.int64)
        word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
        found[open_[hit]] = (rank[at >> 6] + below)[hit]
        open_ = open_[~hit]
    return found


def level_ranks(levels: list[np.ndarray]) -> list[np.ndarray]:
    """Set bits before each word, over all levels."""
    out, before = [], 0
    for bits in levels:
        counts = np.bitwise_count(bits).astype(np.int64)
        out.append(before + np.cumsum(counts) - counts)
        before += int(counts.sum())
    return out


# ---- shard files ------------------------------------------------------------------------------------------------


def write_shard(path: str, attempt: str, keys: list[int], lengths: list[int], payload: Iterator[bytes], width: int) -> None:
    """Payload of raw ids, then the index arrays, then a JSON footer, its length and MAGIC.

    The file appears by a rename, so a lost or repeated task leaves no half of it. ``keys`` and ``lengths`` are filled
    while ``payload`` is read.
    """
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(posixpath.dirname(name), recursive=True)
    temporary = f"{name}.{attempt}"
    with fs.open_output_stream(temporary) as out:
        for part in payload:
            out.write(part)
        own = np.array(keys, np.int64)
        sizes = np.array(lengths, np.int64)
        levels = build(own)
        at = slots(levels, level_ranks(levels), own)
        arrays = {"fingerprint": np.empty(len(own), "<u4"), "offset": np.empty(len(own), "<u8"), "length": np.empty(len(own), "<u8")}
        arrays["fingerprint"][at] = fingerprint(own)
        arrays["offset"][at] = np.cumsum(sizes) - sizes
        arrays["length"][at] = sizes
        arrays |= {f"level{k}": bits for k, bits in enumerate(levels)}
        start, places = int(sizes.sum()) * width, {}
        for k, a in arrays.items():
            places[k] = [start, len(a), a.dtype.str]
            out.write(a.tobytes())
            start += a.nbytes
        footer = json.dumps({"width": width, "index": int(sizes.sum()) * width, "levels": len(levels), "arrays": places}).encode()
        out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
    fs.move(temporary, name)


class Shard:
    """Keyed access to one shard file: the index is read once, a lookup is a few probes and one read."""

    def __init__(self, path: str):
        fs, name = pyarrow.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no token shard")
        length = int.from_bytes(tail[:8], "little")
        footer = json.loads(self.file.read_at(length, size - 16 - length))
        self.dtype = np.dtype(f"<u{footer['width']}")
        index = self.file.read_at(size - 16 - length - footer["index"], footer["index"])
        a = {
            k: np.frombuffer(index, t, n, start - footer["index"]) for k, (start, n, t) in footer["arrays"].items()
        }
        self.levels = [a[f"level{k}"] for k in range(footer["levels"])]
        self.ranks = level_ranks(self.levels)
        self.fingerprints, self.offsets, self.lengths = a["fingerprint"], a["offset"].astype(np.int64), a["length"].astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stored, first id, number of ids) per key; foreign keys fail by their fingerprint (but for one in 2**32)."""
        at = slots(self.levels, self.ranks, keys)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == fingerprint(keys[known])
        at = np.where(known, at, 0)
        return known, self.offsets[at], self.lengths[at]

    def ids(self, first: int, count: int) -> np.ndarray:
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(count * width, first * width), self.dtype)

    def many(self, firsts: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of records in ascending order of place; neighbours share a read of up to READ_BYTES."""
        width, k = self.dtype.itemsize, 0
        while k < len(firsts):
            until = int(np.searchsorted(firsts, firsts[k] + READ_BYTES // width, "right"))
            until = max(k + 1, until - 1 if until - 1 > k else k + 1)
            data = self.ids(int(firsts[k]), int(firsts[until - 1] + counts[until - 1] - firsts[k]))
            for j in range(k, until):
                yield data[firsts[j] - firsts[k] : firsts[j] - firsts[k] + counts[j]]
            k = until

    def close(self) -> None:
        self.file.close()


# ---- Spark jobs -------------------------------------------------------------------------------------------------


class Encoder:
    """The tokenizers library, called once per distinct word where its pieces never cross white space.

    Whether they do, whether case is folded and whether a mark after a letter is a piece of its own is asked of the
    library; a vocabulary of another kind gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.words = common.WordCache(self._words)
        one = dict(zip(PROBES, self._library(list(PROBES)), strict=True))
        self.by_word = one[" ab\n\tab \x0b\x0cab\r"] == one["ab"] * 3
        self.folds = one["AB"] == one["ab"]
        self.marks = {m: one[m] for m in MARKS if one[f"ab{m}"] == one["ab"] + one[m]}
        self.code = "H" if self.width == 2 else "I"
        self.direct = self.by_word and all(self._model(w) == one[w] for w in PROBES if PLAIN.fullmatch(w))
        self.special = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _model(self, word: str) -> bytes:
        """Ids of a word of plain letters, straight from the library's model: no other step of it changes the word."""
        letters = word if word.isascii() else word.translate(BYTE_LETTERS)
        return array(self.code, [t.id for t in self.library.model.tokenize(letters)]).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of new words. A final mark after a plain letter is encoded by itself."""
        young, old = self.words.young, self.words.old
        found: dict[str, bytes] = {}
        slow: list[tuple[str, str, bytes]] = []
        for w in words:
            stem, mark = w, self.marks.get(w[-1:], b"")
            if mark and "a" <= w[-2:-1] <= "z":
                stem = w[:-1]
                ids = young.get(stem) or old.get(stem)
            else:
                ids, mark = None, b""
            if ids is None:
                if not (self.direct and PLAIN.fullmatch(stem)):
                    slow.append((w, stem, mark))
                    continue
                ids = self._model(stem)
                if mark:
                    young[stem] = ids
            found[w] = ids + mark
        stems = [*dict.fromkeys(stem for _, stem, _ in slow)]
        made = dict(zip(stems, self._library(stems), strict=True))
        found.update((w, made[stem] + mark) for w, stem, mark in slow)
        return [found[w] for w in words]

    def _split(self, text: str) -> list[str]:
        if self.folds:
            lower = text.encode().lower().decode()  # A-Z only
            if lower != text and not any(s in lower for s in self.special):
                text = lower
        for c in "\t\n\x0b\x0c\r":
            text = text.replace(c, " ")
        return text.split(" ")

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        for own in common.bundles(texts):
            if not self.by_word:
                yield from self._library(own)
                continue
            lists = [self._split(t) for t in own]
            words = self.words.table(lists).__getitem__
            for x in lists:
                yield b"".join(map(words, x))

    def encode(self, text: str) -> bytes:
        return next(self.encode_many([text]))


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every text, append ``end_id`` and write shards in ascending order of doc_id; returns the manifest.

    Manifest: shard, name, first_id, last_id, n_docs, n_tokens, start (ids in earlier shards). A null text is empty;
    rows without an id are left out; of rows that repeat an id the one with the smallest text is written; no rows, no
    shards. Shards are ranges of ids cut by Spark's range partitioning, each written by the task that encodes it.
    """
    spark = docs.sparkSession
    rows = common.one_row_per_id(common.texts(docs, id_col, text_col))
    n = common.partitions(spark, rows.count(), SHARD_ROWS)
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = encoder(tokenizer), TaskContext.get()
        end = np.array([end_id], own.dtype).tobytes()
        keys: list[int] = []
        lengths: list[int] = []

        def payload() -> Iterator[bytes]:
            for batch in batches:
                keys.extend(batch.column(0).to_pylist())
                for ids in own.encode_many(batch.column(1).to_pylist()):
                    ids += end
                    lengths.append(len(ids) // own.width)
                    yield ids

        parts = payload()
        head = next(parts, None)
        if head is None:
            return
        shard = task.partitionId()
        name = f"shard-{shard:06d}.bin"

        def all_parts() -> Iterator[bytes]:
            yield head
            yield from parts

        write_shard(f"{folder}/{name}", f"{task.taskAttemptId()}", keys, lengths, all_parts(), own.width)
        row = {"shard": shard, "name": name, "first_id": keys[0], "last_id": keys[-1], "n_docs": len(keys), "n_tokens": sum(lengths)}
        yield pa.RecordBatch.from_pylist([row])

    schema = "shard long, name string, first_id long, last_id long, n_docs long, n_tokens long"
    rows.mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    common.release_shuffles(spark)
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard, with the ids before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.parquet(f"{folder}/manifest")
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_token_files(keys: DataFrame, folder: str, key_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Look keys up in the shards: doc_id, start, n_tokens, ids_crc32 (and ids); keys that are not stored give no row.

    The manifest (one row per shard) comes to the driver; each key goes to the shard whose range holds it.
    """
    spark = keys.sparkSession
    shards = read_manifest(spark, folder).orderBy("shard").collect()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if not shards:
        return spark.createDataFrame([], schema)
    lasts = np.array([s["last_id"] for s in shards], np.int64)
    names, starts = [s["name"] for s in shards], [s["start"] for s in shards]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(lasts, own)
            inside = at < len(lasts)
            yield pa.RecordBatch.from_arrays([pa.array(own[inside]), pa.array(at[inside])], ["doc_id", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple[int, Shard] | None = None
        for batch in batches:
            own, places = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for s in np.unique(places):
                if open_ is None or open_[0] != s:
                    if open_ is not None:
                        open_[1].close()
                    open_ = (s, Shard(f"{folder}/{names[s]}"))
                mine = own[places == s]
                known, firsts, counts = open_[1].find(mine)
                order = np.flatnonzero(known)[np.argsort(firsts[known], kind="stable")]
                crcs, ids = [], []
                for found in open_[1].many(firsts[order], counts[order]):
                    crcs.append(zlib.crc32(found.astype("<u4").tobytes()))
                    if with_ids:
                        ids.append(found.astype(np.int64))
                columns = [mine[order], starts[s] + firsts[order], counts[order], np.array(crcs, np.int64)]
                names_ = ["doc_id", "start", "n_tokens", "ids_crc32"]
                arrays = [pa.array(c, pa.int64()) for c in columns]
                if with_ids:
                    arrays, names_ = [*arrays, pa.array(ids, pa.list_(pa.int64()))], [*names_, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names_)
        if open_ is not None:
            open_[1].close()

    wanted = keys.select(F.col(key_col).cast("long").alias("doc_id")).filter("doc_id is not null")
    routed = wanted.mapInArrow(route, "doc_id long, shard long")
    routed = routed.repartitionByRange(len(shards), "shard").sortWithinPartitions("shard")
    return routed.mapInArrow(run, schema)
