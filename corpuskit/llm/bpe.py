"""Byte-level BPE: merges by a priority queue over linked symbols, decoding from the vocabulary."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm import common

# How the public byte-level vocabularies split a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A blank that stands alone between two visible characters always starts a piece.
LONE_BLANK = regex.compile(r"(?<=\S) (?=\S)")
OTHER_BLANK = regex.compile(r"^ | $|\s | \s")
_loaded: dict[str, Codec] = {}


class Codec:
    """A byte-level BPE vocabulary (the JSON of the tokenizers library)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        bytes_of = {w: bytes(back[c] for c in w) for w in model["vocab"]}
        self.byte_ids = [model["vocab"][letters[b]] for b in range(256)]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*model["vocab"].values(), *special.values()]) + 1
        self.vocabulary = [b""] * size
        for w, i in model["vocab"].items():
            self.vocabulary[i] = bytes_of[w]
        for w, i in special.items():
            self.vocabulary[i] = w.encode()
        # pair of ids -> (rank, id of the merged symbol)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.setdefault((model["vocab"][a], model["vocab"][b]), (rank, model["vocab"][a + b]))
        self.special = special
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
        self.pieces = regex.compile(PIECES)
        self.words = common.WordCache(lambda words: [self._word(" " + w) for w in words])
        self.firsts = common.WordCache(lambda words: [self._word(w) for w in words])

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges, lowest rank first and leftmost among equals.

        The symbols are a doubly linked list over their first places. The queue holds (rank, place, left, right);
        an entry whose symbols have changed since it was pushed is skipped.
        """
        n, merges = len(ids), self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((merged, ids[k])):
                    heapq.heappush(queue, (m[0], i, merged, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], merged))):
                heapq.heappush(queue, (m[0], h, ids[h], merged, m[1]))
        return [x for x in ids if x >= 0]

    def _word(self, text: str) -> bytes:
        """Little-endian ids of the pieces of a text that no special token is in."""
        out: list[int] = []
        for piece in self.pieces.findall(text):
            out += self.merge([self.byte_ids[b] for b in piece.encode()])
        return b"".join(i.to_bytes(4, "little") for i in out)

    def _parts(self, text: str) -> list[bytes | list[str]]:
        """A text as ids of special tokens and lists of words; the first word of a list has no blank before it."""
        out: list[bytes | list[str]] = []
        for part in self.split.split(text) if self.special else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out.append(LONE_BLANK.split(part) if OTHER_BLANK.search(part) else part.split(" "))
        return out

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for own in common.bundles(texts):
            parts = [self._parts(t) for t in own]
            lists = [x for p in parts for x in p if isinstance(x, list)]
            heads = self.firsts.table([x[:1] for x in lists])
            words = self.words.table([x[1:] for x in lists]).__getitem__
            for p in parts:
                yield b"".join(x if isinstance(x, bytes) else heads[x[0]] + b"".join(map(words, x[1:])) for x in p)

    def encode(self, text: str) -> bytes:
        return next(self.encode_many([text]))

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings joined; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.vocabulary.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


def codec(path: str) -> Codec:
    """One codec per worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array of int) of every text; a null text is empty and gives no ids, a null id stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [memoryview(x).cast("I").tolist() for x in own.encode_many(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return common.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id``, ``text`` of id lists; a null list is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            out = [own.decode(b"".join(i.to_bytes(4, "little") for i in ids or [])) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    rows = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Hashes are of the ids as little-endian unsigned 32-bit integers and of the decoded text in UTF-8. A null text is
    empty. Texts are taken in bundles of bounded size, so memory is bounded by them, the longest text and the word cache.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            sizes, ids_hash, text_hash = [], [], []
            for ids in own.encode_many(batch.column(1).to_pylist()):
                sizes.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (sizes, ids_hash, text_hash))], schema=schema)

    return common.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
