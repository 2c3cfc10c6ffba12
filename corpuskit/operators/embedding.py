"""Hashed text embeddings and SimHash fingerprints, computed per Arrow batch inside the tasks."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.pieces import in_pieces

DIM = 384
GRAM = 3

# Per worker: buckets of words per dimension in two generations, buckets of Latin-1 grams, hash of a token. A generation
# or the hashes that grow past the limit make room for new ones.
_CACHE_LIMIT = 200_000
_buckets: dict[int, _Buckets] = {}
_gram_tables: dict[int, np.ndarray] = {}
_token_hashes: dict[str, int] = {}
# Characters that texts in a row must share at their begin to be counted as one text there.
_SHARED = 100


def _bucket(text: str, dim: int) -> int:
    return int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest(), "big") % dim


class _Buckets:
    """Buckets of words, hashed when they are met; what the last generation knew is taken over."""

    def __init__(self, dim: int) -> None:
        self.dim = dim
        self.now: dict[str, int] = {}
        self.before: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.now)
        if len(self.now) + len(new) > _CACHE_LIMIT:
            self.before, self.now = self.now, {}
            new = set(words)
        old = new.intersection(self.before)
        self.now.update((w, self.before[w]) for w in old)
        self.now.update((w, _bucket(w, self.dim)) for w in new - old)
        return np.fromiter(map(self.now.__getitem__, words), np.int64, len(words))


def _gram_text(key: int) -> str:
    k = int(key)
    return chr(k & 0x1FFFFF) + chr(k >> 21 & 0x1FFFFF) + chr(k >> 42)


def _gram_buckets(first: np.ndarray, second: np.ndarray, third: np.ndarray, dim: int) -> np.ndarray:
    """Buckets of grams of three code points; those of Latin-1 are looked up in a table that is filled as they are met."""
    table = _gram_tables.get(dim)
    if table is None:  # bucket + 1; pages that no gram touches take no memory
        table = _gram_tables[dim] = np.zeros(1 << 24, np.int16 if dim < 1 << 15 else np.int32)
    small = (first | second | third) < 256
    every = bool(small.all())
    key = first | second << 8 | third << 16
    at = key if every else key[small]
    found = table[at]
    new = np.unique(at[found == 0])
    if len(new):
        table[new] = [1 + _bucket(chr(k & 255) + chr(k >> 8 & 255) + chr(k >> 16), dim) for k in new.tolist()]
        found = table[at]
    if every:
        return found.astype(np.int64) - 1
    out = np.empty(len(first), np.int64)
    out[small] = found
    out[small] -= 1
    wide = ~small
    keys = first[wide].astype(np.uint64) | second[wide].astype(np.uint64) << np.uint64(21) | third[wide].astype(np.uint64) << np.uint64(42)
    codes, distinct = pd.factorize(keys)
    out[wide] = _buckets.setdefault(dim, _Buckets(dim)).of([_gram_text(k) for k in distinct])[codes]
    return out


def head_lengths(texts: list[str], least: int = _SHARED) -> list[int]:
    """Length of the begin that a text shares with its neighbours, white space at its end included; 0 if it is short.

    Chunks of a document begin with its title and summary; what is counted there holds for all of them.
    """
    lengths, i = [0] * len(texts), 0
    while i < len(texts) - 1:
        text, other = texts[i], texts[i + 1]
        if len(text) < least or text[:least] != other[:least]:
            i += 1
            continue
        low, high = least, min(len(text), len(other))
        while low < high:
            middle = (low + high + 1) // 2
            if text.startswith(other[:middle]):
                low = middle
            else:
                high = middle - 1
        cut = 1 + max(text.rfind(" ", 0, low), text.rfind("\n", 0, low))
        if cut < least:
            i += 1
            continue
        head = text[:cut]
        while i < len(texts) and texts[i].startswith(head):
            lengths[i] = cut
            i += 1
    return lengths


def count_vectors(texts: list[str], dim: int = DIM, gram: int = GRAM) -> np.ndarray:
    """Counts per bucket of all character grams and whitespace words, one row per text."""
    heads = head_lengths(texts)
    # a text with a head is the head, counted once for its run, and the rest with the grams that begin in the head
    texts, rests = list(texts), list(texts)
    of_head, rows, head = [], [], None
    for i, cut in enumerate(heads):
        if cut:
            own = texts[i][:cut]
            if own != head:
                head = own
                of_head.append(head)
            rows.append((i, len(of_head) - 1))
            rests[i] = texts[i][cut:]
            texts[i] = texts[i][max(0, cut - gram + 1) :]
    counts = _counts(texts + of_head, rests + of_head, dim, gram)
    found = counts[: len(texts)]
    if rows:
        at, own = np.array(rows).T
        found[at] += counts[len(texts) + own]
    return found


def _counts(texts: list[str], worded: list[str], dim: int, gram: int) -> np.ndarray:
    """Counts of the grams of ``texts`` and of the words of ``worded``."""
    size = len(texts)
    known = _buckets.setdefault(dim, _Buckets(dim))
    cells = []
    if gram == 3:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
        owner = np.repeat(np.arange(size), [len(t) for t in texts])
        if len(points) >= 3:
            inside = owner[:-2] == owner[2:]
            cells.append(owner[:-2][inside] * dim + _gram_buckets(points[:-2][inside], points[1:-1][inside], points[2:][inside], dim))
    else:
        grams = [(r, t[i : i + gram]) for r, t in enumerate(texts) for i in range(len(t) - gram + 1)]
        cells.append(np.array([r for r, _ in grams], np.int64) * dim + known.of([g for _, g in grams]))
    words = [t.split() for t in worded]
    flat = [w for ws in words for w in ws]
    if flat:
        owner = np.repeat(np.arange(size), [len(ws) for ws in words])
        cells.append(owner * dim + known.of(flat))
    index = np.concatenate(cells) if cells else np.empty(0, dtype=np.int64)
    return np.bincount(index, minlength=size * dim).reshape(size, dim).astype(np.float64)


def embedding_column(text: Column, dim: int = DIM, gram: int = GRAM, normalize: bool = True) -> Column:
    """Embedding of a text column as ``array<float>``; ``normalize=False`` keeps the exact counts."""

    def embedded(texts: list[str | None]) -> pa.Array:
        counts = count_vectors([t or "" for t in texts], dim, gram)
        if normalize:
            lengths = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            counts = counts / np.where(lengths > 0, lengths, 1.0)
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.float32).ravel()))

    @F.arrow_udf("array<float>")
    def embed(column: pa.Array) -> pa.Array:
        return in_pieces(embedded, pa.list_(pa.float32()), column)

    return embed(text)


def hash_embedding(
    df: DataFrame, text: str, out: str = "embedding", dim: int = DIM, gram: int = GRAM, normalize: bool = True
) -> DataFrame:
    """Add the hashed embedding of ``text``. Store the result once; searches read it."""
    return df.withColumn(out, embedding_column(F.col(text), dim, gram, normalize))


def sparse_embedding(df: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """One row per non-zero cell of an embedding."""
    cells = df.select(key, F.posexplode(embedding).alias("bucket", "weight"))
    return cells.filter(F.col("weight") != 0)


_TOKEN = re.compile(r"\w+")


def _token_hash(token: str) -> int:
    found = _token_hashes.get(token)
    if found is None:
        if len(_token_hashes) >= _CACHE_LIMIT:
            _token_hashes.clear()
        found = int.from_bytes(hashlib.md5(token.encode("utf-8", "surrogatepass")).digest()[8:], "big")
        _token_hashes[token] = found
    return found


def _fingerprint(text: str) -> int:
    """Bit is 1 where more than half of the token hashes have a 1; 0 without tokens."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return 0
    hashes = np.fromiter((_token_hash(t) for t in tokens), np.uint64, len(tokens))
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65_536):
        part = hashes[start : start + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(tokens)).tobytes(), "big", signed=True)


def simhash_column(text: Column) -> Column:
    """64-bit SimHash of a text column, as the signed value of the bit pattern."""

    @F.arrow_udf("long")
    def fingerprint(column: pa.Array) -> pa.Array:
        return in_pieces(lambda texts: pa.array([_fingerprint(t or "") for t in texts], pa.int64()), pa.int64(), column)

    return fingerprint(F.lower(text))


def simhash64(df: DataFrame, text: str, out: str = "simhash") -> DataFrame:
    return df.withColumn(out, simhash_column(F.col(text)))
