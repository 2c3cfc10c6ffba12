"""Long lists of words or phrases against texts: which of them occur, as plain substrings.

``functions.text.contains_any`` suits a few fixed words. Here the list is a table. It is cut into blocks of bounded size, each
block becomes one automaton per Python worker, and a text is read once per block whatever the number of patterns. Texts are
not shuffled. Null and empty patterns are left out; a null text contains nothing. Case counts: lower both sides to ignore it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit import runtime

# Characters of the patterns of a block; an automaton takes some 50 to 100 bytes for each in every Python worker.
BLOCK_CHARS = 2_000_000
# Rows of a result batch.
_ROWS = 50_000

_built: dict = {}


def find_patterns(texts: DataFrame, key: str, text: Column, patterns: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row (key, pattern) for every pattern that occurs in a text, once per row of ``texts``.

    ``patterns`` has a column ``pattern``; repeated ones count once. Rows with a null or repeated key are searched like others.
    """
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("pattern", T.StringType())])
    rows = texts.select(F.col(key), text.cast("string").alias("_text"))
    found = texts.sparkSession.createDataFrame([], schema)
    for k, words in enumerate(_blocks(patterns, block_chars)):
        hits = rows.mapInArrow(_finder(words), schema)
        found = hits if k == 0 else found.unionByName(hits)
    return found


def without_patterns(texts: DataFrame, text: Column, patterns: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``texts`` in whose text no pattern occurs; a null text stays.

    With several blocks the rows that are left are stored after each, so that a task holds one automaton at a time.
    """
    for k, words in enumerate(_blocks(patterns, block_chars)):
        rows = texts if k == 0 else runtime.materialize(texts)
        texts = rows.filter(~_contains(words)(text.cast("string")))
    return texts


def _blocks(patterns: DataFrame, block_chars: int) -> Iterator[Broadcast]:
    """The distinct patterns, dealt by hash to blocks of about ``block_chars`` characters.

    One block after the other is read by the driver and shipped. A pattern longer than that makes its block as much larger.
    """
    spark = patterns.sparkSession
    given = patterns.select(F.col("pattern").cast("string").alias("pattern")).filter("pattern <> ''")
    words = runtime.materialize(given.distinct())
    chars = words.agg(F.sum(F.length("pattern"))).first()[0] or 0
    blocks = math.ceil(chars / block_chars)
    for k in range(blocks):
        block = words.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k)
        yield spark.sparkContext.broadcast([r.pattern for r in block.collect()])


def _automaton(words: Broadcast):
    """The automaton of a block, None for an empty one; a worker keeps the last that it built."""
    if _built.get("words") is not words.value:
        automaton = ahocorasick.Automaton()
        for w in words.value:
            automaton.add_word(w, w)
        automaton.make_automaton()
        _built.update(words=words.value, automaton=automaton if words.value else None)
    return _built["automaton"]


def _contains(words: Broadcast):
    @F.pandas_udf("boolean")
    def contains(texts: pd.Series) -> pd.Series:
        automaton = _automaton(words)
        if automaton is None:
            return pd.Series(False, index=texts.index)
        return texts.map(lambda t: t is not None and next(automaton.iter(t), None) is not None).astype(bool)

    return contains


def _finder(words: Broadcast):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(words)
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text and automaton is not None:
                    hits = {w for _, w in automaton.iter(text)}
                    at += [i] * len(hits)
                    found += hits
                if len(at) > _ROWS:
                    yield _rows(batch, at, found)
                    at, found = [], []
            yield _rows(batch, at, found)

    return find


def _rows(batch: pa.RecordBatch, at: list[int], found: list[str]) -> pa.RecordBatch:
    keys = batch.column(0).take(pa.array(at, pa.int64()))
    return pa.RecordBatch.from_arrays([keys, pa.array(found, pa.string())], names=[batch.schema.names[0], "pattern"])
