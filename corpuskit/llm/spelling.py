"""Grouping of spelling variants: words one edit apart, by asymmetric q-chunks.

A word is cut into two disjoint chunks. One edit leaves one of them whole, so a partner has it as a gram at the same
position, or one to the right where the edit has put a character before it. Chunks and grams are joined by length,
position and text. Where very many words share a chunk, the rest of the word is cut into two chunks again, and so on: in
the end the words of a group differ in one character at one place, so no group is larger than the alphabet, and no pair
is compared that does not agree on all the rest.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm import common

# Code points and occurrences that a word needs, and how much more frequent its form must be.
LENGTH, OCCURRENCES, TIMES = 6, 5, 5
# One word in so many, by the crc32 of document and word, loses a code point.
DROPPED = 199
# Distinct words that a task counts before it sends them on; pairs of a group that are compared without another chunk.
FLUSH_WORDS, GROUP_PAIRS = 300_000, 256


def words_of(text: str, doc_id: int | None, length: int = LENGTH, dropped: int = DROPPED) -> Counter[str]:
    """Words of ``length`` code points up: runs of letters with A-Z lowered, less the code point that the crc32 names."""
    lowered = text.encode().lower().decode()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter[str] = Counter()
    for w, n in Counter(_runs(length).findall(lowered)).items():
        h = zlib.crc32(w.encode(), start)
        if h % dropped == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
            if len(w) < length:
                continue
        found[w] += n
    return found


def _runs(length: int) -> re.Pattern[str]:
    """Maximal runs with at least ``length`` characters: a shorter run has no such part."""
    return re.compile("[a-zÀ-ÿ]{%d,}" % length)


def vocabulary(
    docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, occurrences: int = OCCURRENCES, dropped: int = DROPPED
) -> DataFrame:
    """word, n: words with at least ``occurrences``; counted in the reading task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, n in words_of(text, i, length, dropped).items():
                    found[w] += n
                if len(found) > FLUSH_WORDS:
                    yield from _counted(found)
                    found = Counter()
        yield from _counted(found)

    counted = common.texts(docs, id_col, text_col).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def _counted(found: Counter[str]) -> Iterator[pa.RecordBatch]:
    items = list(found.items())
    for k in range(0, len(items), 20_000):
        part = items[k : k + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])


def near_words(words: DataFrame, steps: common.Steps, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """a, na, b, nb: pairs of ``words`` (word, n; distinct) that one inserted, deleted or replaced code point makes equal.

    Rows of a word: ``insert`` false, where partners have its length; and ``insert`` true, where they have one code point
    more (``side`` 0, the word gives chunks) or less (``side`` 1, the word gives grams). ``s`` and ``m`` are start and
    length of the part of the shorter word that no chunk has settled yet.
    """
    n = F.length("word")
    one = F.struct(F.lit(False).alias("insert"), F.lit(2).alias("side"), n.alias("m"))
    chunks = F.struct(F.lit(True).alias("insert"), F.lit(0).alias("side"), n.alias("m"))
    grams = F.struct(F.lit(True).alias("insert"), F.lit(1).alias("side"), (n - 1).alias("m"))
    rows = words.select("word", "n", F.explode(F.array(one, chunks, grams)).alias("r")).select("word", "n", "r.*")
    rows = rows.withColumns({"key": F.xxhash64("insert", "m"), "s": F.lit(0)})
    done: list[DataFrame] = []
    while True:
        rows = steps.write(_cut(rows))
        left, right = (F.count_if(F.col("side").isin(*own)) for own in ((0, 2), (1, 2)))
        groups = rows.groupBy("key").agg(left.alias("x"), right.alias("y"), F.count("*").alias("rows"), F.first("side").alias("any"))
        groups = steps.write(groups.filter((F.col("x") > 0) & (F.col("y") > 0) & ((F.col("any") < 2) | (F.col("x") > 1))))
        placed = steps.write(common.look_up(rows, groups.drop("any"), ["key"], "rows", rows.count()))
        settled = F.col("m") <= F.when(F.col("insert"), 0).otherwise(1)
        small = settled | (F.col("x") * F.col("y") <= group_pairs)
        done.append(placed.filter(small).select("key", "side", "word", "n"))
        steps.drop(rows)
        steps.drop(groups)
        rows = placed.filter(~small).select("word", "n", "insert", "side", "m", "key", "s")
        if rows.isEmpty():
            break
    members = reduce(DataFrame.unionByName, done)
    a = members.filter("side <> 1").select("key", F.col("side").alias("both"), F.col("word").alias("a"), F.col("n").alias("na"))
    b = members.filter("side <> 0").select("key", F.col("word").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, "key").filter((F.col("both") == 0) | (F.col("a") < F.col("b")))
    return pairs.filter(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb").distinct()


def _cut(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first and with the second half of its open part settled as a chunk (or as a gram).

    An inserted code point at place i of the open part leaves the first ``h`` code points where they are if i >= h, and
    moves those after ``h`` by one if i <= h. Of an open part of one, either the first or the second gram is the chunk.
    """
    h = F.floor(F.col("m") / 2).cast("int")
    first = F.when(F.col("insert") & (F.col("m") == 1), 1).otherwise(h)
    shift = F.when(F.col("side") == 1, 1).otherwise(0)

    def settled(mark: int, start: Column, size: Column, s: Column, m: Column) -> Column:
        chunk = F.substring(F.col("word"), start + 1, size)
        return F.struct(F.xxhash64("key", F.lit(mark), chunk).alias("key"), s.alias("s"), m.cast("int").alias("m"))

    s, m = F.col("s"), F.col("m")
    halves = F.array(settled(0, s, first, s + first, m - first), settled(1, s + h + shift, m - h, s, h))
    return rows.select("word", "n", "insert", "side", F.explode(halves).alias("c")).select("word", "n", "insert", "side", "c.*")


def spelling_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    occurrences: int = OCCURRENCES,
    times: int = TIMES,
    dropped: int = DROPPED,
    group_pairs: int = GROUP_PAIRS,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word with at least ``length`` code points and ``occurrences``.

    Words are maximal runs of A-Z, a-z and \\u00C0-\\u00FF with A-Z lowered; one in ``dropped`` pairs of document and word
    loses the code point that a checksum names. A word's form is its near word of largest n (the first in code-point order
    of equals) if that has ``times`` its n, else null; its root is the end of its forms. Null texts have no words, a null
    id counts as empty in the checksum, and every row counts, also rows that repeat an id.
    """
    steps = common.Steps(docs.sparkSession)
    words = steps.write(vocabulary(docs, id_col, text_col, length, occurrences, dropped))
    pairs = steps.write(near_words(words, steps, group_pairs))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m"))
    both = both.union(pairs.select("b", "a", "na"))
    best = F.min(F.struct((-F.col("m")).alias("m"), "other"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = F.col("n") * times <= -F.col("best.m")
    found = steps.write(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(formed, F.col("best.other")).alias("form"),
            F.when(formed, -F.col("best.m")).alias("form_n"),
        )
    )
    ends = _roots(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), steps)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame, steps: common.Steps) -> DataFrame:
    """Last form of each word: every round doubles the forms followed. A form is ``times`` as frequent, so there is an end."""
    while True:
        onward = forms.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        moved = forms.join(onward, F.col("root") == F.col("_at"), "left")
        forms = steps.write(moved.select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")))
        if forms.filter("moved").isEmpty():
            return forms.drop("moved")
