"""Phrase collocations by set-oriented mining over sorted occurrence relations.

The relation of length k holds, in text order, which frequent phrase of k words starts at each word. It is merge-joined
with itself at adjacent places of a piece, which gives all phrases of k + 1 words whose parts are frequent; these are
counted in groups over the whole corpus, and the occurrences are semi-joined with the frequent groups before the next
length. Relations are stored between the lengths, packed in bundles of consecutive documents of one language.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskit.llm import common

# Longest phrase, least occurrences, share of a phrase's occurrences (percent) that a longer one may have, ranks.
LONGEST, LEAST, COVERED, RANKS = 4, 30, 80, 2_000
SCALE = 2_000_000
NO_LANGUAGE = "und"
# Words of a bundle, counted groups of a reducing task, and parts of the groups per task.
BUNDLE_WORDS, GROUPS_EACH, PARTS_EACH = 1_000_000, 500_000, 2
U64 = np.uint64

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True
CUTS = np.zeros(256, bool)
CUTS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BETWEEN = BLANK | CUTS
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = common.mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))[_LOWER]

NAME = "array<struct<key: long, f: long, a: long, b: long, text: string>>"
RELATION = f"bundle long, lang string, words long, codes binary, starts binary, keys binary, texts array<string>, names {NAME}"
SENT = "part int, bundle long, keys binary, counts binary"
ANSWER = "bundle long, keys binary, chosen binary, totals binary"


# ---- words --------------------------------------------------------------------------------------------------------


def words_of(part: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, hash, piece start) of the words of consecutive documents; ``bounds`` are the documents' first bytes.

    A word starts a piece if a cut byte or the start of a document lies between it and the word before.
    """
    word = ~_BETWEEN[part]
    at = np.flatnonzero(word)
    if not len(at):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, U64), np.empty(0, bool))
    first = np.empty(len(part), bool)
    first[0] = True
    np.logical_not(word[:-1], out=first[1:])
    inner = bounds[bounds < len(part)]
    first[inner] = True
    first &= word
    starts = np.flatnonzero(first)
    rank = np.searchsorted(at, starts)
    lengths = np.diff(np.append(rank, len(at)))
    place = np.arange(len(at)) - np.repeat(rank, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), 0x9FB21C651E98DF25, U64))
    h = np.add.reduceat(_CODES[part[at]] * powers[place], rank) + lengths.astype(U64)
    cuts = CUTS[part]
    cuts[inner] = True
    # a document's own first byte may be a word: its cut counts for that word
    pieces = np.cumsum(cuts)[starts]
    new = np.empty(len(starts), bool)
    new[0] = True
    np.not_equal(pieces[1:], pieces[:-1], out=new[1:])
    return starts, lengths, h, new


class Bundle:
    """Words of one language until they are sent on: hashes, piece starts, and the text of each hash."""

    def __init__(self, lang: str):
        self.lang, self.size = lang, 0
        digest = lang.encode()
        self.salt = common.mix(np.array([zlib.crc32(digest) | zlib.crc32(digest, 1) << 32], U64))[0]
        self.hashes: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.texts: dict[int, str] = {}

    def add(self, data: bytes, start: np.ndarray, length: np.ndarray, h: np.ndarray, new: np.ndarray) -> None:
        h = common.mix(h + self.salt)
        self.hashes.append(h)
        self.starts.append(new)
        self.size += len(h)
        seen, where = np.unique(h, return_index=True)
        for key, a, n in zip(seen.tolist(), start[where].tolist(), length[where].tolist(), strict=True):
            if key not in self.texts:
                self.texts[key] = data[a : a + n].lower().decode()

    def row(self, number: int) -> dict:
        keys, codes = np.unique(np.concatenate(self.hashes), return_inverse=True)
        return {
            "bundle": number,
            "lang": self.lang,
            "words": self.size,
            "codes": packed(codes.astype("<i4")),
            "starts": packed(np.packbits(np.concatenate(self.starts))),
            "keys": keys.astype("<u8").tobytes(),
            "texts": [self.texts[k] for k in keys.tolist()],
        }


def packed(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, size: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _relation(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """All words, in bundles of one language: row of ``codes`` into the sorted ``keys`` of its distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: dict[str, Bundle] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = common.utf8(batch.column(1))
            for first, last in common.slices(offsets):
                begin, end = int(offsets[first]), int(offsets[last])
                part = data[begin:end]
                raw = part.tobytes()
                start, length, h, new = words_of(part, offsets[first:last] - begin)
                doc = np.searchsorted(offsets[first : last + 1] - begin, start, "right") - 1
                own = np.array(langs[first:last], object)
                for lang in dict.fromkeys(langs[first:last]):
                    mine = (own == lang)[doc]
                    if mine.any():
                        waiting.setdefault(lang, Bundle(lang)).add(raw, start[mine], length[mine], h[mine], new[mine])
                if sum(b.size for b in waiting.values()) >= BUNDLE_WORDS:
                    for b in waiting.values():
                        yield _rows([b.row(number)], RELATION_TYPES)
                        number += 1
                    waiting = {}
        for b in waiting.values():
            yield _rows([b.row(number)], RELATION_TYPES)
            number += 1

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE))
    return docs.select(lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, RELATION)


_NAME_TYPE = pa.struct([("key", pa.int64()), ("f", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("text", pa.string())])
RELATION_TYPES = pa.schema(
    [("bundle", pa.int64()), ("lang", pa.string()), ("words", pa.int64())]
    + [(c, pa.binary()) for c in ("codes", "starts", "keys")]
    + [("texts", pa.list_(pa.string())), ("names", pa.list_(_NAME_TYPE))]
)
SENT_TYPES = pa.schema([("part", pa.int32()), ("bundle", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER_TYPES = pa.schema([("bundle", pa.int64()), ("keys", pa.binary()), ("chosen", pa.binary()), ("totals", pa.binary())])


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


# ---- one length ---------------------------------------------------------------------------------------------------


def joined(codes: np.ndarray, starts: np.ndarray | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge-join of adjacent places: (places, pair numbers) where a phrase and the one a word later are both frequent.

    ``starts`` marks the words that start a piece; it is needed for single words only, as longer phrases overlap.
    """
    both = (codes[:-1] >= 0) & (codes[1:] >= 0)
    if starts is not None:
        both &= ~starts[1:]
    at = np.flatnonzero(both)
    return at, codes[at].astype(np.int64) * size + codes[at + 1]


def phrase_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of the phrase whose words but the last are phrase a and whose words but the first are phrase b."""
    return common.mix(a * U64(0x9E3779B97F4A7C15) + b * U64(0xC2B2AE3D27D4EB4F) + U64(0x165667B19E3779F9))


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    codes = unpacked(row["codes"], row["words"], "<i4")
    starts = None
    if row["starts"] is not None:
        starts = np.unpackbits(unpacked(row["starts"], -(-row["words"] // 8), "u1"), count=row["words"]).astype(bool)
    return codes, starts, np.frombuffer(row["keys"], "<u8")


def _groups(row: dict, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, counts and pair numbers of a bundle's groups; at the first length groups are words."""
    codes, starts, keys = _opened(row)
    if first:
        return keys, np.bincount(codes, minlength=len(keys)), np.arange(len(keys))
    pair = np.sort(joined(codes, starts, len(keys))[1])
    at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.empty(0, np.int64)
    counts, pair = np.diff(np.append(at, len(pair))), pair[at]
    own = phrase_keys(keys[pair // len(keys)], keys[pair % len(keys)]) if len(pair) else np.empty(0, U64)
    order = np.argsort(own)
    return own[order], counts[order], pair[order]


def _frequent(relation: DataFrame, first: bool, least: int, tasks: int) -> DataFrame:
    """Answers: which groups of each bundle are frequent, and for one bundle of each group that it names the group.

    Groups travel packed by ranges of their keys, once per bundle.
    """
    parts = tasks * PARTS_EACH

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts, _ = _groups(row, first)
                part = ((keys >> U64(32)) * U64(parts)) >> U64(32)
                edges = np.searchsorted(part, np.arange(parts + 1, dtype=U64))
                found = [
                    {"part": p, "bundle": row["bundle"], "keys": keys[a:b].astype("<u8").tobytes(), "counts": counts[a:b].astype("<u4").tobytes()}
                    for p, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                    if b > a
                ]
                for k in range(0, len(found), 256):
                    yield _rows(found[k : k + 256], SENT_TYPES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part and rows:
                    yield from _answers(rows, least)
                    rows = []
                part = row["part"]
                rows.append((row["bundle"], row["keys"], row["counts"]))
        if rows:
            yield from _answers(rows, least)

    sent = relation.select("bundle", "words", "codes", "starts", "keys").mapInArrow(send, SENT)
    return sent.repartition(tasks, "part").sortWithinPartitions("part", "bundle").mapInArrow(count, ANSWER)


def _answers(rows: list[tuple[int, bytes, bytes]], least: int) -> Iterator[pa.RecordBatch]:
    """rows: (bundle, keys, counts) of one part by bundle, so that every run of a task names the same bundles."""
    each = [np.frombuffer(k, "<u8") for _, k, _ in rows]
    key = np.concatenate(each)
    counts = np.concatenate([np.frombuffer(c, "<u4") for _, _, c in rows]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    total = np.add.reduceat(counts[order], first)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    of = np.empty(len(key), np.int64)
    of[order] = group
    names = np.zeros(len(key), bool)
    names[order[first]] = True
    keep = total[of] >= least
    edges = np.cumsum([0, *map(len, each)])
    out = []
    for (bundle, _, _), a, b in zip(rows, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        mine = np.flatnonzero(keep[a:b]) + a
        if len(mine):
            chosen = names[mine]
            out.append(
                {
                    "bundle": bundle,
                    "keys": key[mine].astype("<u8").tobytes(),
                    "chosen": chosen.tobytes(),
                    "totals": total[of[mine[chosen]]].astype("<i8").tobytes(),
                }
            )
    for k in range(0, len(out), 256):
        yield _rows(out[k : k + 256], ANSWER_TYPES)


def _extended(relation: DataFrame, answers: DataFrame, first: bool, last: bool) -> DataFrame:
    """Relation of the next length, of the frequent groups alone, with the names that its bundles give."""
    kept = relation.select("bundle", F.lit(0).alias("kind"), "lang", "words", "codes", "starts", "keys", "texts", *_none("chosen", "totals"))
    given = answers.select(
        "bundle", F.lit(1).alias("kind"), F.lit("").alias("lang"), F.lit(0).cast("long").alias("words"), *_none("codes", "starts"),
        "keys", F.lit(None).cast("array<string>").alias("texts"), "chosen", "totals",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, found = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1).to_pylist()[0]
                if one["kind"]:
                    found.append(one)
                    continue
                if row is not None:
                    yield from _next(row, found, first, last)
                row, found = one, []
        if row is not None:
            yield from _next(row, found, first, last)

    both = kept.unionByName(given).repartition("bundle").sortWithinPartitions("bundle", "kind")
    return both.mapInArrow(run, RELATION)


def _none(*names: str) -> list[Column]:
    return [F.lit(None).cast("binary").alias(n) for n in names]


def _next(row: dict, answers: list[dict], first: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """A bundle after its answers. Places whose phrase is not frequent get code -1."""
    if not answers:
        return
    codes, starts, keys = _opened(row)
    own, _, pair = _groups(row, first)
    key = np.concatenate([np.frombuffer(a["keys"], "<u8") for a in answers])
    chosen = np.concatenate([np.frombuffer(a["chosen"], bool) for a in answers])
    totals = np.concatenate([np.frombuffer(a["totals"], "<i8") for a in answers])
    where = np.searchsorted(own, key)
    named, f = where[chosen], totals
    if first:
        texts = row["texts"]
        names = [{"key": k, "f": n, "text": texts[i]} for k, n, i in zip(own[named].view(np.int64).tolist(), f.tolist(), named.tolist(), strict=True)]
    else:
        a, b = keys[pair[named] // len(keys)], keys[pair[named] % len(keys)]
        columns = (x.view(np.int64).tolist() for x in (own[named], a, b))
        names = [{"key": k, "f": n, "a": x, "b": y} for (k, x, y), n in zip(zip(*columns, strict=True), f.tolist(), strict=True)]
    out = {"bundle": row["bundle"], "lang": row["lang"], "words": row["words"], "names": names}
    if not last:
        ranked = where[np.argsort(pair[where])]
        wanted = pair[ranked]
        if first:
            new = np.full(len(keys), -1, np.int32)
            new[wanted] = np.arange(len(wanted), dtype=np.int32)
            new = new[codes]
            out["starts"] = row["starts"]
        else:
            at, pairs = joined(codes, starts, len(keys))
            place = np.minimum(np.searchsorted(wanted, pairs), len(wanted) - 1)
            hit = wanted[place] == pairs
            new = np.full(len(codes), -1, np.int32)
            new[at[hit]] = place[hit]
        out |= {"codes": packed(new.astype("<i4")), "keys": own[ranked].astype("<u8").tobytes()}
    yield _rows([out], RELATION_TYPES)


# ---- all lengths --------------------------------------------------------------------------------------------------


def frequent_phrases(
    docs: DataFrame, lang_col: str, text_col: str, longest: int, least: int, steps: common.Steps
) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and, by length from 1, key, lang, f, a, b, text of the phrases with at least ``least`` occurrences.

    a and b are the keys of a phrase without its last and without its first word; single words have a text instead.
    """
    relation = steps.write(_relation(docs, lang_col, text_col))
    counts = relation.groupBy("lang").agg(F.sum("words").alias("n"))
    counts = steps.write(counts)
    found: list[DataFrame] = []
    for length in range(1, longest + 1):
        words = relation.agg(F.sum("words")).first()[0] or 0
        # by the words alone: a row per bundle and part would be many small ones with more parts than the groups need
        tasks = max(1, -(-words // (2 * GROUPS_EACH)))
        answers = _frequent(relation, length == 1, least, tasks)
        after = steps.write(_extended(relation, answers, length == 1, length == longest))
        found.append(steps.write(after.select("lang", F.explode("names").alias("p")).select("p.key", "lang", "p.f", "p.a", "p.b", "p.text")))
        steps.drop(relation)
        relation = after
    steps.drop(relation)
    return counts, found


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    longest: int = LONGEST,
    least: int = LEAST,
    covered: int = COVERED,
    ranks: int = RANKS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``ranks`` phrases of 2 to ``longest`` words of each language.

    Texts are cut into pieces at . , ; : ! ? and \\x0A-\\x0D, pieces into words at blanks and tabs, A-Z lowered. A phrase
    with at least ``least`` occurrences is a candidate; n counts the words of its language (null: und), a the
    occurrences of the phrase, l and r those of its parts at the cut with the lowest score floor(2000000 a / (l + r)),
    the first of equals. A candidate goes if a longer candidate around it has ``covered`` percent of its occurrences.
    Order: score and a from the top, then the phrase by its bytes. A null text has no words; every row counts.

    Words and phrases are told apart by 64-bit keys. Counts are exact, and scores are computed in decimals.
    """
    steps = common.Steps(docs.sparkSession)
    counts, found = frequent_phrases(docs, lang_col, text_col, longest, least, steps)
    none = F.array().cast("array<long>")
    parts = found[0].select("key", "lang", "f", "text", F.col("text").alias("tail"), none.alias("heads"), none.alias("tails"))
    candidates = []
    for k, level in enumerate(found[1:], 1):
        # a common word is part of many phrases; Spark splits such keys of the larger side
        head = parts.select(F.col("key").alias("a"), F.col("text").alias("_text"), F.concat("heads", F.array("f")).alias("heads"))
        tail = parts.select(F.col("key").alias("b"), "tail", F.concat("tails", F.array("f")).alias("tails"))
        text = F.concat_ws(" ", "_text", "tail")
        whole = level.select("key", "lang", "f", "a", "b").join(head, "a").join(tail, "b")
        parts = steps.write(whole.select("key", "lang", "f", text.alias("text"), "tail", "heads", "tails"))
        longer = found[k + 1].select(F.explode(F.array("a", "b")).alias("key"), "f") if k + 1 < len(found) else None
        own = parts
        if longer is not None:
            around = longer.groupBy("key").agg(F.max("f").alias("_around"))
            hidden = F.coalesce(_exact("_around") * 100 >= _exact("f") * covered, F.lit(False))
            own = parts.join(around, "key", "left").filter(~hidden)
        candidates.append(own.select("lang", F.col("text").alias("phrase"), "f", "heads", "tails"))
    scored = reduce(DataFrame.unionByName, candidates).withColumn("c", F.array_min(F.expr(cut_sql())))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("f"), F.asc("phrase"))
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    return top.join(counts, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "c.l", "c.r", "n", "c.score"
    )


def _exact(column: str) -> Column:
    """A decimal, whose products may pass 64 bits."""
    return F.col(column).cast("decimal(20,0)")


def cut_sql() -> str:
    """Score and parts of every cut of a phrase; products are decimals, as they may pass 64 bits."""
    whole = "cast({} as decimal(20,0))"
    score = f"{whole.format('f')} * cast({SCALE} as decimal(10,0)) div ({whole.format('c.l')} + {whole.format('c.r')})"
    return f"""transform(zip_with(heads, reverse(tails), (x, y) -> struct(x AS l, y AS r)),
               (c, i) -> struct({score} AS score, i, c.l AS l, c.r AS r))"""
