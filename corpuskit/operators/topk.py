"""Batch top-k scoring: every query against the rows of its scope, without materialised pairs.

Each task scores its rows against the queries with NumPy and keeps only what can still be a
hit. Keyword scores are later divided by the largest one of the query, which no task knows. But
among rows with the *same* keyword score the order depends on the vector score alone, so the
best ``k`` rows per (query, keyword score) always contain the final top ``k`` and the maximum.

A query set of checked size is shipped to the tasks (the rows are not shuffled). A larger one is
cut into blocks, and blocks meet salted parts of a scope in a co-group: a hot scope is split over
many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from corpuskit import runtime
from corpuskit.operators.embedding import count_vectors, head_lengths

try:
    import ahocorasick
except ImportError:  # plain substring tests are used instead
    ahocorasick = None

# Rows of a scope that one co-group task holds, and queries per block, when queries are not shipped. Without texts: bytes
# of vectors. Scopes whose counts are broadcast.
PART_ROWS = 20_000
BLOCK_QUERIES = 20_000
PART_BYTES, BLOCK_BYTES = 32 << 20, 16 << 20
COUNTED_SCOPES, MOST_TASKS = 50_000, 4_000
SALTS = 32
# Pairs, rows and characters that are scored together, rows that are scored before there is a floor, known words of a
# query set and queries from which on they are kept, twice the keyword scores that have a floor.
_PAIRS_AT_ONCE = 300_000
_ROWS_AT_ONCE = 2_000
_CHARS_AT_ONCE = 2_000_000
_FIRST_ROWS = 32
_WORDS_KEPT = 200_000
_FEW = 100
_FLOORS = 256
# Uses of tokens by queries that are kept as a matrix, tokens inside a phrase from which on its tokens are looked for first.
_DENSE_USES = 4_000_000
_INNER = 3


@dataclass(frozen=True)
class Scoring:
    """What to score. ``vector`` is ``text`` (hash the texts), ``stored`` (embedding column) or ``None``.

    ``both``: the final score grows with both scores, so k rows that are better by vector and as good by keyword
    settle a row. Without it the best rows of every keyword score are kept.
    """

    k: int
    keyword: str | None  # "overlap", "contains" or None
    vector: str | None
    keep_zero: bool = False
    both: bool = False


_ASCII = re.compile(r"[a-z0-9_]{2,}")
_CJK = re.compile(r"[一-鿿]+")
_EDGE = re.compile(r"^[a-z0-9_一-鿿]+|[a-z0-9_一-鿿]+$")


def _tokens(lowered: str) -> set[str]:
    """Same set as ``functions.text.tokenize`` for a text that is in lower case already."""
    found = set(_ASCII.findall(lowered))
    if lowered.isascii():
        return found
    for run in _CJK.findall(lowered):
        sizes = (len(run),) if len(run) <= 3 else (2, 3)
        found.update(run[i : i + n] for n in sizes for i in range(len(run) - n + 1))
    return found


class _Finder:
    """Which of many strings a text contains: one pass of an automaton, or a test per string."""

    def __init__(self, strings) -> None:
        self.strings = list(strings)
        self.machine = None
        if ahocorasick is not None and len(self.strings) > 64:
            self.machine = ahocorasick.Automaton()
            for s in self.strings:
                self.machine.add_word(s, s)
            self.machine.make_automaton()

    def inside(self, text: str) -> set[str]:
        if self.machine is not None:
            return {s for _, s in self.machine.iter(text)}
        return {s for s in self.strings if s in text}


class _Heads:
    """What is found in the heads of texts (``head_lengths``), once for all that share one."""

    def __init__(self, texts: list[str], lengths: list[int]) -> None:
        self.texts, self.lengths = texts, lengths
        self.last: dict[str, tuple] = {}

    def of(self, i: int, name: str, find) -> list | set:
        if not self.lengths[i]:
            return []
        head, found = self.last.get(name, (None, None))
        if head is None or len(head) != self.lengths[i] or not self.texts[i].startswith(head):
            head = self.texts[i][: self.lengths[i]]
            found = find(head)
            self.last[name] = head, found
        return found


class _Words:
    """Texts in lower case with their tokens, and which of these the queries have."""

    def __init__(self, texts: list[str], vocabulary: dict[str, int], mode: str) -> None:
        self.texts = [t.lower() for t in texts]
        if mode == "overlap":
            # tokens hold no white space, so a text's tokens are those of its head and of the rest
            heads = head_lengths(self.texts)
            self.rests = [t[cut:] for t, cut in zip(self.texts, heads)]
            self.words = [_tokens(t) for t in self.rests]
            self.shared = _Heads(self.texts, heads)
            known = lambda own: [t for t in map(vocabulary.get, own) if t is not None]
            self.known = []
            for i, own in enumerate(self.words):
                found = set(known(own))
                found.update(self.shared.of(i, "tokens", lambda head: known(_tokens(head))))
                self.known.append(np.fromiter(found, np.int64, len(found)))


class _Queries:
    """The queries of one scope, prepared for scoring."""

    def __init__(self, ids: list, texts: list[str], vectors: list | None, how: Scoring):
        # the keyword score ignores case, the hashed vectors do not
        self.ids = ids
        self.texts = [t.lower() for t in texts]
        if how.vector == "text":
            counted = [count_vectors(texts[i : i + _ROWS_AT_ONCE]) for i in range(0, len(texts), _ROWS_AT_ONCE)]
            self.matrix = np.concatenate(counted)
        elif how.vector == "stored":
            self.matrix = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
        if how.vector:
            self.lengths = np.sqrt((self.matrix * self.matrix).sum(axis=1))
            self.unit = np.ascontiguousarray(_directions(self.matrix, self.lengths).T)
            # what single precision may add to or take from a cosine, and its rounding to 6 digits
            self.margin = 1e-6 + 6e-8 * (self.matrix.shape[1] + 8)
            small = self.matrix.astype(np.float32)
            if (small == self.matrix).all():
                self.matrix = small
        self.tokens = [sorted(_tokens(t), key=len) for t in self.texts] if how.keyword == "overlap" else []
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*self.tokens)))}
        self._index()
        self.phrases: dict[str, list[int]] = {}
        # a text with the phrase has the tokens inside it; how many it must have to be searched for a long phrase
        self.needed = np.full(len(ids), np.iinfo(self.counts).max, self.counts)
        for j, t in enumerate(self.texts):
            inner = len(_tokens(_EDGE.sub("", t))) if how.keyword == "overlap" else 0
            if inner >= _INNER:
                self.needed[j] = inner
            elif t:
                self.phrases.setdefault(t, []).append(j)
        self.long = bool((self.needed < np.iinfo(self.counts).max).any())
        self.phrase_finder = _Finder(self.phrases if how.keyword else ())
        self.part_finder = _Finder(t for t in self.vocabulary if len(t) > 1)
        self.parts: dict[str, tuple[int, ...]] = {}
        # least vector score per query and keyword score that can still be among the best
        self.floor = np.full((len(ids), _FLOORS + 1 if how.keyword else 1), -np.inf)

    def _index(self) -> None:
        """Tokens of the queries in a row, uses of frequent tokens as a matrix, the queries of each rare token in a row."""
        sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.flat = np.fromiter((self.vocabulary[t] for own in self.tokens for t in own), np.int64, int(sizes.sum()))
        self.ends = np.cumsum(sizes)
        self.some = np.flatnonzero(sizes)
        self.counts = np.uint8 if not len(sizes) or 2 * sizes.max() + 6 < 255 else np.uint16
        n, queries = len(self.vocabulary), len(self.ids)
        owner, uses = np.repeat(np.arange(len(sizes)), sizes), np.bincount(self.flat, minlength=n)
        often = uses >= (0 if n * queries <= _DENSE_USES else max(8, queries // 256))
        self.place = np.where(often, np.cumsum(often) - 1, -1)
        self.uses = np.zeros((int(often.sum()), queries), self.counts)
        dense = self.place[self.flat] >= 0
        self.uses[self.place[self.flat[dense]], owner[dense]] = 1
        order = np.argsort(self.flat, kind="stable")
        self.users, self.users_end = owner[order], np.cumsum(uses)
        self.users_begin = self.users_end - uses

    def _parts_of(self, word: str) -> tuple[int, ...]:
        """Tokens of the queries inside a word. A token that a text contains lies inside one of the text's own tokens."""
        if len(self.parts) >= _WORDS_KEPT:
            self.parts.clear()
        found = self.parts[word] = tuple(self.vocabulary[t] for t in self.part_finder.inside(word))
        return found

    def floors(self, how: Scoring) -> np.ndarray:
        return np.maximum.accumulate(self.floor[:, ::-1], axis=1)[:, ::-1] if how.both else self.floor

    def keyword_scores(self, texts: list[str], mode: str, open_: np.ndarray | None = None) -> np.ndarray:
        """Keyword score of each pair; tokens inside of words are looked for where ``open_`` (all pairs if not given)."""
        return 0.5 * self.levels(_Words(texts, self.vocabulary, mode), 0, len(texts), mode, open_)

    def levels(self, words: _Words, start: int, end: int, mode: str, open_: np.ndarray | None = None) -> np.ndarray:
        """Twice the keyword score of the texts from ``start`` to ``end`` with each query, as whole numbers."""
        shape = (end - start, len(self.ids))
        if mode != "overlap":
            levels = np.zeros(shape, self.counts)
            for i in range(start, end):
                for phrase in self.phrase_finder.inside(words.texts[i]):
                    levels[i - start, self.phrases[phrase]] = 2
            return levels
        shared = np.zeros(shape, self.counts)
        rare = []
        for i in range(start, end):
            own = words.known[i]
            at = self.place[own]
            np.add.reduce(self.uses[at[at >= 0]], axis=0, dtype=self.counts, out=shared[i - start])
            rare.append(own[at < 0])
        token = np.concatenate(rare)
        if len(token):
            many = self.users_end[token] - self.users_begin[token]
            row = np.repeat(np.repeat(np.arange(len(rare)), [len(own) for own in rare]), many)
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.users_begin[token], many)
            np.add.at(shared, (row, self.users[place]), self.counts(1))
        levels = shared * self.counts(2)
        if self.long:
            for i, j in zip(*np.nonzero(shared >= self.needed)):
                if self.texts[j] in words.texts[start + i]:
                    levels[i, j] += 6
        if self.phrases:
            for i in range(start, end):
                for phrase in self.phrase_finder.inside(words.texts[i]):
                    levels[i - start, self.phrases[phrase]] += 6
        none = levels == 0
        if open_ is not None:
            none &= open_
        inside = np.zeros(len(self.vocabulary), bool)
        for i in np.flatnonzero(none.any(axis=1)):
            own = self._inside(words, start + i)
            if not own:
                continue
            own = list(own)
            inside[own] = True
            asked = np.flatnonzero(none[i])
            if len(asked) <= _FEW:
                for j in asked:
                    if inside[self.flat[self.ends[j] - len(self.tokens[j]) : self.ends[j]]].any():
                        levels[i, j] = 1
            else:
                sizes = np.diff(np.r_[0, self.ends])[self.some]
                met = self.some[np.logical_or.reduceat(inside[self.flat], self.ends[self.some] - sizes)]
                levels[i, met[none[i, met]]] = 1
            inside[own] = False
        return levels

    def _inside(self, words: _Words, i: int) -> set[int]:
        """Tokens of the queries that lie inside the words of a text."""
        if len(self.ids) <= _FEW:  # the words of a text repeat too rarely to be worth keeping
            own = {self.vocabulary[t] for t in self.part_finder.inside(words.rests[i])}
            own.update(words.shared.of(i, "parts", lambda head: [self.vocabulary[t] for t in self.part_finder.inside(head)]))
            return own
        own = set()
        for word in words.words[i].union(words.shared.of(i, "words", _tokens)):
            found = self.parts.get(word)
            own.update(self._parts_of(word) if found is None else found)
        return own

    def cosines(self, rows: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact cosines of pairs, 6 digits."""
        lengths = np.sqrt((rows * rows).sum(axis=1))
        if 16 * len(r) > len(rows) * len(self.ids):
            dots = (rows @ self.matrix.T.astype(np.float64))[r, q]
        else:
            runs = [slice(i, i + _ROWS_AT_ONCE) for i in range(0, len(r), _ROWS_AT_ONCE)]
            dots = np.concatenate([np.einsum("ij,ij->i", rows[r[o]], self.matrix[q[o]].astype(np.float64)) for o in runs] or [np.zeros(0)])
        scale = lengths[r] * self.lengths[q]
        return np.round(np.divide(dots, scale, out=np.zeros(scale.shape), where=scale >= 1e-18), 6)


def _directions(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of length one in single precision; zero where a row has none, not a number where its length is none."""
    lengths = np.where(np.isfinite(lengths), lengths, np.nan)[:, None]
    return np.divide(rows, lengths, out=np.zeros(rows.shape), where=~(lengths < 1e-18)).astype(np.float32)


def _vectors(table: pa.Table) -> np.ndarray:
    column = table.column("_vector").combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(table.num_rows, -1)


def _steps(table: pa.Table, most_rows: int) -> Iterator[tuple[int, int]]:
    """Runs of rows (start, length) of a bounded number of rows and of characters; a longer text is a run of its own."""
    chars = pc.fill_null(pc.binary_length(table.column("_text")), 0).to_numpy().cumsum()
    start = 0
    while start < table.num_rows:
        before = chars[start - 1] if start else 0
        end = int(np.searchsorted(chars, before + _CHARS_AT_ONCE, "right"))
        end = max(start + 1, min(end, start + most_rows))
        yield start, end - start
        start = end


def _candidates(table: pa.Table, queries: _Queries, how: Scoring) -> pa.Table:
    """Rows of one scope that can be among the top k of one of its queries."""
    keys = pd.DataFrame({c: table.column(c).to_numpy() for c in ("_newest", "_id")})
    place = np.empty(table.num_rows, np.int64)
    place[keys.sort_values(["_newest", "_id"], ascending=[False, True]).index.to_numpy()] = np.arange(table.num_rows)
    base = np.arange(len(queries.ids))[None, :] * (_FLOORS + 1)
    kept: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]  # row, query, kw, vec
    new: list[list[np.ndarray]] = []
    waiting = 0

    def best() -> list[np.ndarray]:
        """The best k of every query and keyword score; they raise the floor of what comes."""
        r, q, kw, vec = [np.concatenate(c) for c in zip(kept, *new)]
        order = np.lexsort((place[r], -vec, kw, q))
        r, q, kw, vec = r[order], q[order], kw[order], vec[order]
        starts = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (kw[1:] != kw[:-1])]) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        last = rank == how.k - 1
        low = last & (kw < _FLOORS // 2)
        at = q[low], (2 * kw[low]).astype(np.int64)
        queries.floor[at] = np.maximum(queries.floor[at], vec[low])
        first = rank < how.k
        if how.both:  # rows that others settled since
            first &= ~(vec < queries.floors(how)[q, np.minimum(2 * kw, _FLOORS).astype(np.int64)])
        return [c[first] for c in (r, q, kw, vec)]

    def lowest() -> tuple[np.ndarray, np.ndarray | None]:
        """The floors, and in single precision what no pair below it can pass."""
        floors = queries.floors(how)
        return floors, (floors - queries.margin).astype(np.float32) if how.vector else None

    (floors, low), most, grown = lowest(), max(1, _PAIRS_AT_ONCE // max(1, len(queries.ids))), _FIRST_ROWS
    for start, length in _steps(table, _ROWS_AT_ONCE):
        part = table.slice(start, length)
        texts = part.column("_text").to_pylist() if how.keyword or how.vector == "text" else None
        words = _Words(texts, queries.vocabulary, how.keyword) if how.keyword else None
        if how.vector:
            rows = count_vectors(texts) if how.vector == "text" else _vectors(part)
            units = _directions(rows, np.sqrt((rows * rows).sum(axis=1)))
        begin = 0
        while begin < length:
            # few rows at first: all of their pairs pass, and then there is a floor
            end = min(length, begin + min(most, grown))
            grown *= 2
            open_ = None
            if how.vector:
                # single precision tells which pairs can pass; these are compared exactly
                near = units[begin:end] @ queries.unit
                # below the floor of 0.5, and so of 0, it does not matter which of the two a pair has
                open_ = ~(near < low[:, 1]) if how.both else None
            if how.keyword:
                levels = queries.levels(words, begin, end, how.keyword, open_)
            if how.both and how.vector and how.keyword:
                # floors fall with the keyword score: first a common one for the pairs with few shared tokens
                few = min(_FLOORS, int(np.percentile(levels.ravel()[::101], 98)))
                r, q = np.nonzero(~(near < low[:, few]) | (levels > few))
                passed = ~(near[r, q] < low[q, np.minimum(levels[r, q].astype(np.int64), _FLOORS)])
                r, q = r[passed], q[passed]
            elif how.vector and how.keyword:
                r, q = np.nonzero(~(near < low.ravel()[np.minimum(levels.astype(np.int64), _FLOORS) + base]))
            elif how.vector:
                r, q = np.nonzero(~(near < low[:, 0]))
            else:
                r, q = np.nonzero(np.ones(levels.shape, bool) if how.keep_zero else levels)
            level = levels[r, q].astype(np.int64) if how.keyword else np.zeros(len(r), np.int64)
            if how.vector:
                vec = queries.cosines(rows[begin:end], r, q)
                passed = ~(vec < floors[q, np.minimum(level, _FLOORS)])
                if not how.keep_zero:
                    passed &= (level > 0) | (vec > 0)
                r, q, level, vec = r[passed], q[passed], level[passed], vec[passed]
            else:
                vec = np.zeros(len(r))
            new.append([r + start + begin, q, 0.5 * level, vec])
            waiting += len(r)
            if waiting > max(20_000, len(kept[0]) // 2):
                kept, new, waiting = best(), [], 0
                floors, low = lowest()
            begin = end
    r, q, kw, vec = best()
    hits = table.drop_columns(["_text", "_vector"]).take(pa.array(r))
    hits = hits.append_column("_query", pa.array(q))
    return hits.append_column("kw", pa.array(kw)).append_column("vec", pa.array(vec))


def _prune(hits: pa.Table, k: int) -> pa.Table:
    """Best k rows per (query, keyword score): vector score, then newest, then smallest id."""
    keys = pd.DataFrame({c: hits.column(c).to_numpy() for c in ("_query", "kw", "vec", "_newest", "_id")})
    ordered = keys.sort_values(["_query", "kw", "vec", "_newest", "_id"], ascending=[True, True, False, False, True])
    rank = ordered.groupby(["_query", "kw"], sort=False).cumcount()
    return hits.take(pa.array(ordered.index[rank < k].to_numpy()))


def _output(hits: pa.Table, queries: _Queries, fields: pa.Schema) -> pa.Table:
    ids = pa.array([queries.ids[j] for j in hits.column("_query").to_pylist()], fields.field("query_id").type)
    table = hits.append_column("query_id", ids)
    return table.select(fields.names).cast(fields)


class _Scopes(dict):
    """Queries by scope from (query_id, scope, text, vector) rows, prepared when a scope is met."""

    def __init__(self, rows, how: Scoring):
        super().__init__()
        self.how = how
        self.raw: dict = {}
        for query_id, scope, text, vector in rows:
            ids, texts, vectors = self.raw.setdefault(scope, ([], [], []))
            ids.append(query_id)
            texts.append(text or "")
            vectors.append(vector)

    def __missing__(self, scope) -> _Queries:
        self[scope] = _Queries(*self.raw[scope], self.how)
        return self[scope]


def _shipped(rows: DataFrame, queries: list, how: Scoring, schema: T.StructType) -> DataFrame:
    """Score with the queries inside the task closure; rows of scopes nobody asks for never reach Python."""
    fields = to_arrow_schema(schema)
    asked = {scope for _, scope, _, _ in queries if scope is not None}
    rows = rows.filter(F.col("_scope").isin(*asked)) if asked else rows.limit(0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = _Scopes(queries, how)
        kept: dict = {}
        limit: dict = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            # grouped in Arrow: through floats, large ids of different scopes would become one
            scopes = batch.column("_scope").dictionary_encode()
            for code, scope in enumerate(scopes.dictionary.to_pylist()):
                if scope is None or scope not in prepared.raw:
                    continue
                own = table.filter(pc.fill_null(pc.equal(scopes.indices, code), False))
                hits = _candidates(own, prepared[scope], how)
                if scope in kept:
                    hits = pa.concat_tables([kept[scope], hits])
                if hits.num_rows > limit.get(scope, 0):
                    hits = _prune(hits, how.k)
                    limit[scope] = 2 * hits.num_rows + 1_000
                kept[scope] = hits
        for scope, hits in kept.items():
            yield from _output(_prune(hits, how.k), prepared[scope], fields).to_batches()

    return rows.mapInArrow(score, schema)


def _cogrouped(rows: DataFrame, queries: DataFrame, how: Scoring, schema: T.StructType) -> DataFrame:
    """Query blocks against salted parts of their scope."""
    fields = to_arrow_schema(schema)
    queries, rows = queries.filter("_scope IS NOT NULL"), rows.filter("_scope IS NOT NULL")
    n_parts, n_blocks = F.ceil(F.count("*") / F.lit(PART_ROWS)), F.ceil(F.count("*") / F.lit(BLOCK_QUERIES))
    if how.keyword is None and how.vector == "stored":  # vectors alone: by their bytes
        held = F.sum(4 * F.greatest(F.coalesce(F.size("_vector"), F.lit(0)), F.lit(0)) + 100)
        n_parts, n_blocks = F.ceil(held / F.lit(PART_BYTES)), F.ceil(held / F.lit(BLOCK_BYTES))
    sizes = rows.groupBy("_scope").agg(n_parts.cast("int").alias("_parts"))
    blocks = queries.groupBy("_scope").agg(n_blocks.cast("int").alias("_blocks"))
    counts = runtime.materialize(sizes.join(blocks, "_scope"))
    size = counts.agg(F.count("*").alias("scopes"), F.coalesce(F.sum(F.col("_parts").cast("long") * F.col("_blocks")), F.lit(0)).alias("groups")).first()
    few = size["scopes"] <= COUNTED_SCOPES  # then the rows are shuffled once only
    # a scope's counts are repeated per salt, so that a hot scope meets them in many tasks
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    counts = F.broadcast(counts) if few else counts.select("*", salts)

    def with_counts(df: DataFrame, id_col: str) -> DataFrame:
        if few:
            return df.join(counts, "_scope")
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
        return salted.join(counts, ["_scope", "_salt"]).drop("_salt")

    left = (
        with_counts(queries, "query_id")
        .withColumn("_block", F.pmod(F.xxhash64("query_id"), "_blocks").cast("int"))
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .drop("_parts", "_blocks")
    )
    right = (
        with_counts(rows, "_id")
        .withColumn("_part", F.pmod(F.xxhash64("_id"), "_parts").cast("int"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .drop("_parts", "_blocks")
    )

    def score(block: pa.Table, part: pa.Table) -> pa.Table:
        if block.num_rows == 0 or part.num_rows == 0:
            return fields.empty_table()
        columns = [block.column(c).to_pylist() for c in ("query_id", "_scope", "_text", "_vector")]
        scopes = _Scopes(zip(*columns), how)
        prepared = scopes[columns[1][0]]
        return _output(_candidates(part, prepared, how), prepared, fields)

    keys = ["_scope", "_block", "_part"]
    # groups take time by their pairs, not by their bytes, so they are not put together by bytes
    tasks = max(1, min(2 * size["groups"], MOST_TASKS))
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)


def best_per_keyword_score(
    queries: DataFrame,
    rows: DataFrame,
    how: Scoring,
    *,
    payload: list[str],
    scope: str = "scope",
    newest: str | None = None,
    row_id: str = "chunk_id",
    row_limit: int = runtime.SHIPPED_ROW_LIMIT,
    char_limit: int = runtime.SHIPPED_CHAR_LIMIT,
) -> DataFrame:
    """Best ``how.k`` rows per query and keyword score: every row that can be in the top k.

    ``queries``: query_id, ``scope`` and query_text and/or embedding. ``rows``: ``scope``, ``row_id``,
    search_text and/or embedding, the payload columns and the recency column ``newest``.
    """
    nothing = F.lit(None).cast("array<float>")
    vector = F.col("embedding") if how.vector == "stored" else nothing
    uses_text = how.keyword is not None or how.vector == "text"
    query_text = F.col("query_text") if uses_text else F.lit("")
    row_text = F.coalesce("search_text", F.lit("")) if uses_text else F.lit("")
    asked = queries.select("query_id", F.col(scope).alias("_scope"), query_text.alias("_text"), vector.alias("_vector"))
    recency = _recency(rows, newest)
    scored = rows.select(
        F.col(scope).alias("_scope"),
        F.col(row_id).alias("_id"),
        recency.alias("_newest"),
        row_text.alias("_text"),
        vector.alias("_vector"),
        *payload,
    )
    inner = T.StructType(
        [queries.schema["query_id"]]
        + [scored.schema[c] for c in ["_id", "_newest", *payload]]
        + [T.StructField("kw", T.DoubleType()), T.StructField("vec", T.DoubleType())]
    )
    numbers = 8 * F.coalesce(F.size("_vector"), F.lit(0))
    if runtime.fits_in_tasks(asked, F.length("_text") + F.greatest(numbers, F.lit(0)), row_limit, char_limit):
        best = _shipped(scored, [tuple(r) for r in asked.collect()], how, inner)
    else:
        best = _cogrouped(scored, asked, how, inner)
    # one shuffle for all windows of a query
    best = best.repartition("query_id")
    per_value = Window.partitionBy("query_id", "kw").orderBy(F.desc("vec"), F.desc("_newest"), F.asc("_id"))
    return best.withColumn("_r", F.row_number().over(per_value)).filter(F.col("_r") <= how.k).drop("_r")


def _recency(rows: DataFrame, newest: str | None) -> Column:
    """Order of age as a long without nulls: microseconds of times, the value itself of numbers; null is the oldest."""
    if newest is None:
        return F.lit(0).cast("long")
    timed = isinstance(rows.schema[newest].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    value = F.unix_micros(F.col(newest).cast("timestamp")) if timed else F.col(newest).cast("long")
    return F.coalesce(value, F.lit(-(2**63)))


def score_topk(
    queries: DataFrame, rows: DataFrame, how: Scoring, *, final_score: Column, payload: list[str], **options
) -> DataFrame:
    """Top ``how.k`` rows per query, ranked by ``final_score`` (over ``kw``, ``vec``, ``max_kw``)."""
    best = best_per_keyword_score(queries, rows, how, payload=payload, **options)
    per_query = Window.partitionBy("query_id")
    best = best.withColumn("max_kw", F.max("kw").over(per_query)).withColumn("score", final_score)
    order = per_query.orderBy(F.desc("score"), F.desc("_newest"), F.asc("_id"))
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= how.k)
    return best.select("query_id", "rank", *payload, "kw", "vec", "score")
