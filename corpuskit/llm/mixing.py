"""Mixing of sources to target weights: a min-cost flow from membership patterns to source quotas.

Documents are aggregated by the set of sources they belong to (their pattern). Words flow from patterns to the quotas of
their sources; the first copy of a pattern costs less than the second, the second less than the third. What a pattern
gives away is then drawn from its documents in a seeded order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm import common

# Weights by place of the source, in turn; copies that a document may have; seed of the order of documents.
WEIGHTS, REPEATS, SEED = (5, 2, 1), 3, 13
# Patterns, and memberships of all patterns, that the driver's network may have. More is an error, never a cut.
MOST_PATTERNS, MOST_MEMBERSHIPS = 100_000, 1_000_000
# Rows among which the last words of a pattern are sought one by one; hash bits that split a larger group.
GROUP_ROWS, BITS = 5_000, 10


def targets(sizes: Sequence[int], weights: Sequence[int], total: int, repeats: int = REPEATS) -> list[Fraction]:
    """Shares of ``total`` by weight, none above ``repeats`` times its size; what is cut off goes to the others by weight."""
    out = [Fraction(0)] * len(sizes)
    left, open_ = Fraction(total), list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if unit * weights[i] > repeats * sizes[i]]
        if not above:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in above:
            out[i] = Fraction(repeats * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


class Network:
    """Flow from a start over patterns and sources to an end, with residual arcs."""

    def __init__(self, patterns: Sequence[Sequence[int]], quotas: Sequence[int]):
        self.first_source, self.end = len(patterns) + 1, len(patterns) + len(quotas) + 1
        self.arcs: list[list[int]] = [[] for _ in range(self.end + 1)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.gives = [self._arc(0, p + 1, 0) for p in range(len(patterns))]
        unbounded = sum(quotas)
        self.members = [[(s, self._arc(p + 1, self.first_source + s, unbounded)) for s in own] for p, own in enumerate(patterns)]
        self.takes = [self._arc(self.first_source + s, self.end, q) for s, q in enumerate(quotas)]

    def _arc(self, a: int, b: int, room: int) -> int:
        self.to += [b, a]
        self.room += [room, 0]
        self.arcs[a].append(len(self.to) - 2)
        self.arcs[b].append(len(self.to) - 1)
        return len(self.to) - 2

    def push(self) -> None:
        """Augment along shortest paths of arcs with room until none is left."""
        while True:
            depth = {0: 0}
            queue = deque([0])
            while queue:
                node = queue.popleft()
                for e in self.arcs[node]:
                    if self.room[e] and self.to[e] not in depth:
                        depth[self.to[e]] = depth[node] + 1
                        queue.append(self.to[e])
            if self.end not in depth:
                return
            at = [0] * len(self.arcs)
            path: list[int] = []
            node = 0
            while True:
                if node == self.end:
                    flow = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= flow
                        self.room[e ^ 1] += flow
                    path, node = [], 0
                own = self.arcs[node]
                while at[node] < len(own):
                    e = own[at[node]]
                    if self.room[e] and depth.get(self.to[e]) == depth[node] + 1:
                        break
                    at[node] += 1
                if at[node] < len(own):
                    path.append(own[at[node]])
                    node = self.to[path[-1]]
                elif path:
                    node = self.to[path.pop() ^ 1]
                    at[node] += 1
                else:
                    break


def cheapest_flow(
    sizes: Sequence[int], patterns: Sequence[Sequence[int]], quotas: Sequence[int], repeats: int = REPEATS
) -> list[dict[int, int]]:
    """Words that each pattern gives to each of its sources: as many as the quotas take, at the least cost of repetition.

    sizes: words of a pattern; patterns: its sources; quotas: words that each source takes. The cost of a pattern's copies
    is convex and the same for all patterns, so paths over first copies are shorter than those over second ones, and so
    on: all paths of one cost are augmented together, and augmenting never takes back what a pattern gives.
    """
    net = Network(patterns, quotas)
    for _ in range(repeats):
        for p, size in enumerate(sizes):
            net.room[net.gives[p]] += size
        net.push()
    return [{s: net.room[e ^ 1] for s, e in own} for own in net.members]


@dataclass
class Mix:
    """documents: doc_id, sources, size, copies, taken. sources: name, size, target and words taken by the flow."""

    documents: DataFrame
    sources: list[tuple[str | None, int, float, int]] = field(default_factory=list)


def mix(
    docs: DataFrame,
    size: Column,
    sources: Column,
    id_col: str = "doc_id",
    weights: Sequence[int] = WEIGHTS,
    repeats: int = REPEATS,
    seed: int = SEED,
    group_rows: int = GROUP_ROWS,
) -> Mix:
    """How often each document is taken so that every source gets its target.

    ``sources`` is an array of names; a null name is a source like others, an empty or null array belongs to none and is
    not taken. A null or negative size counts as 0. Sources are ordered by code point, null last, and weigh ``weights`` in turn;
    their targets share the words of all documents, at most ``repeats`` times the source's own words. Every row counts,
    also rows that repeat an id or have none.

    A pattern that gives q times its words and some more gives every document q times, and the rest goes to documents
    in the order of a seeded hash of id and size. Groups of the order are halved by hash bits, all patterns at once, until
    the group in which the rest ends is small; its documents are taken one after the other where they fit. So one
    pattern may hold any share of the rows, and reruns agree. Only one row per pattern comes to the driver.
    """
    steps = common.Steps(docs.sparkSession)
    named = F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        named.alias("sources"),
        F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size"),
    )
    order = F.xxhash64("doc_id", "size", F.lit(seed))
    rows = steps.write(rows.withColumns({"pattern": F.to_json("sources"), "h": order}))
    found = rows.groupBy("pattern").agg(F.first("sources").alias("own"), F.sum("size").alias("words"), F.count("*").alias("n"))
    found = found.limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS or sum(len(r.own) for r in found) > MOST_MEMBERSHIPS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of sources or {MOST_MEMBERSHIPS} memberships")
    found.sort(key=lambda r: r.pattern)
    names = sorted({s for r in found for s in r.own}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in found:
        for s in r.own:
            sizes[place[s]] += r.words
    weight = [weights[i % len(weights)] for i in range(len(names))]
    wanted = targets(sizes, weight, sum(r.words for r in found if r.own), repeats)
    flow = cheapest_flow([r.words for r in found], [[place[s] for s in r.own] for r in found], [round(t) for t in wanted], repeats)
    taken = [0] * len(names)
    for own in flow:
        for s, words in own.items():
            taken[s] += words
    drawn = []  # pattern, copies of every document, words of one more copy, rows
    for r, own in zip(found, flow, strict=True):
        copies, rest = divmod(sum(own.values()), r.words) if r.words else (0, 0)
        drawn.append((r.pattern, copies, rest, r.n))
    documents = _draw(rows, drawn, group_rows).select("doc_id", "sources", "size", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    return Mix(documents, list(zip(names, sizes, map(float, wanted), taken, strict=True)))


def _prefix(depth: int | str) -> Column:
    """The first bits of the hash, as an unsigned number."""
    return F.expr(f"CASE WHEN {depth} = 0 THEN 0L ELSE shiftrightunsigned(h, 64 - {BITS} * {depth}) END")


def _draw(rows: DataFrame, drawn: list[tuple[str, int, int, int]], group_rows: int) -> DataFrame:
    """``rows`` with their number of copies. drawn: pattern, copies of every document, words of one more copy, rows."""
    spark = rows.sparkSession
    # pattern -> (hash bits that are settled, their value, words still wanted there, rows there)
    ends = {p: (0, 0, rest, n) for p, _, rest, n in drawn if rest}
    while large := {p: e for p, e in ends.items() if e[3] > group_rows and (e[0] + 1) * BITS <= 64}:
        state = spark.createDataFrame([(p, d, x, w) for p, (d, x, w, _) in large.items()], "pattern string, depth int, prefix long, wanted long")
        inside = rows.join(F.broadcast(state), "pattern").filter(_prefix("depth") == F.col("prefix"))
        parts = inside.groupBy("pattern", "wanted", _prefix("(depth + 1)").alias("part")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n")
        )
        # at most 2 ** BITS parts of a pattern: their running sum, then the part in which the wanted words end
        parts = parts.withColumn("upto", F.expr("sum(words) OVER (PARTITION BY pattern ORDER BY part)"))
        last = F.min(F.struct("part", (F.col("wanted") - F.col("upto") + F.col("words")).alias("left"), "n"))
        for r in parts.filter("upto > wanted").groupBy("pattern").agg(last.alias("e")).collect():
            ends[r.pattern] = (ends[r.pattern][0] + 1, r.e.part, r.e.left, r.e.n)
    plan = [(p, q, *ends.get(p, (0, -1, 0, 0))[:3]) for p, q, _, _ in drawn]
    plan = spark.createDataFrame(plan, "pattern string, q long, depth int, prefix long, wanted long")
    placed = rows.join(F.broadcast(plan), "pattern").withColumn("own", _prefix("depth"))
    settled = placed.filter("own <> prefix").withColumn("copies", F.col("q") + F.when(F.col("own") < F.col("prefix"), 1).otherwise(0))
    names = ["doc_id", "sources", "size"]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, left = None, 0
        for batch in batches:
            extra = []
            for p, words, wanted in zip(*(batch.column(c).to_pylist() for c in ("pattern", "size", "wanted")), strict=True):
                if p != pattern:
                    pattern, left = p, wanted
                extra.append(int(words <= left))
                left -= words if extra[-1] else 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*names, "q")), pa.array(extra, pa.int64())], [*names, "q", "extra"])

    open_ = placed.filter("own = prefix").select("pattern", *names, "h", "q", "wanted")
    tasks = common.partitions(spark, len(drawn) * group_rows, 1_000_000)
    open_ = open_.repartition(tasks, "pattern").sortWithinPartitions("pattern", "h", "size", "doc_id")
    fitted = open_.mapInArrow(fit, "doc_id long, sources array<string>, size long, q long, extra long")
    return settled.select(*names, "copies").unionByName(fitted.select(*names, (F.col("q") + F.col("extra")).alias("copies")))


def words(text: Column) -> Column:
    """Runs of characters other than white space; none in a null text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of documents with one source each (null is a source)."""
    own = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("size"), F.col(source_col).cast("string").alias("source"))
    found = mix(own, F.col("size"), F.array("source"))
    quotas = docs.sparkSession.createDataFrame([(s, n, t) for s, n, t, _ in found.sources], "name string, source_size long, target double")
    source = F.get("sources", F.lit(0))
    return found.documents.join(F.broadcast(quotas), source.eqNullSafe(F.col("name"))).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )
