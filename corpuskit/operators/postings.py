"""Stored inverted index for keyword search: the exact top k while few rows are read.

Rows of a token are kept in blocks, rows with many tokens first, and a block knows the most tokens of its rows. A search
first scores the rows of each query's rarest tokens, which gives a score that k rows reach. Any other row that reaches it
shares that many tokens, so it has one of the query's rarest T - score + 1 tokens, or holds the whole phrase and with it
every token inside the phrase. Only those postings are read, and only blocks whose bound reaches the score. The rows
that share most of these tokens are scored next, which raises the score that is left to be reached. Queries with fewer
than k such rows go on to words that contain a token, found through the grams of the vocabulary.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from corpuskit import runtime
from corpuskit.functions import text as X
from corpuskit.operators import retrieval as R
from corpuskit.operators.topk import _recency, _steps, _tokens

# Postings of a block, and postings that the first reading of a query aims at.
BLOCK, FIRST_ROWS = 128, 200
# Postings that a task packs, or merges for one token, at once, and rows of an Arrow batch that it gives.
BUNDLE, PACKS_AT_ONCE = 1_500_000, 10_000
# Most rounds in which packs become blocks, stored rows of a round, and rows that are wanted from the stored ones and are still sent to every task.
ROUNDS, ROUND_ROWS, SENT_ROWS = 8, 50_000, 200_000
_EDGE = rf"^[a-z0-9_{X.CJK}]+|[a-z0-9_{X.CJK}]+$"


def build(rows: DataFrame, path: str, row_id: str = "chunk_id", scope: str = "user_id", newest: str = "created_at") -> None:
    """Store ``rows`` (search_text and what a hit shows, no other column) with their postings below ``path``.

    rows: the rows by scope. postings: scope, token, blocks of row ids with the most tokens that a row of the block has.
    tokens: scope, token, number of rows. grams: 2- and 3-grams of the distinct tokens. Rows without scope are stored and
    never found. Tasks send the rows of a token packed, and packs are dealt by ranges: a token of a third of all rows
    comes as few rows and may be merged, and numbered, in several parts.
    Packs become blocks in up to ROUNDS rounds of tokens; shuffles and packs are deleted as soon as they are used.
    """
    spark = rows.sparkSession
    # a hit shows the first characters of the content; all of it stands in search_text
    shown = [c for c in R.HIT if c not in ("snippet", row_id)]
    kept = rows.withColumns({"_scope": F.col(scope), "_id": F.col(row_id), "_newest": _recency(rows, newest)})
    kept = R._with_hit_columns(kept).withColumn("content", F.col("snippet"))
    kept = kept.select("_scope", "_id", "_newest", *dict.fromkeys([row_id, scope, newest, *shown]), "content", "search_text")
    with runtime.shuffles_deleted(spark):
        ordered = kept.repartitionByRange("_scope", "_id").sortWithinPartitions("_scope", "_id")
        _written(ordered, f"{path}/rows")
        stored = spark.read.parquet(f"{path}/rows")
        text = F.lower(F.coalesce("search_text", F.lit(""))).alias("_text")
        texts = runtime.spread(stored).filter("_scope IS NOT NULL AND _id IS NOT NULL").select("_scope", "_id", text)
        rounds = max(1, min(ROUNDS, stored.count() // ROUND_ROWS))
        # a round's packs are deleted before those of the next are shuffled
        packs = _packed(texts).withColumn("_round", F.pmod(F.xxhash64("token"), F.lit(rounds)).cast("int"))
        packs.write.mode("overwrite").option("compression", "zstd").partitionBy("_round").parquet(f"{path}/packs")
        schema = packs.drop("_round").schema
        for i in range(rounds):
            at = f"{path}/packs/_round={i}"
            mode = "append" if i else "overwrite"
            packs = spark.read.schema(schema).parquet(at) if runtime.folder_names(spark, at) else spark.createDataFrame([], schema)
            by = ["token", "_scope", "most"]
            _written(_merged(packs.repartitionByRange(*by).sortWithinPartitions(*by)), f"{path}/postings", mode)
            _written(packs.groupBy("_scope", "token").agg(F.sum("df").alias("df")), f"{path}/tokens", mode)
            runtime.delete_folder(spark, at)
        runtime.delete_folder(spark, f"{path}/packs")
        known = spark.read.parquet(f"{path}/tokens").select("token").distinct()
        _written(known.select(F.explode(F.array_distinct(_grams(F.col("token")))).alias("gram"), "token"), f"{path}/grams")


def _written(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def _few(df: DataFrame) -> DataFrame:
    """A stored table, sent to every task if it is short, so that stored rows are not shuffled for it."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def _packed(texts: DataFrame) -> DataFrame:
    """_scope, token, most (tokens of a row, negative: the most first), df, n and ids of rows (_scope, _id, lower-case _text)."""
    kinds = {f.name: f.dataType for f in texts.schema}
    schema = T.StructType(
        [
            T.StructField("_scope", kinds["_scope"]),
            T.StructField("token", T.StringType()),
            T.StructField("most", T.IntegerType()),
            T.StructField("df", T.LongType()),
            T.StructField("n", T.ArrayType(T.IntegerType())),
            T.StructField("ids", T.ArrayType(kinds["_id"])),
        ]
    )
    fields = to_arrow_schema(schema)

    def bundle(keys: list[pa.Table], codes: list[np.ndarray], sizes: list[int], tokens: dict) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(keys).combine_chunks()
        scopes = table.column("_scope").combine_chunks().dictionary_encode()
        size = np.array(sizes, np.int64)
        row = np.repeat(np.arange(len(size)), size)
        of_row = scopes.indices.to_numpy().astype(np.int64) * max(1, len(tokens))
        key = of_row[row] + np.concatenate(codes)
        order = np.lexsort((-size[row], key))
        row, key = row[order], key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        ends = np.append(first, len(key))
        words = pa.array(list(tokens), pa.string())
        at, code = np.divmod(key[first], max(1, len(tokens)))
        columns = [
            scopes.dictionary.take(pa.array(at)),
            words.take(pa.array(code)),
            pa.array((-size[row[first]]).astype(np.int32)),
            pa.array(np.diff(ends)),
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(size[row].astype(np.int32))),
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), table.column("_id").combine_chunks().take(pa.array(row))),
        ]
        yield from pa.table(columns, fields.names).cast(fields).to_batches(max_chunksize=PACKS_AT_ONCE)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: defaultdict[str, int] = defaultdict()
        tokens.default_factory = tokens.__len__
        keys, codes, sizes, waiting = [], [], [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for start, length in _steps(table, BUNDLE):
                part = table.slice(start, length)
                keys.append(part.select(["_scope", "_id"]))
                for text in part.column("_text").to_pylist():
                    own = _tokens(text)
                    codes.append(np.fromiter(map(tokens.__getitem__, own), np.int64, len(own)))
                    sizes.append(len(own))
                    waiting += len(own)
                if waiting >= BUNDLE:
                    yield from bundle(keys, codes, sizes, tokens)
                    tokens.clear()
                    keys, codes, sizes, waiting = [], [], [], 0
        if keys:
            yield from bundle(keys, codes, sizes, tokens)

    return texts.mapInArrow(pack, schema)


def _merged(packs: DataFrame) -> DataFrame:
    """Blocks of the packs of each token, which follow each other: _scope, token, block, most, ids."""
    kinds = {f.name: f.dataType for f in packs.schema}
    schema = T.StructType(
        [
            T.StructField("_scope", kinds["_scope"]),
            T.StructField("token", T.StringType()),
            T.StructField("block", T.LongType()),
            T.StructField("most", T.IntegerType()),
            T.StructField("ids", kinds["ids"]),
        ]
    )
    fields, size = to_arrow_schema(schema), BLOCK

    def changes(table: pa.Table) -> np.ndarray:
        """Places where another token begins, the first row included."""
        differs = np.zeros(max(table.num_rows - 1, 0), bool)
        for c in ("token", "_scope"):
            column = table.column(c).combine_chunks()
            differs |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(np.r_[True, differs])

    def blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group = np.zeros(table.num_rows, np.int64)
        group[changes(table)[1:]] = 1
        group = np.cumsum(group)
        owner = np.repeat(np.arange(table.num_rows), table.column("df").to_numpy())
        n = table.column("n").combine_chunks().flatten().to_numpy()
        order = np.lexsort((-n, group[owner]))
        n, owner = n[order], owner[order]
        own = group[owner]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
        first = np.flatnonzero(rank % size == 0)
        ids = table.column("ids").combine_chunks().flatten().take(pa.array(order))
        columns = [
            table.column("_scope").take(pa.array(owner[first])),
            table.column("token").take(pa.array(owner[first])),
            pa.array(rank[first] // size),
            pa.array(n[first]),
            pa.ListArray.from_arrays(pa.array(np.append(first, len(own)).astype(np.int32)), ids),
        ]
        yield from pa.table(columns, fields.names).cast(fields).to_batches(max_chunksize=PACKS_AT_ONCE)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if waiting is not None:
                table = pa.concat_tables([waiting, table])
            # the last token may go on in the next batch; one with very many rows is cut here
            last = int(changes(table)[-1])
            if not last and pc.sum(table.column("df")).as_py() >= BUNDLE:
                last = table.num_rows
            if last:
                yield from blocks(table.slice(0, last))
            waiting = table.slice(last) if last < table.num_rows else None
        if waiting is not None:
            yield from blocks(waiting)

    return packs.mapInArrow(merge, schema)


def _grams(token: Column) -> Column:
    """All 2- and 3-grams."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(F.length(token) >= n, X.grams(token, n)).otherwise(none) for n in (2, 3)])


def keyword_topk(queries: DataFrame, path: str, k: int = 5, scope: str = "user_id") -> DataFrame:
    """The rows of ``retrieval.keyword_topk`` over the stored rows: query_id, rank, hit columns, score."""
    spark = queries.sparkSession
    rows = R._with_hit_columns(spark.read.parquet(f"{path}/rows"))
    order = Window.partitionBy("query_id").orderBy(F.desc("kw"), F.desc("_newest"), F.asc("_id"))
    with runtime.shuffles_deleted(spark):
        scored = keyword_scores(queries, path, k, scope)
        top = runtime.materialize(scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    found = rows.drop("_newest").join(_few(top), ["_scope", "_id"]).select("query_id", "rank", *R.HIT, F.col("kw").alias("score"))
    unlisted = _asked(queries, scope).filter(~F.exists("tokens", _long))
    scanned = R.keyword_topk(unlisted.select("query_id", F.col("_scope").alias(scope), "query_text"), rows, k, scope)
    return found.unionByName(scanned.select(*found.columns))


def _long(token: Column) -> Column:
    return F.length(token) > 1


def _asked(queries: DataFrame, scope: str) -> DataFrame:
    """Queries that have a text and a scope, with their tokens and those inside the phrase.

    A token between the first and the last run of letters stands in every text that holds the phrase.
    """
    asked = R.stripped(queries).select("query_id", F.col(scope).alias("_scope"), "query_text")
    asked = asked.filter("query_text <> '' AND _scope IS NOT NULL")
    inner = X.tokenize(F.regexp_replace(F.lower("query_text"), _EDGE, ""))
    return asked.withColumns({"tokens": X.tokenize(F.col("query_text")), "inner": inner})


def keyword_scores(queries: DataFrame, path: str, k: int = 5, scope: str = "user_id") -> DataFrame:
    """query_id, _scope, _id, _newest, kw of every row that can be among the top k (and some more that were read).

    Queries without a token of two characters are left out; no index knows their texts.
    """
    spark = queries.sparkSession
    asked = runtime.materialize(_asked(queries, scope).filter(F.exists("tokens", _long)))
    postings, rows = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/rows")

    parts = asked.select("query_id", "_scope", F.size("tokens").alias("total"), "inner", F.explode("tokens").alias("token"))
    parts = parts.withColumn("inner", F.array_contains("inner", F.col("token")))
    listed = parts.join(spark.read.parquet(f"{path}/tokens"), ["_scope", "token"], "left").fillna(0, ["df"])
    rarest = Window.partitionBy("query_id").orderBy("df", "token")
    listed = listed.withColumns(
        {
            "place": F.row_number().over(rarest),
            "before": F.sum("df").over(rarest) - F.col("df"),
            # the rarest token inside the phrase
            "key": F.col("inner") & (F.sum(F.col("inner").cast("int")).over(rarest) == 1),
        }
    )
    listed = runtime.materialize(listed)

    def read(tokens: DataFrame, blocks: int | None = None) -> DataFrame:
        """Rows of the tokens, from the blocks that can reach ``least``; of each token the first ``blocks`` if given."""
        met = tokens.join(postings if blocks is None else postings.filter(F.col("block") < blocks), ["_scope", "token"])
        return met.filter(F.least("total", "most") + 3 >= F.col("least")).select("query_id", "_scope", "total", "least", "token", "key", F.explode("ids").alias("_id"))

    def scored(pairs: DataFrame) -> DataFrame:
        # stored first: few pairs then travel to the texts, and a text is cut into tokens once for all of its queries
        of_row = runtime.materialize(pairs.groupBy("_scope", "_id").agg(F.collect_list("query_id").alias("of")))
        met = rows.select("_scope", "_id", "_newest", F.coalesce("search_text", F.lit("")).alias("text")).join(_few(of_row), ["_scope", "_id"])
        met = met.withColumn("t_tokens", X.tokenize(F.col("text"))).withColumn("query_id", F.explode("of")).drop("of")
        met = met.join(asked.select("query_id", "query_text", F.col("tokens").alias("q_tokens")), "query_id")
        kw = X.keyword_score(F.col("query_text"), F.col("text"), F.col("q_tokens"), F.col("t_tokens"))
        return runtime.materialize(met.select("query_id", "_scope", "_id", "_newest", kw.alias("kw")))

    # rows of the rarest tokens: as many tokens as k rows need, and further short lists; of long lists the first blocks
    few = (F.col("before") < k) | (F.col("before") + F.col("df") <= FIRST_ROWS)
    first = listed.filter(few & (F.col("df") > 0)).withColumn("least", F.lit(0.0))
    seeds = scored(read(first, -(-max(k, FIRST_ROWS) // BLOCK)).select("query_id", "_scope", "_id").distinct())
    kth = Window.partitionBy("query_id").orderBy(F.desc("kw"))

    def reached(known: DataFrame) -> DataFrame:
        """The score that k of the known rows reach."""
        placed = known.withColumn("_r", F.row_number().over(kth))
        return placed.filter(F.col("_r") == k).select("query_id", F.col("kw").alias("least"))

    # whatever else can reach the score of the k-th of them
    goal = listed.join(reached(seeds), "query_id", "left").fillna(0.0, ["least"])
    # a row without the phrase lacks at most T - least tokens
    needed = F.when(F.col("least") >= 1, F.col("total") - F.ceil("least") + 1).otherwise(F.col("total"))
    goal = runtime.materialize(goal.withColumn("needed", F.greatest(needed, F.lit(0))))
    wanted = goal.filter((F.col("df") > 0) & ((F.col("place") <= F.col("needed")) | F.col("key")))
    met = read(wanted.select("query_id", "_scope", "total", "least", "token", "key"))
    unread = goal.groupBy("query_id").agg(F.count_if((F.col("place") > F.col("needed")) & ~F.col("key")).alias("unread"))
    held = met.groupBy("query_id", "_scope", "_id", "least").agg(F.count("*").alias("c"), F.max("key").alias("phrase")).join(unread, "query_id")
    bound = F.col("c") + F.col("unread") + F.when(F.col("phrase"), 3).otherwise(0)
    held = runtime.materialize(held.withColumn("bound", bound).filter("bound >= least"))
    # those that share most of the tokens read so far raise the score that the others must be able to reach
    most = Window.partitionBy("query_id").orderBy(F.desc("bound"), F.asc("_id"))
    near = held.withColumn("_r", F.row_number().over(most)).filter(F.col("_r") <= max(k, FIRST_ROWS))
    near = scored(near.select("query_id", "_scope", "_id").join(seeds, ["query_id", "_scope", "_id"], "left_anti"))
    seeds = runtime.materialize(seeds.union(near))
    raised = held.drop("least").join(reached(seeds), "query_id", "left").fillna(0.0, ["least"])
    can = raised.filter("bound >= least").select("query_id", "_scope", "_id")
    # a phrase without such a token lies in a word that contains its longest token
    edge = parts.groupBy("query_id", "_scope", "total").agg(F.max("inner").alias("any"), F.max_by("token", F.length("token")).alias("t")).filter("NOT any")
    inside = read(_containing(spark, path, edge.filter(F.length("t") > 1)).withColumn("least", F.lit(0.0))).select("query_id", "_scope", "_id")
    second = scored(can.union(inside).distinct().join(seeds, ["query_id", "_scope", "_id"], "left_anti"))

    # queries with too few rows: tokens inside of words
    full = seeds.union(second).filter("kw >= 1").groupBy("query_id").count().filter(F.col("count") >= k)
    open_ = parts.join(full, "query_id", "left_anti").filter(_long(F.col("token")))
    words = _containing(spark, path, open_.select("query_id", "_scope", "total", F.col("token").alias("t"))).withColumn("least", F.lit(0.0))
    known = seeds.union(second).select("query_id", "_scope", "_id")
    third = scored(read(words).select("query_id", "_scope", "_id").distinct().join(known, ["query_id", "_scope", "_id"], "left_anti"))
    return reduce(DataFrame.union, (seeds, second, third)).filter("kw > 0")


def _containing(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """query_id, _scope, T, token, key: the known tokens that contain ``t``, through its first gram."""
    grams = spark.read.parquet(f"{path}/grams").withColumnRenamed("token", "_word")
    met = wanted.withColumn("gram", F.substring("t", 1, 3)).join(grams, "gram").filter(F.contains("_word", "t"))
    met = met.select("query_id", "_scope", "total", F.col("_word").alias("token"), F.lit(False).alias("key"))
    # stored: few tokens then travel to the postings
    return runtime.materialize(met.distinct())
