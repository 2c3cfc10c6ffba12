"""Duplicates by URL, by content hash and by SimHash distance."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit import runtime
from corpuskit.functions.text import content_hash, hamming
from corpuskit.functions.urls import url_key
from corpuskit.operators.embedding import simhash_column

MAX_DISTANCE = 3
# Distinct fingerprints under one key before its pairs are found by flipped bits instead.
HOT_KEY = 2_000


def known_key_antijoin(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    return new.join(stored.select(key).distinct(), key, "left_anti")


def _place(row_id: str, order: list[str]) -> Column:
    """Sortable place of a row: the order columns, then its id."""
    return F.struct(*order, F.col(row_id).alias("_id"))


def first_per_key(df: DataFrame, key: str, row_id: str, order: list[str]) -> DataFrame:
    """Ids of the rows that are the first of their key; rows with an empty key all count as first.

    Only (key, order, id) is aggregated, with partial aggregation: a key that holds a third of
    the rows costs one row per map task.
    """
    filled = F.coalesce(F.col(key), F.lit("")) != ""
    first = F.min(_place(row_id, order))["_id"].alias(row_id)
    firsts = df.filter(filled).groupBy(key).agg(first).select(row_id)
    return firsts.unionByName(df.filter(~filled).select(row_id))


def dedup_first_url(df: DataFrame, row_id: str, order: list[str], url: str = "url") -> DataFrame:
    keyed = df.withColumn("_key", url_key(F.col(url)))
    return df.join(first_per_key(keyed, "_key", row_id, order), row_id, "left_semi")


def dedup_first_hash(df: DataFrame, row_id: str, order: list[str], text: str = "text") -> DataFrame:
    keyed = df.withColumn("_key", F.when(F.col(text) != "", content_hash(F.col(text))))
    return df.join(first_per_key(keyed, "_key", row_id, order), row_id, "left_semi")


def dedup_exact(df: DataFrame, row_id: str, order: list[str], url: str = "url", text: str = "text") -> DataFrame:
    """First row per canonical URL, then first row per content hash among those."""
    narrow = df.select(
        row_id,
        *[c for c in order if c != row_id],
        url_key(F.col(url)).alias("_url"),
        F.when(F.col(text) != "", content_hash(F.col(text))).alias("_hash"),
    )
    by_url = narrow.join(first_per_key(narrow, "_url", row_id, order), row_id, "left_semi")
    return df.join(first_per_key(by_url, "_hash", row_id, order), row_id, "left_semi")


def _block_masks(blocks: int, keep: int) -> list[int]:
    """Masks of every choice of ``keep`` among ``blocks`` runs of the 64 bits."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    runs = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [sum(choice) for choice in combinations(runs, keep)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


# Two fingerprints that differ in at most 3 bits agree on at least 3 of 6 blocks. So some choice
# of 3 blocks (about 32 bits) is equal: an equi-join on 20 keys per fingerprint finds every pair.
_MASKS = _block_masks(6, MAX_DISTANCE)


def _masks(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)) for m in masks])


def _is_first_equal(masks: Column, a: Column, b: Column, at: Column) -> Column:
    """True when mask number ``at`` is the first one on which both sides agree."""
    agree = F.transform(masks, lambda m: a.bitwiseXOR(b).bitwiseAND(m) == 0)
    return F.array_position(agree, True) == at + 1


def block_keys(fingerprints: DataFrame, simhash: str = "fp") -> DataFrame:
    """(fp, at, key): fingerprints within distance 3 share at least one (at, key)."""
    masked = fingerprints.select(F.col(simhash).alias("fp"), F.posexplode(_masks(_MASKS)).alias("at", "mask"))
    return masked.select("fp", "at", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def _shuffled(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Join of exploded rows. Spark's estimate of their size leaves the explode out, so that it would broadcast the keys of
    all fingerprints through the driver."""
    return left.hint("merge").join(right.hint("merge"), on)


def simhash_pairs(fingerprints: DataFrame, simhash: str = "simhash", hot_key: int = HOT_KEY) -> DataFrame:
    """Pairs of different fingerprints within Hamming distance 3: (a, b, distance) with a < b.

    Works on distinct fingerprints, so exact copies add nothing. A fingerprint has at most
    43,744 others within distance 3, which bounds the pairs. Each pair comes out once.
    """
    fps = runtime.materialize(fingerprints.select(F.col(simhash).alias("fp")).distinct())
    masks, keyed = _masks(_MASKS), block_keys(fps)
    a, b = F.col("a"), F.col("b")
    is_near = (a < b) & (hamming(a, b) <= MAX_DISTANCE)
    sizes = keyed.groupBy("at", "key").agg(F.count("*").alias("n"))
    hot = sizes.filter(F.col("n") > hot_key).select("at", "key")
    on = ["at", "key"]
    if hot.isEmpty():
        left, right = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
        found = _shuffled(left, right, on).filter(is_near).filter(_is_first_equal(masks, a, b, F.col("at"))).select("a", "b")
    else:
        # Pairs of which both sides are under some shared hot key come from the flipped bits; every
        # other pair shares no hot key.
        hot_fps = runtime.materialize(keyed.join(hot, on, "left_semi").select("fp").distinct())
        cold = keyed.join(hot, on, "left_anti").join(hot_fps.withColumn("h", F.lit(True)), "fp", "left")
        cold = cold.withColumn("h", F.coalesce("h", F.lit(False)))
        left = cold.withColumnsRenamed({"fp": "a", "h": "a_hot"})
        right = cold.withColumnsRenamed({"fp": "b", "h": "b_hot"})
        near = _shuffled(left, right, on).filter(is_near & ~(F.col("a_hot") & F.col("b_hot")))
        near = near.filter(_is_first_equal(masks, a, b, F.col("at"))).select("a", "b")
        found = near.unionByName(_pairs_by_flips(hot_fps))
    return found.select("a", "b", hamming(a, b).alias("distance"))


_ONE_FLIP = "concat(array(0L), transform(sequence(0, 63), i -> shiftleft(1L, i)))"
_TWO_FLIPS = (
    "concat(array(0L), flatten(transform(sequence(0, 63), "
    "i -> transform(sequence(0, i), j -> shiftleft(1L, i) | shiftleft(1L, j)))))"
)


def _pairs_by_flips(fps: DataFrame) -> DataFrame:
    """All pairs (a, b) within distance 3: one side with up to one bit flipped meets the other with up to two.

    2,146 rows per fingerprint, whatever their number: linear where a shared key would be quadratic.
    """
    one = fps.select(F.col("fp").alias("a"), F.explode(F.expr(_ONE_FLIP)).alias("m"))
    two = fps.select(F.col("fp").alias("b"), F.explode(F.expr(_TWO_FLIPS)).alias("m"))
    one = one.select("a", F.col("a").bitwiseXOR(F.col("m")).alias("value"))
    two = two.select("b", F.col("b").bitwiseXOR(F.col("m")).alias("value"))
    return _shuffled(one, two, "value").filter("a < b").select("a", "b").distinct()


def greedy_dropped(edges: DataFrame) -> DataFrame:
    """Nodes that a sequential pass drops, given edges (src, dst) from earlier to later nodes.

    A node is dropped when an earlier *kept* neighbour exists. Each round keeps the nodes without
    open earlier neighbours and drops what they reach; edges of decided nodes disappear. Rounds
    are bounded by the longest chain of neighbours.
    """
    state = runtime.materialize(edges.select("src", "dst"))
    while not state.filter("src IS NOT NULL").isEmpty():
        # rows without a source are the nodes that earlier rounds dropped
        open_edges = state.filter("src IS NOT NULL")
        later = open_edges.select(F.col("dst").alias("src")).distinct()
        gone = open_edges.join(later, "src", "left_anti").select(F.col("dst").alias("node")).distinct()
        left = open_edges.join(gone, F.col("src") == F.col("node"), "left_anti")
        left = left.join(gone, F.col("dst") == F.col("node"), "left_anti")
        marks = gone.select(F.lit(None).cast("long").alias("src"), F.col("node").alias("dst"))
        state = runtime.materialize(state.filter("src IS NULL").unionByName(left).unionByName(marks))
    return state.select(F.col("dst").alias("node"))


def dedup_simhash_greedy(df: DataFrame, row_id: str, order: list[str], simhash: str = "simhash") -> DataFrame:
    """Rows that stay when each row within distance 3 of an earlier kept row is dropped, in order."""
    place = F.min(_place(row_id, order)).alias("place")
    firsts = runtime.materialize(df.groupBy(F.col(simhash).alias("fp")).agg(place))
    pairs = simhash_pairs(firsts, "fp")
    first_a = firsts.select(F.col("fp").alias("a"), F.col("place").alias("pa"))
    first_b = firsts.select(F.col("fp").alias("b"), F.col("place").alias("pb"))
    a_first = F.col("pa") < F.col("pb")
    edges = pairs.join(first_a.hint("merge"), "a").join(first_b.hint("merge"), "b").select(
        F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("src"),
        F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("dst"),
    )
    kept = firsts.join(greedy_dropped(edges), F.col("fp") == F.col("node"), "left_anti")
    return df.join(kept.select(F.col("place._id").alias(row_id)), row_id, "left_semi")


def duplicate_reasons(
    df: DataFrame, row_id: str, order: list[str], url: str = "url", text: str = "text"
) -> DataFrame:
    """(row_id, reason) with reason ``url``, ``hash``, ``simhash`` or empty, checked in this order.

    The text is read once, into narrow fingerprints that all three stages share.
    """
    has_text = F.col(text) != ""
    narrow = runtime.materialize(
        df.select(
            row_id,
            *[c for c in order if c != row_id],
            url_key(F.col(url)).alias("_url"),
            F.when(has_text, content_hash(F.col(text))).alias("_hash"),
            F.when(has_text, simhash_column(F.col(text))).alias("_simhash"),
        )
    )
    url_ids = first_per_key(narrow, "_url", row_id, order)
    by_url = narrow.join(url_ids, row_id, "left_semi")
    by_hash = by_url.join(first_per_key(by_url, "_hash", row_id, order), row_id, "left_semi")
    near = dedup_simhash_greedy(by_hash.filter("_simhash IS NOT NULL"), row_id, order, "_simhash")
    kept = near.select(row_id).unionByName(by_hash.filter("_simhash IS NULL").select(row_id))
    stages = (
        narrow.select(row_id)
        .join(by_url.select(row_id, F.lit(True).alias("u")), row_id, "left")
        .join(by_hash.select(row_id, F.lit(True).alias("h")), row_id, "left")
        .join(kept.withColumn("k", F.lit(True)), row_id, "left")
    )
    reason = F.when(F.col("u").isNull(), "url").when(F.col("h").isNull(), "hash").when(F.col("k").isNull(), "simhash")
    return stages.select(row_id, reason.otherwise("").alias("reason"))
