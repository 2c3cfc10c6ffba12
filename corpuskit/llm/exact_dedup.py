"""Exact deduplication in three combining stages, native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm import common

# Parts of a digest group in the second stage.
SALTS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs`` with an id: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; a null text is empty. The row with
    the smallest id stays; a repeated id counts as often as it occurs. Rows without an id are left out.

    Copies meet in three steps, and every step groups by the digest and the whole text: in the tasks that read them
    (partial aggregate), in one of ``salts`` parts of their digest, and globally among the winners of the parts. So a
    text that a third of all rows share arrives as at most ``salts`` rows. The members then look up their group by
    SHA-256, MD5 and length: by broadcast for the groups above a thousandth of all rows (at most 1,000), by a join for
    the others.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("_text"))
    read = read.filter("doc_id is not null")
    keyed = read.withColumn("_sha", F.unhex(F.sha2("_text", 256)))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts))
    parts = keyed.groupBy("_sha", "_text", salt.alias("_salt")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    winners = parts.groupBy("_sha", "_text").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    steps = common.Steps(docs.sparkSession)
    groups = steps.write(winners.select(*_key(), "keep_id", "group_size"))
    rows = groups.agg(F.sum("group_size")).first()[0] or 0
    found = common.look_up(keyed.select("doc_id", *_key()), groups, ["_sha", "_md5", "_length"], "group_size", rows)
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def _key() -> list[Column]:
    """What tells two groups apart without their text."""
    return ["_sha", F.unhex(F.md5("_text")).alias("_md5"), F.length("_text").alias("_length")]


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text no row with a smaller id has; columns as they were."""
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs[id_col].cast("long") == kept["_kept"], "left_semi")
