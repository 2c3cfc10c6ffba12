"""A corpus from raw documents to packed sequences, in five stages; each reads what the one before has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit import runtime
from corpuskit.llm import exact_dedup, language, ngram_join, packing, pii


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without text, without a letter, or of no language that the network is at all sure of."""
    runtime.ship_package(spark)
    return language.keep_known(docs, language.train(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the smallest doc_id stays."""
    runtime.ship_package(spark)
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.75 over five-word shingles the smallest doc_id stays."""
    runtime.ship_package(spark)
    return ngram_join.drop_near_copies(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets."""
    runtime.ship_package(spark)
    return pii.redact(docs, pii.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document in sequences of 2,048 words."""
    runtime.ship_package(spark)
    return packing.pack(docs, packing.words(F.col("text")), F.col("source"), packing.copies(F.col("text")))


STAGES = [
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("ngram_join", without_near_copies),
    ("pii", without_personal_data),
    ("packing", packed),
]

# Trained models, personal data spans and packing are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{runtime.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
