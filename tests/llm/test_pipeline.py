"""The pipeline against a brute-force version of its stages, and every registered query on the smallest tables."""

import collections
import re

import duckdb
import pytest
from compare import compare, duck
from test_group_operators import brute_jaccard

import corpus_pipeline
from corpuskit.llm import language, pii
from corpuskit.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    rows = duckdb.connect().sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet'").fetchall()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = language.train(docs)
    known = {r.doc_id for r in language.predict(docs, net).collect() if r.lang_pred != "und" and r.score >= 0.3}
    text = {i: t for i, t, *_ in rows if i in known}
    first = {}
    for i in sorted(text):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text[i]), i)
    text = {i: text[i] for i in first.values()}
    text = {i: text[i] for i, (_, c) in brute_jaccard(list(text.items())).items() if c == i}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == set(text)
    assert len(known) >= 0.99 * len(rows)
    units = collections.Counter()
    for r in out:
        units[r.doc_id] += r.n_units
    stored = spark.createDataFrame([(i, t, len(t)) for i, t in text.items()], "doc_id long, text string, n_chars long")
    model = pii.train(stored)
    clean = {i: pii.redacted(t, model) for i, t in text.items()}
    assert sum(units.values()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1 for t in clean.values())


def test_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema == docs.schema, name


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, info = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, info
