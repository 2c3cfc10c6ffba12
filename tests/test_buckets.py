"""The bucketed store: what an upsert or delete rewrites, what it leaves alone, and a change that was cut off."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpuskit import runtime
from corpuskit.sources import buckets

STORED = "chunk_id long, content string, doc_type string, collection string"


def rows(df):
    return {r.chunk_id: (r.content, r.doc_type, r.collection) for r in df.collect()}


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "chunks")
    data = [(i, f"text {i}", "rule", "rules") for i in range(2000)]
    buckets.write(spark.createDataFrame(data, STORED), path, 64)
    return path, {i: (t, d, c) for i, t, d, c in data}


def batch(spark, data):
    return spark.createDataFrame(data, "chunk_id long, content string, doc_type string, batch int")


def test_only_touched_buckets_are_rewritten(spark, store):
    path, want = store
    before = files(path)
    numbers = spark.range(2000).select(F.col("id"), buckets.bucket_of(F.col("id"), 64).alias("b"))
    ids = [r.id for r in numbers.filter("b IN (3, 40)").limit(20).collect()]
    new = [(i, f"new {i}", "case", 1) for i in ids]
    assert buckets.upsert(spark, path, batch(spark, new)) <= 2
    after = files(path)
    same = [f for f, t in before.items() if after.get(f) == t]
    assert len(before) == 64 and len(same) >= 62
    assert all(f"bucket={b}/" not in f for f in same for b in {r.b for r in numbers.filter(F.col("id").isin(ids)).collect()})
    want |= {i: (f"new {i}", "case", "cases") for i in ids}
    assert rows(buckets.read(spark, path)) == want


def test_random_changes_against_a_dict(spark, store):
    path, want = store
    rng = random.Random(1)
    for n in range(3):
        new = [(rng.randint(0, 2100), f"r{n} {k}", rng.choice(["rule", "note", None]), rng.randint(0, 3)) for k in range(60)]
        new += [new[0]] * 3 + [(None, "no id", "rule", 1)]
        buckets.upsert(spark, path, batch(spark, new), per_round=[64, 25, 40][n])
        best = {}
        for i, text, kind, b in new:
            place = (b, text, kind is not None, kind or "")
            if i is not None and (i not in best or place > best[i][0]):
                best[i] = (place, (text, kind, "rules" if kind == "rule" else "knowledge"))
        want |= {i: r for i, (_, r) in best.items()}
        gone = rng.sample(sorted(want), 30)
        buckets.delete(spark, path, spark.createDataFrame([(i,) for i in gone] + [(None,), (-7,)], "chunk_id long"))
        for i in gone:
            del want[i]
        assert rows(buckets.read(spark, path)) == want


def test_emptied_buckets_and_ids_that_are_not_stored(spark, store):
    path, want = store
    before = files(path)
    assert buckets.delete(spark, path, spark.createDataFrame([(-1,), (None,)], "chunk_id long")) == 0
    assert buckets.upsert(spark, path, batch(spark, [])) == 0
    assert files(path) == before
    numbers = spark.range(2000).select(F.col("id").alias("chunk_id"), buckets.bucket_of(F.col("id"), 64).alias("b"))
    gone = numbers.filter("b = 5")
    assert buckets.delete(spark, path, gone) == 1
    left = {r.chunk_id for r in gone.collect()}
    assert rows(buckets.read(spark, path)) == {i: r for i, r in want.items() if i not in left}
    assert len(files(path)) == 63


def test_a_change_that_was_cut_off(spark, store, monkeypatch):
    path, want = store
    apply = buckets._apply

    def dies(spark, at):
        if "_SUCCESS" in runtime.folder_names(spark, f"{at}-change/touched"):
            raise RuntimeError("driver lost")

    monkeypatch.setattr(buckets, "_apply", dies)
    with pytest.raises(RuntimeError):
        buckets.upsert(spark, path, batch(spark, [(7, "seven", "rule", 1)]))
    monkeypatch.setattr(buckets, "_apply", apply)
    # the overwrite had removed a bucket before it was cut off
    number = spark.range(8).select(buckets.bucket_of(F.col("id"), 64).alias("b")).collect()[7].b
    runtime.delete_folder(spark, f"{path}/of=64/bucket={number}")
    assert rows(buckets.read(spark, path)) == want | {7: ("seven", "rule", "rules")}


def test_columns(spark, store):
    path, want = store
    few = spark.createDataFrame([(1, "note", 0)], "chunk_id int, doc_type string, batch int")
    buckets.upsert(spark, path, few)
    assert rows(buckets.read(spark, path)) == want | {1: (None, "note", "knowledge")}
    with pytest.raises(ValueError, match="bucket_name"):
        buckets.upsert(spark, path, few.withColumn("bucket_name", F.lit(1)))


def test_an_id_with_many_rows(spark, store):
    path, want = store
    many = buckets.REPEATS + 500
    new = [(5, f"v{k:05}", "rule", k % 7) for k in range(many)] + [(6, "six", "case", 0)]
    last = max((k % 7, f"v{k:05}") for k in range(many))[1]
    assert buckets.upsert(spark, path, batch(spark, new)) <= 2
    assert rows(buckets.read(spark, path)) == want | {5: (last, "rule", "rules"), 6: ("six", "case", "cases")}
