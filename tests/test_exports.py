"""Exports of a file per row: the layout of Spark's writer, whatever the names hold."""

from pathlib import Path

from pyspark.sql import functions as F

from corpuskit import runtime
from corpuskit.sources import sinks

ODD = [("a=b/c:d%", "x", "one"), ("a=b/c:d%", "x", "one again"), (None, "ü 退款", "two"), ("", "[t]^'#{", "three\nlines"), ("u", None, "four"), ("u", "n", "  "), ("ü", "t", "5")]


def odd(spark):
    rows = [(u, t, c, str(i // 2 * 2) if i else "0") for i, (u, t, c) in enumerate(ODD)]
    rows += [("u", "none", "no id", None), (None, "none", "no id either", None)]
    return spark.createDataFrame(rows, "user_id string, title string, content string, file_id string").coalesce(1)


def layout(out):
    found = {}
    for p in Path(out).rglob("part-*.txt"):
        found.setdefault(str(p.parent.relative_to(out)), []).append(sorted(p.read_text().splitlines()))
    return found


def test_files_lie_where_sparks_writer_puts_them(spark, tmp_path, monkeypatch):
    own, sparks = str(tmp_path / "own"), str(tmp_path / "sparks")
    listed = sinks.export_markdown(odd(spark), own)
    monkeypatch.setattr(runtime, "local_folder", lambda *_: None)
    assert sorted(map(str, listed.collect())) == sorted(map(str, sinks.export_markdown(odd(spark), sparks).collect()))
    ascii_only = lambda found: {k: v for k, v in found.items() if k.isascii()}  # noqa: E731  (Java may not know the locale)
    assert ascii_only(layout(own)) == ascii_only(layout(sparks)) and len(layout(own)) == len(layout(sparks)) == 7
    assert (Path(own) / "_SUCCESS").exists()


def test_a_file_costs_a_file_and_reading_few_tasks(spark, tmp_path):
    """No checksum beside each file, no stale file of an earlier export, and no task per few files."""
    out = tmp_path / "out"
    df = spark.range(600).select((F.col("id") % 3).alias("user_id"), F.lit("t").alias("title"), F.concat(F.lit("body "), "id").alias("content"), F.col("id").alias("file_id"))
    for rows in (df, df.filter("id < 500")):
        sinks.export_markdown(rows, str(out))
        assert len([p for p in out.rglob("*") if p.is_file() and "_SUCCESS" not in p.name]) == rows.count()
    found = sinks.read_markdown(spark, str(out))
    assert found.rdd.getNumPartitions() <= sinks.FILE_TASKS * spark.sparkContext.defaultParallelism
    got = {(r.user_id, r.file_name, r.value) for r in found.collect()}
    assert got == {(str(i % 3), f"t-{i}.md", f"# t\n\nbody {i}\n") for i in range(500)} and found.count() == 500


def test_names_come_back(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.export_markdown(odd(spark), out)
    got = {(r.user_id, r.file_name) for r in sinks.read_markdown(spark, out).collect()}
    want = {(r.user_id or None, r.file_name) for r in sinks.markdown_files(odd(spark)).collect()}
    assert got == want
    assert sinks.export_markdown(odd(spark).limit(0), out).count() == 0 and sinks.read_markdown(spark, out).count() == 0
