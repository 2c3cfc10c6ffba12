import uuid

import pytest


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """A shared folder for tables between steps, unless the session has one."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        folder = str(tmp_path_factory.mktemp("shared"))
        spark.conf.set("spark.checkpoint.dir", folder)
    return spark.conf.get("spark.checkpoint.dir")


@pytest.fixture(autouse=True)
def _shared(shared):
    return shared


@pytest.fixture
def documents(spark):
    """Make a documents table from (doc_id, text) or (doc_id, text, lang, source), with columns of clashing names."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        if extra:
            from pyspark.sql import functions as F

            for name in CLASHES:
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


CLASHES = "key rep n a b kind component_id group_size keep_id spans start shard bin_id score features unit _text ids part".split()


@pytest.fixture
def folder(shared):
    return f"{shared}/{uuid.uuid4().hex}"
