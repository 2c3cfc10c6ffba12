"""Sources: text folders, structured JSON documents and stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit import runtime

TEXT_SUFFIXES = ("md", "txt")

JSON_DOC = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("doc_type", T.StringType()),
        T.StructField(
            "sections",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("heading", T.StringType()),
                        T.StructField("content", T.StringType()),
                        T.StructField("tags", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)


def decoded(path: Column) -> Column:
    """File path as it is named; Spark gives it percent-encoded, where a plus sign stands for itself."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _file_columns() -> dict:
    name = F.regexp_extract("source", r"([^/]+)$", 1)
    return {
        "doc_id": F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""),
        "extension": F.lower(F.regexp_extract(name, r".(\.[^.]*)$", 1)),
    }


def scan_text_dir(spark: SparkSession, path: str, recursive: bool = True, domain: str = "general") -> DataFrame:
    """One row per text file of a folder, or of a single named file of any type."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive or None).select(
        F.col("value").alias("text"), decoded(F.col("_metadata.file_path")).alias("source")
    )
    files = files.withColumns(_file_columns()).withColumn("domain", F.lit(domain))
    named = F.col("source").endswith("/" + path.rstrip("/").rsplit("/", 1)[-1])
    return files.filter(F.lower("source").rlike(rf"\.({'|'.join(TEXT_SUFFIXES)})$") | named)


def section_path(title: Column, heading: Column) -> Column:
    """Title and heading of a section, as far as they are filled."""
    title, heading = F.coalesce(title, F.lit("")), F.coalesce(heading, F.lit(""))
    both = F.concat(title, F.lit(" > "), heading)
    return F.when((title != "") & (heading != ""), both).otherwise(F.concat(title, heading))


def scan_json_docs(
    spark: SparkSession,
    path: str,
    multiline: bool = True,
    default_domain: str = "general",
    default_doc_type: str = "knowledge",
) -> DataFrame:
    """One row per non-empty section of structured documents (a file each, or one per line).

    ``doc_key`` tells the documents of one file apart. Of documents that a file repeats word for word the first keeps the
    key of its content and every further one has a key of its own, whatever the number of splits.
    """
    docs = (
        spark.read.schema(JSON_DOC)
        .option("multiLine", multiline)
        .option("recursiveFileLookup", True)
        .json(path)
        .select("*", decoded(F.col("_metadata.file_path")).alias("source"))
    )
    docs = docs.withColumns(
        {"doc_key": F.xxhash64("title", "domain", "doc_type", "sections"), "_row": F.monotonically_increasing_id()}
    )
    docs = runtime.ranked(docs, ["source", "doc_key"], [F.col("_row")], "_copy")
    own = F.when(F.col("_copy") == 1, F.col("doc_key")).otherwise(F.xxhash64("doc_key", "_copy"))
    docs = docs.withColumn("doc_key", own).drop("_row", "_copy")
    return (
        docs.select("*", F.posexplode("sections").alias("section_index", "s"))
        .filter(F.coalesce("s.content", F.lit("")) != "")
        .withColumns(_file_columns())
        .select(
            "source",
            "doc_id",
            "doc_key",
            "section_index",
            section_path(F.col("title"), F.col("s.heading")).alias("title_path"),
            F.col("s.content").alias("content"),
            F.coalesce("s.tags", F.array().cast("array<string>")).alias("tags"),
            F.coalesce("domain", F.lit(default_domain)).alias("domain"),
            F.coalesce("doc_type", F.lit(default_doc_type)).alias("doc_type"),
        )
    )


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored raw pages (page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")
