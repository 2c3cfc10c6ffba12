"""Named SQL functions with parameter schemas, for use in ``spark.sql``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from corpuskit.operators import chunking as K
from corpuskit.operators import html as H
from corpuskit.operators.embedding import _fingerprint


@dataclass(frozen=True)
class SqlFunction:
    """A text function. Its SQL form returns ``struct<value, error>``: a failure is a value."""

    name: str
    description: str
    value_type: str
    arrow_type: pa.DataType
    run: Callable


def _parameters(fn: SqlFunction) -> dict:
    return {"type": "object", "properties": {"text": {"type": "string"}}, "required": ["text"]}


FUNCTIONS = (
    SqlFunction("ck_chunks", "Chunks of a text", "array<string>", pa.list_(pa.string()), K.chunk_texts),
    SqlFunction("ck_keywords", "Most frequent words of a text", "array<string>", pa.list_(pa.string()), K.top_keywords),
    SqlFunction("ck_simhash", "64-bit SimHash of a text", "bigint", pa.int64(), lambda t: _fingerprint(t.lower())),
    SqlFunction("ck_page_text", "Plain text of an HTML page", "string", pa.string(), lambda h: H.extract_page(h)["text"]),
)

# Functions that need no Python: SQL bodies that Catalyst inlines.
SQL_BODIES = {
    "ck_citation_id": ("url STRING", "STRING", "concat('cit_', substring(sha2(url, 256), 1, 12))"),
    "ck_url_host": ("url STRING", "STRING", r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"),
    "ck_hamming": ("a BIGINT, b BIGINT", "INT", "bit_count(a ^ b)"),
    "ck_snippet": ("t STRING, n INT", "STRING", "substring(t, 1, n)"),
}


def _as_udf(fn: SqlFunction):
    run, arrow_type = fn.run, pa.struct([("value", fn.arrow_type), ("error", pa.string())])

    @F.arrow_udf(f"struct<value: {fn.value_type}, error: string>")
    def call(column: pa.Array) -> pa.Array:
        rows = []
        for text in column.to_pylist():
            try:
                rows.append({"value": run(text), "error": None})
            except Exception as e:  # noqa: BLE001 - the error is the result of this row
                rows.append({"value": None, "error": f"{type(e).__name__}: {e}"})
        return pa.array(rows, arrow_type)

    return call


@udtf(returnType="section_index: int, title_path: string, content: string")
class MarkdownSections:
    """Table function: the sections of a Markdown text."""

    def eval(self, text: str) -> Iterator[tuple]:
        for i, (path, content) in enumerate(K.markdown_sections(text or "")):
            yield i, path, content


@udtf(returnType="chunk_index: int, content: string")
class TextChunks:
    """Table function: the chunks of a text."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        K.check_overlap(size, overlap)
        yield from enumerate(K.chunk_texts(text or "", size, overlap))


def register_all(spark: SparkSession, user_id: int | str | None = None) -> list[dict]:
    """Register every function and return their schemas.

    ``ck_user_id()`` returns the user of the session, for the tenant filter of SQL queries.
    """
    for fn in FUNCTIONS:
        spark.udf.register(fn.name, _as_udf(fn))
    for name, (arguments, result, body) in SQL_BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udtf.register("ck_sections", MarkdownSections)
    spark.udtf.register("ck_text_chunks", TextChunks)
    # hexadecimal, so that no character of an id can end the literal
    owner = "CAST(NULL AS STRING)" if user_id is None else f"decode(X'{str(user_id).encode().hex()}', 'UTF-8')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ck_user_id() RETURNS STRING RETURN {owner}")
    return [{"name": f.name, "description": f.description, "parameters": _parameters(f)} for f in FUNCTIONS]
