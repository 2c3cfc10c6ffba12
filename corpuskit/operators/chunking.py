"""Sections, chunks and keywords of one text (helpers), and the Arrow columns that apply them."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.functions.pieces import in_pieces
from corpuskit.functions.text import STOPWORDS, WORD_SPLIT

# --- fixed values -----------------------------------------------------------
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；")
CHUNK_SIZE = 500
CHUNK_OVERLAP = 80
MAX_KEYWORDS = 5
# -----------------------------------------------------------------------------

_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
_FENCE = re.compile(r"```.*?```|~~~.*?~~~", re.DOTALL)
_WORDS = re.compile(WORD_SPLIT)
_STOP = frozenset(STOPWORDS.split())


def markdown_sections(text: str) -> Iterator[tuple[str, str]]:
    """(path, content) of every section with text; a heading cuts the path at its level."""
    path: list[str] = []
    body: list[str] = []
    for line in [*text.split("\n"), None]:
        heading = _HEADING.match(line) if line is not None else None
        if line is not None and heading is None:
            body.append(line)
            continue
        content = "\n".join(body).strip()
        if content:
            yield " > ".join(path), content
        body = []
        if heading is not None:
            path = [*path[: len(heading[1]) - 1], heading[2].strip()]


def _table_ranges(text: str) -> list[tuple[int, int]]:
    """Blocks of two lines up that start with a bar; a separator line does not open a block."""
    ranges, first, last, count, offset = [], 0, 0, 0, 0
    for line in [*text.split("\n"), ""]:
        bare = line.lstrip()
        is_row = bare.startswith("|")
        if is_row and (count or bare.strip().strip("|:- ")):
            if not count:
                first = offset
            count += 1
            last = offset + len(line)
        elif not is_row:
            if count >= 2:
                ranges.append((first, last))
            count = 0
        offset += len(line) + 1
    return ranges


def protected_ranges(text: str) -> list[list[tuple[int, int]]]:
    """Fenced code and tables, which a cut must not split; each list is sorted and disjoint."""
    return [[m.span() for m in _FENCE.finditer(text)], _table_ranges(text)]


def _range_end(kinds: list[list[tuple[int, int]]], at: int) -> int | None:
    """End of the protected range around a position."""
    for ranges in kinds:
        i = bisect_left(ranges, (at,)) - 1
        if i >= 0 and ranges[i][0] < at < ranges[i][1]:
            return ranges[i][1]
    return None


def check_overlap(size: int, overlap: int) -> None:
    if not 0 <= overlap <= size // 2:
        raise ValueError("overlap must be between 0 and half the size")


def chunk_spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Windows of a text longer than ``size``; cuts move back to a separator past half the window."""
    kinds = protected_ranges(text)
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            pushed = _range_end(kinds, end)
            if pushed is not None:
                end = pushed
            else:
                cuts = ((text.rfind(sep, start, end) - start, sep) for sep in SEPARATORS)
                end = next((start + at + len(sep) for at, sep in cuts if at > size * 0.5), end)
        yield start, end
        start = end - overlap


def chunk_texts(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Trimmed, non-blank windows; a text that fits is one chunk as it is."""
    if len(text) <= size:
        return [text]
    parts = (text[s:e].strip() for s, e in chunk_spans(text, size, overlap))
    return [p for p in parts if p]


def top_keywords(text: str, n: int = MAX_KEYWORDS) -> list[str]:
    """Most frequent words of two characters up, ties in order of appearance."""
    words = (w for w in _WORDS.split(text) if len(w) >= 2 and w not in _STOP)
    return [w for w, _ in Counter(words).most_common(n)]


# --- Arrow columns ---

_SECTION = pa.list_(pa.struct([("title_path", pa.string()), ("content", pa.string())]))
SECTION_TYPE = "array<struct<title_path: string, content: string>>"


def sections_column(text: Column) -> Column:
    @F.arrow_udf(SECTION_TYPE)
    def sections(column: pa.Array) -> pa.Array:
        def found(texts: list[str | None]) -> pa.Array:
            return pa.array([[{"title_path": p, "content": c} for p, c in markdown_sections(t or "")] for t in texts], _SECTION)

        return in_pieces(found, _SECTION, column)

    return sections(text)


def chunks_column(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    check_overlap(size, overlap)

    @F.arrow_udf("array<string>")
    def chunks(column: pa.Array) -> pa.Array:
        def found(texts: list[str | None]) -> pa.Array:
            return pa.array([None if t is None else chunk_texts(t, size, overlap) for t in texts], pa.list_(pa.string()))

        return in_pieces(found, pa.list_(pa.string()), column)

    return chunks(text)


def protected_column(text: Column) -> Column:
    """Protected ranges of a text in code points: (kind, start, end), fences first; null and empty texts have none."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("array<struct<kind: string, start: bigint, end: bigint>>")
    def found(column: pa.Array) -> pa.Array:
        rows = []
        for text in column.to_pylist():
            named = zip(("fence", "table"), protected_ranges(text or ""), strict=True)
            rows.append([{"kind": k, "start": a, "end": b} for k, ranges in named for a, b in ranges])
        return pa.array(rows, kind)

    return found(text)


def keywords_column(text: Column, n: int = MAX_KEYWORDS) -> Column:
    @F.arrow_udf("array<string>")
    def keywords(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        return in_pieces(lambda texts: pa.array([top_keywords(t or "", n) for t in texts], kind), kind, column)

    return keywords(text)
