"""Text functions as native Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
WHITESPACE = " \t\n\r\f\v"
CJK = "一-鿿"
WORD_SPLIT = r"""[\s,，。！？；：、""''（）()\[\]{}<>《》/\\|@#$%^&*+=~`]"""
SOFT_404 = (
    r"(?i)(404|not\s*found|page\s*not\s*found|页面不存在|找不到页面|"
    r"access\s*denied|禁止访问|该页面已删除|内容不存在)"
)
BLOCKLIST = ("spam", "hack")
STOPWORDS = (
    "的 了 是 在 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 "
    "他 她 它 们 那 里 什么 怎么 可以 因为 所以 如果 但是 而且 或者 以及 对于 关于 通过 "
    "需要 进行 可以 根据 按照 应当 必须 可能 已经"
)
# -----------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """Trim whitespace of every kind, not only blanks."""
    return F.btrim(c, F.lit(WHITESPACE))


def grams(run: Column, size: int) -> Column:
    """All parts of ``size`` characters of a text that has as many."""
    starts = F.sequence(F.lit(1), F.length(run) - (size - 1))
    return F.transform(starts, lambda i: F.substring(run, i, F.lit(size)))


def tokenize(c: Column) -> Column:
    """Set of ASCII words (two characters up) and CJK runs; long runs give 2- and 3-grams."""
    low = F.lower(c)
    words = F.regexp_extract_all(low, F.lit("([a-z0-9_]{2,})"), F.lit(1))
    runs = F.regexp_extract_all(low, F.lit(f"([{CJK}]+)"), F.lit(1))
    cjk = F.transform(
        runs,
        lambda r: F.when(F.length(r) <= 3, F.array(r)).otherwise(F.concat(grams(r, 2), grams(r, 3))),
    )
    return F.array_distinct(F.concat(words, F.flatten(cjk)))


def split_words(c: Column) -> Column:
    return F.split(c, WORD_SPLIT)


def keyword_score(query: Column, text: Column, q_tokens: Column | None = None, t_tokens: Column | None = None) -> Column:
    """3 for the whole phrase, 1 per shared token, else 0.5 when a token occurs inside a word. Tokens may be given."""
    q, t = F.lower(query), F.lower(text)
    q_tokens = tokenize(query) if q_tokens is None else q_tokens
    t_tokens = tokenize(text) if t_tokens is None else t_tokens
    phrase = F.when((q != "") & t.contains(q), 3.0).otherwise(0.0)
    shared = F.size(F.array_intersect(q_tokens, t_tokens)).cast("double")
    inside = F.exists(q_tokens, lambda w: (F.length(w) > 1) & t.contains(w))
    base = phrase + shared
    return F.when(base > 0, base).when(inside, 0.5).otherwise(0.0)


def detect_language(c: Column) -> Column:
    ratio = F.length(F.regexp_replace(c, f"[^{CJK}]", "")) / F.length(c)
    return (
        F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "unknown")
        .when(ratio > 0.5, "zh")
        .when(ratio > 0.2, "mixed")
        .otherwise("en")
    )


def is_soft_404(title: Column, text: Column) -> Column:
    return F.concat(title, F.lit("\n"), F.substring(text, 1, 500)).rlike(SOFT_404)


def quality_score(content_length: Column, content_ratio: Column) -> Column:
    length_part = F.least(content_length / F.lit(1500.0), F.lit(1.0))
    ratio_part = F.least(content_ratio / F.lit(0.15), F.lit(1.0))
    return F.round(0.6 * length_part + 0.4 * ratio_part, 3)


def head_tail_summary(c: Column, n: int) -> Column:
    """Text of at most ``n`` characters: the head, three dots and the tail."""
    head = int(n * 0.7)
    tail = n - head - 3
    short = F.concat(F.substring(c, 1, head), F.lit("..."), F.right(c, F.lit(tail)))
    if tail <= 0:
        short = F.concat(F.substring(c, 1, n), F.lit("..."))
    return F.when(F.length(c) <= n, c).otherwise(short)


def snippet(c: Column, n: int = 160) -> Column:
    return F.substring(c, 1, n)


def preview(c: Column, n: int) -> Column:
    """One line of at most ``n`` characters, three dots when the text is longer."""
    line = F.substring(F.regexp_replace(c, "\n", " "), 1, n)
    return F.when(F.length(c) > n, F.concat(line, F.lit("..."))).otherwise(line)


def sanitize_filename(c: Column) -> Column:
    clean = F.regexp_replace(strip(c), r'[<>:"/\\|?*\x00-\x1f]+', "-")
    clean = F.btrim(F.regexp_replace(clean, r"\s+", "-"), F.lit(" .-_"))
    return F.coalesce(F.nullif(F.substring(clean, 1, 64), F.lit("")), F.lit("report"))


def parse_tags(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda t: t != "")


def breadcrumb_parts(path: Column, default: Column) -> Column:
    """Parts of an ``a > b > c`` path; the default title when nothing is left."""
    parts = F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), ">"), strip), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(default))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    """True when one of the words occurs in the text (plain substring test)."""
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def is_safe_text(c: Column, blocklist: tuple[str, ...] = BLOCKLIST) -> Column:
    return ~contains_any(F.lower(c), blocklist)


def content_hash(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def citation_id(url: Column) -> Column:
    return F.concat(F.lit("cit_"), F.substring(content_hash(url), 1, 12))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def iso_timestamp(c: Column) -> Column:
    """ISO text of a timestamp; the fraction is written only when there is one."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
