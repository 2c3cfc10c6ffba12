"""Hand-computed cases of the text, URL, HTML and chunking rules."""

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import json_columns as J
from corpuskit.functions import text as X
from corpuskit.functions import urls as U
from corpuskit.functions import vectors as V
from corpuskit.operators import chunking as K
from corpuskit.operators import topk
from corpuskit.operators.embedding import count_vectors
from corpuskit.operators.html import extract_page


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_tokenize(spark):
    text = "Hello 退款规则说明 ok a"
    run = "退款规则说明"
    grams = {run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1)}
    assert set(value(spark, X.tokenize(F.lit(text)))) == {"hello", "ok"} | grams
    assert topk._tokens(text.lower()) == {"hello", "ok"} | grams


@pytest.mark.parametrize(
    "text, expected", [("中" * 6 + "abcd", "zh"), ("中" * 3 + "abcdefg", "mixed"), ("abc", "en"), ("", "unknown")]
)
def test_detect_language(spark, text, expected):
    assert value(spark, X.detect_language(F.lit(text))) == expected


def test_scores_and_summaries(spark):
    assert value(spark, X.quality_score(F.lit(750), F.lit(0.075))) == 0.5
    assert value(spark, X.head_tail_summary(F.lit("x" * 200), 100)) == "x" * 70 + "..." + "x" * 27
    assert value(spark, X.keyword_score(F.lit("red fox"), F.lit("The Red Fox ran"))) == 5.0
    assert value(spark, X.keyword_score(F.lit("zzz fo"), F.lit("foxes"))) == 0.5
    assert value(spark, X.keyword_score(F.lit("zzz"), F.lit("foxes"))) == 0.0
    assert value(spark, X.sanitize_filename(F.lit(' a: b/c?  "d" '))) == "a--b-c---d"
    assert value(spark, X.sanitize_filename(F.lit(" -._ "))) == "report"


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTP://User@Ex.COM:80/a/b/?b=2&a=1&c=#f", "http://ex.com/a/b?a=1&b=2"),
        ("https://ex.com:8443", "https://ex.com:8443/"),
        ("https://ex.com/x%20y/?q=a+b%2Ac&q=%7E1", "https://ex.com/x%20y?q=a+b%2Ac&q=~1"),
        ("https://ex.com/?utm_source=z&a", "https://ex.com/?utm_source=z"),
    ],
)
def test_canonicalize_url(spark, url, expected):
    assert value(spark, U.canonicalize_url(F.lit(url))) == expected


def test_json_defaults(spark):
    assert value(spark, J.safe_json_list(F.lit('{"a": 1}'))) == []
    assert value(spark, J.safe_json_list(F.lit("[1, {\"a\": 2}"))) == []
    assert value(spark, J.safe_json_object(F.lit("[1]"))) == {}
    assert value(spark, J.safe_json_object(F.lit(None).cast("string"))) == {}


def test_vectors(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    one = F.array(F.lit(3.0), F.lit(4.0))
    assert value(spark, V.l2_normalize(zero)) == [0.0, 0.0]
    assert value(spark, V.l2_normalize(one)) == [0.6, 0.8]
    assert value(spark, V.cosine_clipped(zero, one)) == 0.0
    assert value(spark, V.cosine_clipped(one, F.array(F.lit(-3.0), F.lit(-4.0)))) == 0.0


def test_count_vectors_match_the_definition():
    import hashlib

    texts = ["", "ab", "abcé 中文字", "a b", "same same"]
    for text, row in zip(texts, count_vectors(texts)):
        expected = [0] * 384
        for g in [text[i : i + 3] for i in range(len(text) - 2)] + text.split():
            expected[int(hashlib.md5(g.encode()).hexdigest(), 16) % 384] += 1
        assert list(row) == expected


def test_markdown_sections():
    found = list(K.markdown_sections("# A\n### B\nx\n### C\ny\n### D\nz"))
    assert found == [("A > B", "x"), ("A > B > C", "y"), ("A > B > D", "z")]
    assert list(K.markdown_sections("intro\n# A\n \n## B\nt")) == [("", "intro"), ("A > B", "t")]


def test_chunk_spans():
    assert list(K.chunk_spans("a" * 1000, 500, 80)) == [(0, 500), (420, 920), (840, 1340)]
    assert [len(c) for c in K.chunk_texts("a" * 1000, 500, 80)] == [500, 500, 160]
    assert [len(c) for c in K.chunk_texts("a" * 1050, 600, 120)] == [600, 570, 90]
    assert K.chunk_texts("  short ", 500, 80) == ["  short "]


def test_chunk_separators_fences_and_tables():
    assert K.chunk_texts("a" * 60 + "。" + "b" * 60, 100, 0)[0] == "a" * 60 + "。"
    fenced = "x" * 80 + "```" + "y" * 60 + "```" + "z" * 60
    assert K.chunk_texts(fenced, 100, 0)[0] == "x" * 80 + "```" + "y" * 60 + "```"
    table = "p" * 80 + "\n| a | b |\n|---|---|\n| 1 | 2 |\n" + "q" * 80
    assert K.chunk_texts(table, 100, 0)[0].endswith("| 1 | 2 |")
    assert K.protected_ranges("|---|\nno")[1] == []
    with pytest.raises(ValueError):
        K.check_overlap(100, 51)


def test_keywords():
    assert K.top_keywords("bb aa bb, cc aa 的 x 一个 dd") == ["bb", "aa", "cc", "dd"]


PAGE = """<html><head><title> T &amp; t </title></head><body><nav>menu</nav><div class="share-box">no</div>
<article><h1>Head</h1><p>One<b>two</b><p>Three &lt;x&gt;<ul><li>a<li>b</ul><ol><li>c</li></ol>
<pre>  code\n x </pre><blockquote>q</blockquote><table><tr><th>h</th><th>i</th></tr><tr><td>1<td>2</table>
<img alt="A" src="s.png"><a href="/l?x=1">link</a><hr><!-- c -->%s</article><footer>f</footer></body></html>"""


def test_extract_page():
    page = extract_page(PAGE % ("w" * 220), "https://ex.com/d/p")
    assert page["title"] == "T & t"
    assert page["links"] == [{"text": "link", "href": "https://ex.com/l?x=1"}]
    assert page["text"].startswith("Head One two Three <x> a b c code")
    assert "menu" not in page["text"] and "no" not in page["text"].split()
    markdown = page["markdown"]
    for part in ("# Head", "Onetwo", "Three <x>", "- a\n- b", "1. c", "```\ncode\n x\n```", "> q",
                 "| h | i |\n| --- | --- |\n| 1 | 2 |", "![A](s.png)", "[link](/l?x=1)", "---"):
        assert part in markdown, part
    assert "\n\n\n" not in markdown


def test_extract_page_fallbacks():
    assert extract_page("")["text"] == ""
    assert extract_page("<h1>Only <i>this</i></h1>")["title"] == "Onlythis"
    meta = extract_page('<meta property="og:title" content=" M "><article>short</article><p>body')
    assert meta["title"] == "M" and meta["text"] == "short body"
    deep = extract_page("<div>" * 5000 + "x" * 300)
    assert deep["error"] is None and deep["text"] == "x" * 300
