"""Main content of an HTML page: title, plain text, Markdown and links (helper for the page operators)."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.functions.pieces import in_pieces

# --- fixed values -----------------------------------------------------------
DROPPED_TAGS = frozenset(
    "script style noscript iframe svg canvas nav footer header aside form button".split()
)
NOISE = re.compile(
    r"(?i)(nav|menu|sidebar|footer|header|banner|advert|cookie|subscribe|newsletter|social|share|comment|"
    r"related|recommend|popup|modal|breadcrumb|pagination)"
)
CONTENT_SELECTORS = (
    "article", "main", "[role='main']", ".post-content", ".article-content", ".entry-content",
    ".content", "#content", ".post-body", ".article-body",
)
MIN_CONTENT = 200
# -----------------------------------------------------------------------------

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset(
    "address article aside blockquote center details dir div dl dd dt fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main menu nav ol p pre section table td th tr ul".split()
)
# start tag -> (tags it closes, tags that stop the search for them)
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "body": (("head",), ()),
}
_P_SCOPE = ("td", "th", "table", "li", "button", "body", "html")


class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag = tag
        self.attrs = attrs
        self.children: list[_Node | str] = []

    def nodes(self):
        """This node and the nodes below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))

    def raw_strings(self):
        stack: list[_Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            else:
                stack.extend(reversed(item.children))

    def strings(self):
        return [s for s in map(str.strip, self.raw_strings()) if s]

    def text(self) -> str:
        return "".join(self.strings())

    def find(self, tag: str) -> _Node | None:
        return next((n for n in self.nodes() if n.tag == tag), None)


class _Builder(HTMLParser):
    """Tree of a page; missing end tags are implied, unknown end tags ignored, comments left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]
        self.count: Counter[str] = Counter()
        self.in_text = False

    def _close(self, tags, stops) -> None:
        # without such a tag open there is nothing to look for: stray end tags stay cheap
        if not any(self.count[tag] for tag in tags):
            return
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at].tag
            if tag in tags:
                self.count.subtract(node.tag for node in self.open[at:])
                del self.open[at:]
                return
            if tag in stops:
                return

    def handle_starttag(self, tag, attrs):
        self.in_text = False
        if tag in _ENDS_P:
            self._close(("p",), _P_SCOPE)
        if tag in _ENDS:
            closes, stops = _ENDS[tag]
            for _ in closes:
                self._close(closes, stops)
        node = _Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.count[self.open.pop().tag] -= 1

    def handle_endtag(self, tag):
        self.in_text = False
        self._close((tag,), ())

    def handle_data(self, data):
        siblings = self.open[-1].children
        if self.in_text and siblings and isinstance(siblings[-1], str):
            siblings[-1] += data
        else:
            siblings.append(data)
        self.in_text = True

    def handle_comment(self, data):
        self.in_text = False


def _tree(html: str) -> _Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _title(root: _Node) -> str:
    title = root.find("title")
    if title is not None and len(title.children) == 1 and isinstance(title.children[0], str) and title.children[0]:
        return title.children[0].strip()
    heading = root.find("h1")
    if heading is not None:
        return heading.text()
    named = (n.attrs.get("content") for n in root.nodes() if n.tag == "meta" and n.attrs.get("property") == "og:title")
    return (next(named, "") or "").strip()


def _is_noise(node: _Node) -> bool:
    if node.tag in DROPPED_TAGS:
        return True
    classes = " ".join(node.attrs.get("class", "").split())
    return bool(NOISE.search(f"{classes} {node.attrs.get('id', '')}"))


def _drop_noise(root: _Node) -> None:
    for node in root.nodes():
        node.children = [c for c in node.children if isinstance(c, str) or not _is_noise(c)]


def _selects(selector: str, node: _Node) -> bool:
    if selector.startswith("."):
        return selector[1:] in node.attrs.get("class", "").split()
    if selector.startswith("#"):
        return node.attrs.get("id") == selector[1:]
    if selector.startswith("["):
        return node.attrs.get("role") == "main"
    return node.tag == selector


def _content(root: _Node) -> _Node:
    """First container with enough text, else the body."""
    first: dict[str, _Node] = {}
    for node in root.nodes():
        for selector in CONTENT_SELECTORS:
            if selector not in first and _selects(selector, node):
                first[selector] = node
    for selector in CONTENT_SELECTORS:
        if selector in first and len(first[selector].text()) > MIN_CONTENT:
            return first[selector]
    body = root.find("body")
    if body is None:
        body = _Node("body", {})
        body.children = [c for c in root.children if isinstance(c, str) or c.tag not in ("head", "title")]
    return body


def _links(content: _Node, base: str) -> list[dict[str, str]]:
    found = []
    for node in content.nodes():
        if node.tag != "a" or "href" not in node.attrs:
            continue
        href = node.attrs["href"]
        if base:
            try:
                href = urljoin(base, href)
            except ValueError:
                continue
        text = node.text()
        if text and href:
            found.append({"text": text, "href": href})
    return found


def _table_lines(table: _Node) -> list[str]:
    lines = [""]
    for at, row in enumerate(n for n in table.nodes() if n.tag == "tr"):
        cells = [n.text() for n in row.nodes() if n.tag in ("th", "td")]
        if cells:
            lines.append(f"| {' | '.join(cells)} |")
            if at == 0:
                lines.append(f"| {' | '.join(['---'] * len(cells))} |")
    return [*lines, ""] if len(lines) > 1 or table.find("tr") else []


def _list_lines(node: _Node) -> list[str]:
    items = [c.text() for c in node.children if isinstance(c, _Node) and c.tag == "li"]
    ordered = node.tag == "ol"
    return ["", *[f"{f'{i}.' if ordered else '-'} {t}" for i, t in enumerate(items, 1) if t], ""]


def _block(node: _Node) -> list[str] | None:
    """Markdown lines of an element, or None for a container whose children are rendered."""
    tag = node.tag
    if re.fullmatch("h[1-6]", tag):
        text = node.text()
        return [f"\n{'#' * int(tag[1])} {text}\n"] if text else []
    if tag == "p":
        text = node.text()
        return [f"\n{text}\n"] if text else []
    if tag in ("ul", "ol"):
        return _list_lines(node)
    if tag == "pre":
        return [f"\n```\n{''.join(node.raw_strings()).strip()}\n```\n"]
    if tag == "code":
        text = "".join(node.raw_strings())
        return [f"`{text}`"] if text else []
    if tag == "blockquote":
        text = node.text()
        return [*[f"> {line}" for line in text.split("\n")], ""] if text else []
    if tag == "table":
        return _table_lines(node)
    if tag == "img":
        src = node.attrs.get("src", "")
        return [f"![{node.attrs.get('alt', '')}]({src})"] if src else []
    if tag == "a":
        text, href = node.text(), node.attrs.get("href", "")
        return [f"[{text}]({href})"] if text and href else []
    if tag == "br":
        return [""]
    if tag == "hr":
        return ["\n---\n"]
    return None


def _markdown(content: _Node) -> str:
    lines: list[str] = []
    stack: list[_Node | str] = [content]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            if item.strip():
                lines.append(item.strip())
            continue
        block = _block(item)
        if block is None:
            stack.extend(reversed(item.children))
        else:
            lines.extend(block)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def extract_page(html: str, base: str = "") -> dict:
    """Title, text, Markdown and links of one page."""
    if not html:
        return {"title": "", "markdown": "", "text": "", "links": [], "error": None}
    try:
        root = _tree(html)
        title = _title(root)
        _drop_noise(root)
        content = _content(root)
        return {
            "title": title,
            "markdown": _markdown(content),
            "text": " ".join(content.strings()),
            "links": _links(content, base),
            "error": None,
        }
    except Exception as e:  # noqa: BLE001 - one broken page must not fail the job
        return {"title": "", "markdown": "", "text": "", "links": [], "error": f"{type(e).__name__}: {e}"}


_PAGE = pa.struct(
    [
        ("title", pa.string()),
        ("markdown", pa.string()),
        ("text", pa.string()),
        ("links", pa.list_(pa.struct([("text", pa.string()), ("href", pa.string())]))),
        ("error", pa.string()),
    ]
)
PAGE_TYPE = "title string, markdown string, text string, links array<struct<text: string, href: string>>, error string"


def page_column(html: Column, base: Column) -> Column:
    """``extract_page`` per Arrow batch, as a struct column."""

    @F.arrow_udf(PAGE_TYPE)
    def extract(pages: pa.Array, bases: pa.Array) -> pa.Array:
        def found(htmls: list[str | None], urls: list[str | None]) -> pa.Array:
            return pa.array([extract_page(h or "", b or "") for h, b in zip(htmls, urls, strict=True)], _PAGE)

        return in_pieces(found, _PAGE, pages, bases)

    return extract(html, base)
