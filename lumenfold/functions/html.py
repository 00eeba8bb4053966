"""HTML pages: a small tolerant tree, and what is taken from it. Arrow batches, one page at a time."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening the first closes an open one of the second, as browsers do.
CLOSES = {x: ("p",) for x in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()} | {
    "li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
LIMITS = frozenset("ul ol table tbody thead tr td th div article section body html blockquote".split())


class Node:
    __slots__ = ("attrs", "items", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.items = tag, attrs, []

    def walk(self, skip: frozenset = frozenset()) -> Iterator[Node]:
        """Elements below, in document order, without those of a tag in `skip`."""
        todo = list(reversed(self.items))
        while todo:
            x = todo.pop()
            if isinstance(x, Node) and x.tag not in skip:
                yield x
                todo += reversed(x.items)

    def strings(self, skip: frozenset = frozenset()) -> Iterator[str]:
        todo = list(reversed(self.items))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in skip:
                todo += reversed(x.items)

    def text(self, joint: str = " ", skip: frozenset = frozenset()) -> str:
        return joint.join(y for x in self.strings(skip) if (y := x.strip()))

    def first(self, test, skip: frozenset = frozenset()) -> Node | None:  # noqa: ANN001
        return next((x for x in self.walk(skip) if test(x)), None)


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for old in CLOSES.get(tag, ()):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == old:
                    del self.open[k:]
                    break
                if self.open[k].tag in LIMITS and old != "p":
                    break
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].items.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].items.append(data)


class Terminated(Builder):
    """Takes only character references that end in a semicolon for such; `held` stands for the ampersands of all else."""

    def __init__(self, held: str) -> None:
        super().__init__()
        self.held = held

    def handle_starttag(self, tag: str, attrs: list) -> None:
        super().handle_starttag(tag, [(k, v and v.replace(self.held, "&")) for k, v in attrs])

    def handle_data(self, data: str) -> None:
        super().handle_data(data.replace(self.held, "&"))


REFERENCE = re.compile(r"&(?:([^\t\n\f <&;]{1,32});)?")
#: Code points that are no characters: one that a page lacks can stand for another.
SPARE = [chr(x) for x in range(0xFDD0, 0xFDF0)]


def tree(html: str, terminated: bool = False) -> Node:
    """terminated: "&amp" without its semicolon stays as it is; browsers take it for "&"."""
    if terminated and "&" in html:
        held = next(x for x in SPARE if x not in html)
        known = lambda m: m[1] and (m[1][0] == "#" or f"{m[1]};" in html5)
        html, builder = REFERENCE.sub(lambda m: m[0] if known(m) else held + m[0][1:], html), Terminated(held)
    else:
        builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.root


# Why a page gives no article.
NO_HTML, NO_TITLE, NO_CONTENT = "原始 HTML 为空", "未能提取标题", "未能提取有效正文"
#: Years that a timestamp of a pandas batch can hold for sure; a date beyond them is no date of publication.
FIRST_YEAR, LAST_YEAR = 1678, 2261
STRIP = frozenset(rules.STRIPPED_TAGS)
CODE = frozenset(("script", "style"))
CONTAINERS = [
    lambda x: x.tag == "article", lambda x: x.attrs.get("itemprop") == "articleBody", *[(lambda c: lambda x: x.tag == "div" and c in x.attrs.get("class", "").split())(c) for c in ("post-content", "entry-content", "article-content")], lambda x: x.tag == "main",
]


def meta(root: Node, **want: str) -> str | None:
    node = root.first(lambda x: x.tag == "meta" and all(x.attrs.get(k) == v for k, v in want.items()))
    return (node.attrs.get("content") or "").strip() or None if node else None


def structured(root: Node) -> dict:
    """All JSON-LD objects of the page as one; the first value of a key counts. Broken scripts are passed over."""
    out: dict = {}
    for node in root.walk():
        if node.tag == "script" and node.attrs.get("type") == "application/ld+json":
            try:
                data = json.loads("".join(node.strings()))
            except ValueError:
                continue
            graph = data.get("@graph") if isinstance(data, dict) else data
            for item in graph if isinstance(graph, list) else [data]:
                if isinstance(item, dict):
                    out = item | out
    return out


def said(data: dict, key: str) -> str | None:
    return value.strip() or None if isinstance(value := data.get(key), str) else None


def title_of(root: Node) -> str | None:
    for want in ({"property": "og:title"}, {"name": "og:title"}, {"name": "twitter:title"}):
        if value := meta(root, **want):
            return value
    page = (node.text("") if (node := root.first(lambda x: x.tag == "title")) else "") or None
    head = node.text("") if (node := root.first(lambda x: x.tag == "h1")) else ""
    if not head:
        return page
    rest = page[len(head) :].lstrip() if page and page.startswith(head) else ""
    return (rest[1:].strip() if rest[:1] in (":", "：") and rest else "") or head


def content_of(root: Node) -> str:
    container = next((x for test in CONTAINERS if (x := root.first(test, STRIP))), None) or root.first(lambda x: x.tag == "body", STRIP) or root
    blocks = [y for x in container.walk(STRIP) if x.tag in rules.BLOCK_TAGS and (y := x.text(" ", STRIP))]
    lines = "\n\n".join(blocks or [container.text(" ", STRIP)]).splitlines()
    return "\n\n".join(y for x in lines if (y := x.strip()))


def moment(value: str | None):  # noqa: ANN201
    from dateutil import parser

    try:
        return parser.parse(value) if value else None
    except (ValueError, OverflowError):
        return None


def published_of(root: Node, data: dict):  # noqa: ANN201
    wants = [{"property": "article:published_time"}, {"property": "og:published_time"}, {"name": "article:published_time"}, {"itemprop": "datePublished"}, {"name": "pubdate"}, {"name": "date"}]
    node = root.first(lambda x: x.tag == "time")
    tries = [*(meta(root, **w) for w in wants), (node.attrs.get("datetime") or node.text("")) if node else None, said(data, "datePublished")]
    return next((y for x in tries if (y := moment(x)) is not None), None)


def author_of(root: Node, data: dict) -> str | None:
    for want in ({"name": "author"}, {"property": "article:author"}, {"name": "article:author"}):
        if value := meta(root, **want):
            return value
    author = data.get("author")
    name = author.get("name") if isinstance(author, dict) else author
    return str(name).strip() or None if name and isinstance(author, dict | str) else None


def parse_page(html: str | None, terminated: bool = False) -> dict:
    out = dict.fromkeys(("title", "content", "published_at", "author", "error"))
    if not html or not html.strip():
        return out | {"error": NO_HTML}
    root = tree(html, terminated)
    data = structured(root)
    title = title_of(root) or said(data, "headline")
    if not title:
        return out | {"error": NO_TITLE}
    content = content_of(root)
    if len(content) < rules.LEAST_CONTENT:
        return out | {"error": NO_CONTENT}
    when = published_of(root, data)
    if when is not None and not FIRST_YEAR <= when.year <= LAST_YEAR:
        when = None
    if when is not None and when.tzinfo is None:
        from datetime import UTC

        when = when.replace(tzinfo=UTC)
    return out | {"title": title.strip(), "content": content, "published_at": pd.Timestamp(when).tz_convert("UTC").tz_localize(None) if when is not None else None, "author": author_of(root, data)}


def parse_safely(html: str | None, terminated: bool = False) -> dict:
    """parse_page(), but a page that breaks the parser has an error like any other; it never stops the job."""
    try:
        return parse_page(html, terminated)
    except Exception as e:  # noqa: BLE001
        return dict.fromkeys(("title", "content", "published_at", "author")) | {"error": f"{type(e).__name__}: {e}"}


PARSED = T.StructType([T.StructField(x, T.TimestampType() if x == "published_at" else T.StringType()) for x in ("title", "content", "published_at", "author", "error")])
LINKS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(PARSED)
def _parse(html: pd.Series, terminated: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([parse_safely(x, t) for x, t in zip(html, terminated, strict=True)], columns=["title", "content", "published_at", "author", "error"])
    out["published_at"] = pd.to_datetime(out["published_at"])
    return out


def parse_html(html: Column, terminated: bool = False) -> Column:
    """struct(title, content, published_at, author, error); error says why there is no article. terminated: see tree()."""
    return _parse(html, F.lit(terminated))


@F.pandas_udf(T.StringType())
def _title(html: pd.Series, terminated: pd.Series) -> pd.Series:
    out = []
    for page, t in zip(html, terminated, strict=True):
        try:
            root = tree(page, t) if page is not None else None
            out.append(None if root is None else (title_of(root) or said(structured(root), "headline") or "").strip())
        except Exception:  # noqa: BLE001
            out.append("")
    return pd.Series(out, dtype="object")


def page_title(html: Column, terminated: bool = False) -> Column:
    """The title of any page, also of one without content for an article; empty for a page that has none or breaks the
    parser, null for no page."""
    return _title(html, F.lit(terminated))


def link_ratio_of(html: str | None, terminated: bool = False) -> float:
    try:
        root = tree(html or "", terminated)
    except Exception:  # noqa: BLE001
        return 1.0
    total = len(root.text(" ", CODE))
    return sum(len(x.text(" ", CODE)) for x in root.walk(CODE) if x.tag == "a") / total if total else 1.0


@F.pandas_udf(T.DoubleType())
def _link_ratio(html: pd.Series, terminated: pd.Series) -> pd.Series:
    return pd.Series([link_ratio_of(x, t) for x, t in zip(html, terminated, strict=True)], dtype="float64")


def link_text_ratio(html: Column, terminated: bool = False) -> Column:
    """Characters of link texts by those of the whole page without scripts; 1 for a page without text and one that breaks
    the parser."""
    return _link_ratio(html, F.lit(terminated))


@F.pandas_udf(LINKS)
def _links(html: pd.Series, base: pd.Series, terminated: pd.Series) -> pd.Series:
    out = []
    for page, own, t in zip(html, base, terminated, strict=True):
        found = []
        try:
            root = tree(page or "", t)
        except Exception:  # noqa: BLE001
            out.append(None)
            continue
        for x in root.walk():
            href = x.attrs.get("href", "").strip() if x.tag == "a" else ""
            if href and not href.startswith(rules.SKIPPED_LINKS):
                try:
                    url = urldefrag(urljoin(own or "", href))[0]
                    if urlparse(url).scheme in ("http", "https"):
                        found.append({"pos": len(found), "url": url, "text": x.text()})
                except ValueError:
                    continue
        out.append(found)
    return pd.Series(out)


def page_links(html: Column, base: Column, terminated: bool = False) -> Column:
    """Web links of a page in document order, absolute and without fragments; null for a page that breaks the parser."""
    return _links(html, base, F.lit(terminated))
