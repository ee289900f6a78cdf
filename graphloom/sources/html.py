"""HTML pages as tables. The standard parser builds a small tree of each page inside an Arrow-batched function; what
is taken from the tree - links, mails, sections, tables, matrices - comes back as typed structs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_BLANKS = " \t\n\r\f\v"


class Node:
    """An element with its children; strings are text."""

    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        """The elements below in document order, without recursion, so depth is no limit."""
        stack = [iter(self.kids)]
        while stack:
            kid = next(stack[-1], None)
            if kid is None:
                stack.pop()
            elif isinstance(kid, Node):
                yield kid
                stack.append(iter(kid.kids))

    def find(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag in tags)

    def text(self) -> str:
        out, stack = [], [iter(self.kids)]
        while stack:
            kid = next(stack[-1], None)
            if kid is None:
                stack.pop()
            elif isinstance(kid, Node):
                stack.append(iter(kid.kids))
            else:
                out.append(kid)
        return "".join(out).strip(_BLANKS)

    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("", {})]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        # an end closes up to its element; one without an element is passed over
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def parsed(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.open[0]


def anchors_of(html: str) -> list[tuple[str, str]]:
    """(href, text) of the links that have a target."""
    return [(a.attrs["href"], a.text()) for a in parsed(html).find("a") if a.attrs.get("href")]


def message_of(html: str) -> tuple | None:
    """(message_id, subject, from, date, body) of a message page, or None without subject, sender or body."""
    page = parsed(html)
    head: dict[str, str] = {}
    table = next(page.find("table"), None)
    for row in table.find("tr") if table else ():
        name, value = next(row.find("th"), None), next(row.find("td"), None)
        if name and value:
            head[name.text().rstrip(":").lower()] = value.text()
    content = next((x for x in page.find("div") if "message-content" in x.classes()), None)
    body = content.text() if content else ""
    if not (head.get("subject") and head.get("from") and body):
        return None
    return head.get("message-id"), head["subject"], head["from"], head.get("date"), body


def table_text(table: Node) -> str:
    """Cells joined by bars, rows by lines; rows without cells are left out."""
    rows = [[c.text() for c in tr.find("td", "th")] for tr in table.find("tr")]
    return "\n".join(" | ".join(r) for r in rows if r)


def _main(page: Node) -> Node | None:
    wanted = [lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.tag == "div" and "content" in n.classes(), lambda n: n.tag == "div" and n.attrs.get("id") == "content", lambda n: n.tag == "div" and "main" in n.classes(), lambda n: n.tag == "body"]
    return next((n for want in wanted for n in page.walk() if want(n)), None)


def sections_of(html: str, least: int = 50) -> list[tuple[int, str | None, str, list[str]]]:
    """(number, section, text, tables): paragraphs and code blocks of ``least`` characters or more with the heading
    they stand under; a table goes to the item before it."""
    page = _main(parsed(html))
    items, section = [], None
    for x in page.find("h2", "h3", "h4", "p", "pre", "table") if page else ():
        if x.tag in ("p", "pre"):
            text = x.text()
            if len(text) >= least:
                items.append((len(items) + 1, section, text if x.tag == "p" else "[CODE BLOCK]\n" + text, []))
        elif x.tag == "table":
            if items and (text := table_text(x)):
                items[-1][3].append(text)
        else:
            section = x.text() or section
    return items


def contents_of(html: str, base: str = "") -> list[tuple[int, str, str]]:
    """(chapter, title, url) of a contents page: the first link of each chapter, by number."""
    found: dict[int, tuple[int, str, str]] = {}
    for href, text in anchors_of(html):
        number = re.search(r"pgsql(\d+)", href)
        if number and "/index.html" in href:
            title = re.match(r"\d+\.\s*(.+)", text)
            found.setdefault(int(number[1]), (int(number[1]), title[1] if title else text, urljoin(base, href)))
    return [found[k] for k in sorted(found)]


def chapter_pages_of(html: str, url: str) -> list[str]:
    """Addresses of the section pages in the folder of a chapter's index page, sorted, once each."""
    folder = re.search(r"pgsql\d+", url or "")
    if not folder:
        return []
    own = {
        urljoin(url, href)
        for href, _ in anchors_of(html)
        if href.endswith(".html") and not href.endswith("index.html") and not href.startswith(("http", "#")) and (href.startswith("./") or folder[0] in href)
    }
    return sorted(x for x in own if folder[0] in x)


# Cell classes that mean a feature is there.
PRESENT = {"fm_yes", "fm_obs", "fm_new", "fm_dev"}


def _plain(text: str | None) -> str | None:
    return None if text is None else re.sub(r"\s+", " ", text).strip()


def matrix_of(html: str, version: str, base: str = "") -> list[tuple[str, str | None, str | None, str | None]]:
    """(name, category, description, url) of the features that a version has, from matrix tables; the category is the
    heading before the table. A table without the version gives nothing."""
    page, heading, out = parsed(html), None, []
    for x in page.find("h2", "h3", "table"):
        if x.tag != "table":
            heading = _plain(x.text())
            continue
        if "matrix" not in x.classes():
            continue
        head = [c.text() for part in x.find("thead") for c in part.find("th")]
        if version not in head:
            continue
        at = max(0, head.index(version) - 1)  # the first column is the feature's name
        for row in (r for part in x.find("tbody") for r in part.find("tr")):
            title, cells = next(row.find("th"), None), list(row.find("td"))
            name = _plain(re.sub(r"\[\d+\]\s*$", "", title.text())) if title else ""
            if not name or at >= len(cells) or not cells[at].classes() & PRESENT:
                continue
            link = next((a.attrs["href"] for a in title.find("a") if a.attrs.get("href")), None)
            out.append((name, heading, _plain(title.attrs.get("title")), urljoin(base, link) if link else None))
    return out


def _function(schema: str, of: Callable) -> Callable[..., Column]:
    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            yield pd.Series([None if row[0] is None else of(*row) for row in zip(*columns)], dtype=object)

    return run


def _dicts(names: str, of: Callable) -> Callable:
    keys = names.split()
    return lambda *args: [dict(zip(keys, row)) for row in of(*args)]


def anchors(html: Column) -> Column:
    return _function("array<struct<href:string,text:string>>", _dicts("href text", anchors_of))(html)


def message(html: Column) -> Column:
    """Fields of a message page as an array of at most one struct, so an incomplete page explodes to nothing."""
    one = lambda h: [m] if (m := message_of(h)) else []
    return _function("array<struct<message_id:string,subject:string,from:string,date:string,body:string>>", _dicts("message_id subject from date body", one))(html)


def sections(html: Column) -> Column:
    return _function("array<struct<number:int,section:string,text:string,tables:array<string>>>", _dicts("number section text tables", sections_of))(html)


def contents(html: Column, base: Column) -> Column:
    return _function("array<struct<chapter:int,title:string,url:string>>", _dicts("chapter title url", contents_of))(html, base)


def chapter_pages(html: Column, url: Column) -> Column:
    return _function("array<string>", chapter_pages_of)(html, url)


def tables(html: Column) -> Column:
    return _function("array<string>", lambda h: [table_text(t) for t in parsed(h).find("table")])(html)


def matrix(html: Column, version: str, base: str = "") -> Column:
    return _function("array<struct<name:string,category:string,description:string,url:string>>", _dicts("name category description url", lambda h: matrix_of(h, version, base)))(html)
