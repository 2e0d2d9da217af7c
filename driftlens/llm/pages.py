"""HTML extraction: the visible text of a page, laid out as it would show.

A tree builder reads the markup in one pass: it closes elements whose end tags
are implied (paragraphs before blocks, items before items, cells and rows), closes
what an end tag leaves open inside, and ignores end tags without a start.
Elements that do not show (head, scripts, styles, templates, noscript, choices of
a datalist, what stands in for embedded media, hidden ones) give no text. Hidden
are elements with the attribute hidden, or whose own style says so, with all that
lies in them; style sheets are not read. Of drawings (svg) the text elements and
embedded HTML show, each text on a line, but no definitions, and of formulas
(math) all but annotations and phantoms. The tree is laid out: blocks start lines, paragraphs, headings, lists and
tables are set off by a blank line, list items carry a mark or number and are
indented by depth, and the cells of a table are padded to columns. All visible
text is kept, navigation and footers included.

A null or empty page gives an empty text. Nesting of any depth is handled without
recursion. Cells wider than ``CELL`` characters are kept whole but do not widen
their column.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 40

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
UNSEEN = {"head", "script", "style", "template", "noscript", "title", "iframe", "object", "canvas", "audio", "video", "noembed", "noframes", "datalist"}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "blockquote", "pre", "figure", "hr", "fieldset", "menu"}
BLOCKS = SPACED | {
    "html", "body", "div", "section", "article", "aside", "header", "footer", "main", "nav", "address", "center", "form", "li", "dt", "dd", "tr",
    "caption", "details", "summary", "figcaption", "legend", "hgroup", "search", "optgroup", "option", "dialog", "thead", "tbody", "tfoot", "dir", "xmp",
}
#: a start tag closes an open element of these names, up to one of the limits
CLOSES = {
    **{t: ({"p"}, {"table", "td", "th", "button"}) for t in BLOCKS - {"html", "body", "li", "dt", "dd", "tr", "thead", "tbody", "tfoot", "caption", "option", "optgroup"}},
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}), "dt": ({"dt", "dd", "p"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd", "p"}, {"dl", "table", "td", "th"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    **{t: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for t in ("thead", "tbody", "tfoot", "caption", "colgroup")},
    "body": ({"head"}, set()), "a": ({"a"}, BLOCKS | {"td", "th"}),
}
#: an end tag does not reach beyond these
WALLS = {"table": set(), "td": {"table"}, "th": {"table"}, "tr": {"table"}}
_DEFAULT_WALLS = {"td", "th", "table", "caption"}
_LISTS = {"ul", "ol", "menu", "dir"}
#: not shown inside svg, and inside math
_UNSEEN_IN = {
    "svg": {"title", "desc", "metadata", "defs", "symbol", "clippath", "mask", "pattern", "marker", "lineargradient", "radialgradient", "filter", "style", "script"},
    "math": {"annotation", "annotation-xml", "mphantom"},
}
#: content of these, inside svg or math, is HTML again
_HTML_IN = {"svg": {"foreignobject", "desc", "title"}, "math": {"mi", "mo", "mn", "ms", "mtext", "annotation-xml"}}
#: a start tag of these ends an svg or math that was left open
_ENDS_FOREIGN = {
    "b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3", "h4", "h5", "h6", "head", "hr", "i", "img", "li", "listing",
    "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s", "small", "span", "strong", "strike", "sub", "sup", "table", "tt", "u", "ul", "var",
}

_TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>?)""", re.S)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_READ = re.compile("hidden|style|colspan|start|display|visibility", re.I)
_REMARK = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SPAN = re.compile(r"\s*(\d{1,3})")
_FIRST = re.compile(r"\s*(-?\d{1,9})")
_GAPS = re.compile(r"[ \t\n\r\f]+")


class Node:
    """``shown``: whether it shows by its own name and attributes. ``inner``: svg,
    text (of an svg) or math where its content is not HTML."""

    __slots__ = ("attrs", "children", "inner", "shown", "tag")

    def __init__(self, tag: str, attrs: str = "", outer: str = ""):
        self.tag, self.children = tag, []
        self.attrs = _attributes(attrs) if attrs and _READ.search(attrs) else {}
        kind = "svg" if outer == "text" else outer
        if kind:
            self.shown = tag not in _UNSEEN_IN[kind]
            self.inner = "" if tag in _HTML_IN[kind] else "text" if kind == "svg" and tag == "text" else outer
        else:
            self.shown, self.inner = tag not in UNSEEN, ""
        if tag in ("svg", "math"):
            self.inner = tag
        if self.attrs and self.shown:
            self.shown = "hidden" not in self.attrs and not _hides(self.attrs, bool(kind) or tag == "svg")


def _attributes(raw: str) -> dict[str, str]:
    """Names, in lower case, and values; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), _words(m[2] or m[3] or m[4] or ""))
    return out


def _hides(attrs: dict[str, str], drawn: bool) -> bool:
    """Whether the style, or in a drawing the attributes of that name, hide."""
    found = {k: attrs[k].strip().lower() for k in ("display", "visibility") if drawn and k in attrs}
    strong: set[str] = set()
    for part in _REMARK.sub("", attrs.get("style", "")).split(";"):
        name, _, value = part.partition(":")
        name, (value, bang, _) = name.strip().lower(), value.partition("!")
        if name in ("display", "visibility") and value.strip() and (bang or name not in strong):
            found[name] = value.strip().lower()
            strong |= {name} if bang else set()
    return found.get("display") == "none" or found.get("visibility") in ("hidden", "collapse")


def parse(page: str) -> Node:
    root = Node("html")
    stack = [root]
    at = 0

    def close(names: set[str], limits: set[str]) -> None:
        """Closes the outermost open element of ``names`` above a limit."""
        found = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                found = i
            elif stack[i].tag in limits:
                break
        if found is not None:
            del stack[found:]

    while True:
        m = _TAG.search(page, at)
        if m is None:
            break
        if m.start() > at and stack[-1].inner != "svg":
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if stack[-1].inner and page.startswith("<![CDATA[", m.start()):
                start, end = m.start() + 9, page.find("]]>", m.start())
                if stack[-1].inner != "svg":
                    stack[-1].children.append(page[start : end if end >= 0 else len(page)].replace("&", "&amp;"))
                at = end + 3 if end >= 0 else len(page)
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not any(n.tag == "p" for n in stack[-64:]):
                stack[-1].children.append(Node("p"))
            elif tag not in ("html", "body"):
                walls = WALLS.get(tag, _DEFAULT_WALLS - {tag})
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in walls:
                        break
            continue
        if tag == "html":
            continue
        if len(stack) > 1 and stack[1].tag == "head" and tag in BLOCKS and tag != "body":
            del stack[1:]  # content ends the head
        if stack[-1].inner and tag in _ENDS_FOREIGN:
            while stack[-1].inner:
                stack.pop()
        outer = stack[-1].inner
        if tag in CLOSES and not outer:
            close(*CLOSES[tag])
        node = Node(tag, m[3], outer)
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/") and (outer or tag in UNSEEN or tag in ("svg", "math")):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            continue
        stack.append(node)
    if at < len(page) and stack[-1].inner != "svg":
        stack[-1].children.append(page[at:])
    return root


def _words(text: str) -> str:
    return html.unescape(text) if "&" in text else text


class Page:
    """Lines of laid-out text. ``gap``: line breaks due before the next text."""

    def __init__(self):
        self.parts: list[str] = []
        self.gap, self.space, self.indent, self.mark = 0, False, 0, ""
        self.fresh = True

    def turn(self, lines: int) -> None:
        """At least ``lines`` line breaks before what follows."""
        if not self.fresh:
            self.gap = max(self.gap, lines)
        self.space = False

    def _start(self) -> None:
        if self.gap or self.fresh:
            if not self.fresh:
                self.parts.append("\n" * self.gap)
            mark, self.mark = self.mark, ""
            self.parts.append("  " * (self.indent - bool(mark)) + mark if self.indent else "")
            self.gap, self.fresh = 0, False
        elif self.space:
            self.parts.append(" ")
        self.space = False

    def text(self, raw: str, kept: bool) -> None:
        raw = _words(raw)
        if kept:
            for i, line in enumerate(raw.split("\n")):
                if i:
                    self.gap = max(self.gap, 0) + 1 if not self.fresh else 0
                if line:
                    self._start()
                    self.parts.append(line)
            return
        flat = _GAPS.sub(" ", raw)
        body = flat.strip(" ")
        if not body:
            self.space = self.space or bool(flat) and not self.gap and not self.fresh
            return
        if flat[0] == " " and not self.gap and not self.fresh:
            self.space = True
        self._start()
        self.parts.append(body)
        self.space = flat[-1] == " "

    def done(self) -> str:
        return "".join(self.parts).replace("\xa0", " ")


def _rows(table: Node) -> list[list[Node]]:
    """Cells of each visible row, those of inner tables left out; captions and
    loose content come as rows of one cell."""
    out, waiting = [], [table]
    while waiting:
        node = waiting.pop()
        for child in reversed(node.children) if node.tag in ("table", "thead", "tbody", "tfoot") else ():
            if isinstance(child, Node) and child.shown:
                waiting.append(child)
            elif isinstance(child, str) and child.strip():
                loose = Node("td")
                loose.children.append(child)
                waiting.append(loose)
        if node.tag == "tr":
            cells = []
            for child in node.children:
                if isinstance(child, Node):
                    if child.shown:
                        cells.append(child)
                elif child.strip():
                    loose = Node("td")
                    loose.children.append(child)
                    cells.append(loose)
            out.append(cells)
        elif node.tag not in ("table", "thead", "tbody", "tfoot", "col", "colgroup"):
            out.append([node])
    return out


def layout(root: Node) -> str:
    """Lays a tree out. Tables are met after all that lies in their cells."""
    tables: dict[int, str] = {}
    # inner tables first: list every cell of every table, outermost first
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        if node.tag == "table":
            order.append(node)
        waiting.extend(c for c in node.children if isinstance(c, Node) and c.shown)
    for table in reversed(order):
        rows = []
        for cells in _rows(table):
            row = []
            for cell in cells:
                row.append(" ".join(_flow(cell, tables).split()))
                span = _SPAN.match(cell.attrs.get("colspan", ""))
                row.extend([""] * (min(int(span[1]), 100) - 1 if span else 0))
            rows.append(row)
        widths: list[int] = []
        for row in rows:
            if len(row) > 1:
                widths += [0] * (len(row) - len(widths))
                for i, cell in enumerate(row):
                    if len(cell) <= CELL:
                        widths[i] = max(widths[i], len(cell))
        lines = ["  ".join(c.ljust(widths[i]) if len(row) > 1 else c for i, c in enumerate(row)).rstrip() for row in rows]
        tables[id(table)] = "\n".join(line for line in lines if line)
    return _flow(root, tables)


def _flow(root: Node, tables: dict[int, str]) -> str:
    page = Page()
    pre, lists = 0, []
    waiting: list[tuple] = [(root, True)]
    while waiting:
        item, opening = waiting.pop()
        if isinstance(item, str):
            page.text(item, pre > 0)
            continue
        tag = item.tag
        lines = 2 if tag in SPACED else 1 if tag in BLOCKS or tag == "text" and item.inner == "text" else 0
        if tag in _LISTS and (lists if opening else lists[1:]):
            lines = 1  # a list inside a list
        if not opening:
            if tag in _LISTS:
                lists.pop()
                page.indent -= 1
            elif tag == "pre":
                pre -= 1
            if lines:
                page.turn(lines)
                if tag == "li":
                    page.mark = ""
            continue
        if item is not root and not item.shown:
            continue
        if tag == "br":
            page.turn(page.gap + 1 if page.gap else 1)
            continue
        if lines:
            page.turn(lines)
        if tag == "table" and id(item) in tables and item is not root:
            for line in tables[id(item)].split("\n"):
                if line:
                    page.turn(1)
                    page.text(line.replace("&", "&amp;"), True)
            page.turn(2)
            continue
        if tag in ("td", "th") and not page.fresh and not page.gap:
            page.space = True
        if tag in _LISTS:
            first = _FIRST.match(item.attrs.get("start", ""))
            lists.append([tag, int(first[1]) if first else 1])
            page.indent += 1
        elif tag == "li" and lists:
            kind = lists[-1]
            page.mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
            kind[1] += 1
        elif tag == "pre":
            pre += 1
        waiting.append((item, False))
        waiting.extend((c, True) for c in reversed(item.children))
    return page.done()


def visible_text(page: str | None) -> str:
    return layout(parse(page)) if page else ""


def page_text(markup: str | Column) -> Column:
    """Visible text of a column of pages."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([visible_text(x.as_py()) for x in column], pa.string())

    return run(markup)


def extract_pages(pages: DataFrame, page_id: str = "page_id", markup: str = "html") -> DataFrame:
    """(page_id, text) per page row."""
    return pages.select(F.col(page_id).alias("page_id"), page_text(pages[markup]).alias("text"))
