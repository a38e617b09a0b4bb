"""HTML trees: the one Python stage. A page becomes a small tree, and extractors turn trees into rows.

The builder follows the recovery habits of common lenient parsers: void elements take no children, block tags close an
open paragraph, list items, cells, rows and options close their like, script and style hold raw text, and the end of the
page closes everything. No tbody is inserted. Several top-level nodes are wrapped into one element. Comments are nodes
with an empty tag; their text is not part of an element's text content.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Tags without content.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Tags that close an open paragraph.
CLOSES_P = frozenset(
    ("address", "article", "aside", "blockquote", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form")
    + ("h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul")
)
#: For each tag, the open tags that it closes and the tags at which the search for them ends.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("td", "th", "tr"), ("table",)),
    "thead": (("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",)),
}
#: Elements nested deeper than this stay at this depth, so that no page exhausts the stack.
DEPTH = 200
HEAD_ONLY = frozenset(("title", "meta", "link", "base", "style", "script", "noscript"))


class Node:
    """An element, or a comment (empty tag). `text` is before the first child, `tail` after the node."""

    __slots__ = ("tag", "attrs", "text", "tail", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.text = self.tail = ""
        self.children: list[Node] = []
        if parent is not None:
            parent.children.append(self)

    def walk(self) -> Iterator[Node]:
        """The node and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def content(self) -> str:
        """All text below, without comments."""
        parts: list[str] = []

        def gather(node: Node) -> None:
            if node.tag:
                parts.append(node.text)
                for child in node.children:
                    gather(child)
                    parts.append(child.tail)

        gather(self)
        return "".join(parts)

    def find(self, *tags: str) -> Iterator[Node]:
        """Nodes of these tags below this one."""
        return (n for n in self.walk() if n is not self and n.tag in tags)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = Node("\x00")
        self.open: list[Node] = [self.top]

    def _add_text(self, data: str) -> None:
        here = self.open[-1]
        if here.children:
            here.children[-1].tail += data
        else:
            here.text += data

    def _close(self, tags: tuple[str, ...] | frozenset, until: tuple[str, ...]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                if tags in (("p",),) or len(tags) == 1:
                    return
                self._close(tags, until)
                return
            if self.open[k].tag in until:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self._close(("p",), ("td", "th", "table", "button", "object", "body"))
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in ("html", "body", "head") and (found := next((n for n in self.top.walk() if n.tag == tag), None)):
            for k, v in attrs:
                found.attrs.setdefault(k, v or "")
            return
        if tag == "body" or (tag not in HEAD_ONLY and self.open[-1].tag == "head"):
            while self.open[-1].tag in HEAD_ONLY | {"head"}:
                self.open.pop()
        if self.open[-1].tag == "html" and tag not in ("head", "body", "frameset"):
            wrapper = "head" if tag in HEAD_ONLY and not any(c.tag == "body" for c in self.open[-1].children) else "body"
            found = next((c for c in self.open[-1].children if c.tag == wrapper), None)
            self.open.append(found or Node(wrapper, parent=self.open[-1]))
        kept: dict[str, str] = {}
        for k, v in attrs:
            kept.setdefault(k, v if v is not None else "")
        node = Node(tag, kept, self.open[-1])
        if tag not in VOID and len(self.open) <= DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in ("table", "td", "th") and tag not in ("table", "tr", "thead", "tbody", "tfoot", "td", "th", "form", "div", "body", "html"):
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "html":
            if not data.strip():
                return
            found = next((c for c in self.open[-1].children if c.tag == "body"), None)
            self.open.append(found or Node("body", parent=self.open[-1]))
        self._add_text(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Conditional and other marked sections are skipped up to their end, whatever they hold."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def handle_comment(self, data: str) -> None:
        Node("", parent=self.open[-1]).text = data


def parse(html: str | None) -> Node | None:
    """The root of the page's tree; None for an empty or blank page."""
    if not html or not html.strip():
        return None
    builder = _Builder()
    builder.feed(html)
    builder.close()
    top = builder.top
    roots = [c for c in top.children if c.tag]
    whole = next((c for c in roots if c.tag == "html"), None)
    if whole is not None:
        root = whole
    elif len(roots) == 1 and not top.text.strip() and not any(c.tail.strip() for c in top.children):
        root = roots[0]
    else:
        top.tag = "div"
        return top if roots or top.text.strip() else None
    root.parent, root.tail = None, ""
    return root


def scope(root: Node) -> Node:
    """The body, or the root of a fragment."""
    return next((c for c in root.children if c.tag == "body"), root)


_SPACE = re.compile(r"\s+")


def clean(text: str | None) -> str:
    """White space of any kind to single spaces, none at the ends."""
    return _SPACE.sub(" ", text or "").strip()


#: Pages whose rows are held at a time.
PAGES = 128


def extract(pages: DataFrame, rows_of: Callable[[Node | None], list[dict]], schema: str, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row of `schema` for every dict that rows_of(root) gives, beside the columns `keep` of its page.

    Pages go to Python in Arrow batches and never come back; only the rows do.
    """
    fields = [f for f in pages.schema.fields if f.name in keep]
    out = T.StructType([*fields, *T.StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PAGES) for b in batches for at in range(0, b.num_rows, PAGES)):
            kept = [batch.column(k).to_pylist() for k in range(len(fields))]
            rows = []
            for i, page in enumerate(batch.column(len(fields)).to_pylist()):
                own = {f.name: kept[k][i] for k, f in enumerate(fields)}
                rows += [own | r for r in rows_of(parse(page))]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return pages.select(*[f.name for f in fields], html_col).mapInArrow(run, out)


NODES = "node_id int, end_id int, parent_id int, depth int, tag string, attrs map<string,string>, text string, tail string, ancestors array<struct<node_id:int,tag:string>>"


def node_rows(root: Node | None) -> list[dict]:
    """Every node in document order, with the last node below it and its ancestors from the root on."""
    rows: list[dict] = []

    def visit(node: Node, parent: int | None, above: list[dict]) -> None:
        at = len(rows)
        row = {"node_id": at, "end_id": at, "parent_id": parent, "depth": len(above), "tag": node.tag, "attrs": node.attrs, "text": node.text, "tail": node.tail, "ancestors": above}
        rows.append(row)
        for child in node.children:
            visit(child, at, [*above, {"node_id": at, "tag": node.tag}])
        row["end_id"] = len(rows) - 1

    if root is not None:
        visit(root, None, [])
    return rows


def nodes(pages: DataFrame, **options) -> DataFrame:
    """The pages' nodes, a row each."""
    return extract(pages, node_rows, NODES, **options)
