"""The action map: interactive elements of cleaned pages with labels and semantic groups, and its text renderings.

The parse stage reads off what needs the tree: which elements are interactive, their attributes and text, and the chain
of sections around each. Names, labels, order and groups are expressions over those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, squeeze, xml_element
from .dom import VOID, Node, clean, extract

#: Tags that go, attributes that stay, interactive tags.
REMOVED = ("script", "style", "noscript", "iframe", "meta", "link", "head", "canvas", "audio", "video")
KEPT = ("href", "src", "alt", "type", "value", "placeholder", "name", "for", "action", "method", "aria-label", "data-sid", "data-sw-bind")
INTERACTIVE = ("a", "button", "input", "select", "textarea")
#: Hints that name a form.
LOGIN_HINTS = "(?iu)login|log in|sign in|signin|password|email|username"
CHECKOUT_HINTS = "(?iu)checkout|payment|billing|cart|buy|order"
SEARCH_HINTS = "(?iu)search|query|find"


def strip(root: Node | None) -> Node | None:
    """The tree without removed tags; the text after a removed tag goes with it."""
    if root is not None:
        for node in list(root.walk()):
            node.children = [c for c in node.children if c.tag not in REMOVED]
    return root


def prune(root: Node) -> None:
    for node in root.walk():
        node.attrs = {k: v for k, v in node.attrs.items() if k in KEPT}


def is_interactive(node: Node) -> bool:
    return node.tag in INTERACTIVE or (bool(node.tag) and (node.attrs.get("role") == "button" or "onclick" in node.attrs))


def _section(node: Node, pruned: bool) -> dict | None:
    """What may name a section; None for an element that never does."""
    attrs = {k: v for k, v in node.attrs.items() if k in KEPT} if pruned else node.attrs
    role = clean(attrs.get("role")).lower()
    if node.tag not in ("form", "nav", "header", "footer", "main", "aside") and role not in ("navigation", "dialog", "alertdialog", "search"):
        return None
    out = {"tag": node.tag, "role": role, "aria": clean(attrs.get("aria-label")), "name": clean(attrs.get("name")), "id": clean(attrs.get("id")), "legend": "", "types": [], "hints": ""}
    if node.tag == "form":
        fields = list(node.find("input", "select", "textarea"))
        legend = next(node.find("legend"), None)
        out |= {"legend": clean(legend.content()) if legend else "", "types": sorted({(clean(f.attrs.get("type")) or "text").lower() for f in fields}), "hints": " ".join(clean(f.attrs.get("placeholder")) for f in fields)}
    return out


SECTION = "struct<tag:string,role:string,aria:string,name:string,id:string,legend:string,types:array<string>,hints:string>"
RAW = f"pos int, tag string, attrs map<string,string>, content string, sections array<{SECTION}>"


def _rows(pruned: bool):
    def rows_of(root: Node | None) -> list[dict]:
        if strip(root) is None:
            return []
        out = []
        for node in root.walk():
            if is_interactive(node):
                attrs = {k: node.attrs[k] for k in ("aria-label", "placeholder", "name", "alt", "value", "type", "href", "data-sw-bind") if k in node.attrs}
                out.append({"pos": len(out) + 1, "tag": node.tag, "attrs": attrs, "content": node.content(), "sections": [s for a in node.above() if (s := _section(a, pruned))]})
        return out

    return rows_of


def form_name(s: Column) -> Column:
    """The name of a form: its own label, its legend, or what its fields are about."""
    own = F.coalesce(*[blank_to_null(s[k]) for k in ("aria", "name", "id", "legend")])
    kind = (
        F.when(F.array_contains(s["types"], "password") | s["hints"].rlike(LOGIN_HINTS), "Login Form")
        .when(F.array_contains(s["types"], "search") | s["hints"].rlike(SEARCH_HINTS), "Search Form")
        .when(s["hints"].rlike(CHECKOUT_HINTS), "Checkout Form")
        .otherwise("Form")
    )
    return F.coalesce(F.substring(own, 1, 80), kind)


def section_name(s: Column) -> Column:
    return (
        F.when(s["tag"] == "form", form_name(s))
        .when((s["tag"] == "nav") | (s["role"] == "navigation"), "Navigation")
        .when(s["tag"].isin("header", "footer", "main", "aside"), F.initcap(s["tag"]))
        .when(s["role"].isin("dialog", "alertdialog"), F.coalesce(blank_to_null(s["aria"]), F.lit("Dialog")))
        .when(s["role"] == "search", "Search")
    )


def label(attrs: Column, content: Column) -> Column:
    """aria-label, placeholder, text, name, alt, value: the first that is there. A blank aria-label or placeholder still counts."""
    given = [F.when(F.coalesce(attrs[k], F.lit("")) != "", squeeze(attrs[k])) for k in ("aria-label", "placeholder")]
    later = [F.when(F.coalesce(attrs[k], F.lit("")) != "", squeeze(attrs[k])) for k in ("name", "alt", "value")]
    return F.coalesce(*given, blank_to_null(squeeze(content)), *later, F.lit(""))


def actions(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id",), pruned: bool = True) -> DataFrame:
    """One row per interactive element: id, type, label, href, placeholder, bind_id, group (NULL where empty), pos in the
    document and grouped_pos in the order of groups as first seen. With pruned, groups see kept attributes only, as cleaned pages do."""
    raw = extract(pages, _rows(pruned), RAW, html_col=html_col, keep=keep)
    a = F.col("attrs")
    kind = F.when(F.col("tag") == "input", F.concat(F.lit("input["), F.coalesce(a["type"], F.lit("text")), F.lit("]"))).otherwise(F.col("tag"))
    group = F.coalesce(F.try_element_at(F.filter(F.transform("sections", section_name), lambda n: n.isNotNull()), F.lit(1)), F.lit("Page"))
    rows = raw.select(*keep, "pos", F.col("pos").cast("string").alias("id"), kind.alias("type"), blank_to_null(F.substring(label(a, F.col("content")), 1, 100)).alias("label"), *[blank_to_null(a[k]).alias(n) for k, n in (("href", "href"), ("placeholder", "placeholder"), ("data-sw-bind", "bind_id"))], group.alias("group"))
    # The window by page comes first: rows dealt by page serve the windows by page and group too, so there is one shuffle.
    page = Window.partitionBy(*keep)
    rows = rows.withColumn("__n", F.count("*").over(page)).withColumn("__first", F.min("pos").over(Window.partitionBy(*keep, "group")))
    return rows.withColumn("grouped_pos", F.row_number().over(page.orderBy("__first", "pos", "__n"))).drop("__n", "__first")


def groups(acts: DataFrame, *, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per group and page, in order: its name, size and elements."""
    element = F.struct("pos", "id", "type", "label", "href", "placeholder", "bind_id")
    return acts.groupBy(*keep, "group").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"), F.array_sort(F.collect_list(element)).alias("elements"))


def _serialise(node: Node, out: list[str]) -> None:
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    if not node.tag:
        out.append(f"<!--{node.text}-->")
        return
    out.append(f"<{node.tag}" + "".join(f' {k}="{escape(v).replace(chr(34), "&quot;")}"' for k, v in node.attrs.items()) + ">")
    if node.tag in VOID:
        return
    out.append(escape(node.text))
    for child in node.children:
        _serialise(child, out)
        out.append(escape(child.tail))
    out.append(f"</{node.tag}>")


def _clean_rows(root: Node | None) -> list[dict]:
    if strip(root) is None:
        return [{"clean_html": "", "n_actions": 0}]
    n = 0
    for node in root.walk():
        if is_interactive(node):
            n += 1
            node.attrs["data-sid"] = str(n)
    prune(root)
    out: list[str] = []
    _serialise(root, out)
    return [{"clean_html": "".join(out), "n_actions": n}]


def clean_pages(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Pages with removed tags and attributes gone, actions numbered in data-sid, and blank lines collapsed."""
    rows = extract(pages, _clean_rows, "clean_html string, n_actions int", html_col=html_col, keep=keep)
    return rows.withColumn("clean_html", F.regexp_replace("clean_html", r"(?U)\n\s*\n", "\n"))


def _attributes() -> dict[str, Column]:
    return {k: F.col(k) for k in ("id", "type", "label", "href", "placeholder", "bind_id", "group")}


def to_xml(acts: DataFrame, *, keep: tuple[str, ...] = ("page_id",), url: Column | None = None, title: Column | None = None, grouped: bool = True) -> DataFrame:
    """One XML document per page: flat, or with a <group> for each group in order."""
    url = F.lit("about:blank") if url is None else url
    title = F.lit("") if title is None else title
    one = acts.withColumn("__xml", xml_element("action", _attributes()))
    if not grouped:
        body = one.groupBy(*keep).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "__xml"))), lambda s: s["__xml"]), "\n").alias("__in"))
        return body.select(*keep, xml_element("page", {"url": url, "title": title}, F.col("__in")).alias("xml"))
    by_group = one.groupBy(*keep, "group").agg(F.min("pos").alias("__first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "__xml"))), lambda s: s["__xml"]), "\n").alias("__in"))
    named = by_group.withColumn("__xml", xml_element("group", {"name": F.col("group")}, F.col("__in")))
    body = named.groupBy(*keep).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__first", "__xml"))), lambda s: s["__xml"]), "\n").alias("__in"))
    return body.select(*keep, xml_element("page", {"url": url, "title": title}, F.col("__in")).alias("xml"))


def terse_line() -> Column:
    """@id type label [group]"""
    shown = F.coalesce(F.col("label"), F.col("placeholder"), F.lit(""))
    group = F.when(F.coalesce(F.col("group"), F.lit("")) != "", F.concat(F.lit(" ["), F.col("group"), F.lit("]"))).otherwise("")
    return F.trim(F.concat(F.lit("@"), F.coalesce("id", F.lit("?")), F.lit(" "), F.coalesce("type", F.lit("?")), F.lit(" "), shown, group))


def to_terse(acts: DataFrame, *, keep: tuple[str, ...] = ("page_id",), most: int | None = None) -> DataFrame:
    """One text per page, a line for each action in the order of groups; the first `most` of them."""
    rows = acts if most is None else acts.filter(F.col("grouped_pos") <= most)
    return rows.groupBy(*keep).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grouped_pos", terse_line().alias("l")))), lambda s: s["l"]), "\n").alias("terse"))


def page_response(acts: DataFrame, pages: DataFrame, *, detail: str = "terse", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """What is told of a page at one of four levels: minimal (counts per group), terse (first 15 actions), xml, full (with 500 characters of html)."""
    counts = acts.groupBy("page_id").agg(F.count("*").alias("n_actions"), F.count_distinct("group").alias("n_groups"))
    base = pages.select("page_id", F.col(url_col).alias("url")).join(counts, "page_id", "left").fillna(0, ["n_actions", "n_groups"])
    if detail == "minimal":
        by_group = groups(acts).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("first_pos", "group", "n"))).alias("g"))
        listed = F.array_join(F.transform("g", lambda s: F.concat(s["group"], F.lit("="), s["n"])), ", ")
        return base.join(by_group, "page_id", "left").select("page_id", "url", "n_actions", "n_groups", F.coalesce(listed, F.lit("")).alias("groups"))
    if detail == "terse":
        return base.join(to_terse(acts, most=15), "page_id", "left")
    out = base.join(to_xml(acts), "page_id", "left")
    if detail == "full":
        out = out.join(pages.select("page_id", F.substring(html_col, 1, 500).alias("preview")), "page_id")
    return out


def truncated_html(pages: DataFrame, *, most: int = 50_000, html_col: str = "html") -> DataFrame:
    """Pages cut to `most` characters, with a comment that tells both lengths; 0 or less cuts nothing."""
    total = F.length(html_col)
    note = F.concat(F.lit("\n<!-- truncated: "), total, F.lit(f" chars total, returned {most} -->"))
    cut = F.when(F.lit(most > 0) & (total > most), F.concat(F.substring(html_col, 1, most), note)).otherwise(F.col(html_col))
    return pages.select("page_id", cut.alias("html"), total.alias("total_chars"))
