"""Tables with inferred column types, forms, lists, and their exports.

The parse stage gives each table's header cells and rows, each form's elements and each list's items as they stand in the
tree. Widths, names, types, caps, labels and values are expressions over arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, squeeze
from .dom import Node, clean, extract

#: Placeholders of empty cells, currency signs, the share of a sample that decides, and its size.
EMPTY_CELLS = ("", "—", "-")
SIGNS = "[$€£]"
SHARE, SAMPLE = 0.6, 20
#: What Python's float() takes: signs, digits with single underscores, exponents, nan and inf.
FLOAT = r"(?iU)^\s*[+-]?(?:nan|inf(?:inity)?|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:e[+-]?\d(?:_?\d)*)?)\s*$"
#: Types of input elements, and the attributes kept of each kind of field.
INPUT_TYPES = (
    "text", "email", "password", "number", "tel", "url", "date", "datetime-local", "time", "month", "week", "checkbox", "radio", "file", "hidden",
    "search", "color", "range", "submit", "image",
)
FIELD_ATTRS = {
    "input": ("name", "type", "placeholder", "required", "pattern", "minlength", "maxlength", "min", "max", "step", "autocomplete", "readonly", "disabled", "value"),
    "select": ("name", "required", "multiple", "disabled"),
    "textarea": ("name", "placeholder", "required", "rows", "cols", "maxlength", "readonly", "disabled"),
}


def _cells(row: Node, *tags: str) -> list[str]:
    return [clean(c.content()) for c in row.children if c.tag in tags]


def _table_rows(root: Node | None) -> list[dict]:
    out = []
    for k, table in enumerate(n for n in (root.walk() if root else ()) if n.tag == "table"):
        head, body = next(table.find("thead"), None), next(table.find("tbody"), None)
        rows = list(table.find("tr"))
        header: list[str] = []
        if head is not None:
            header = [clean(c.content()) for c in head.find("th")]
        elif rows and rows[0].parent is not None and rows[0].parent.tag != "tbody":
            header = _cells(rows[0], "th") or _cells(rows[0], "td")
        if body is not None:
            rows = list(body.find("tr"))
        elif head is not None:
            inside = set(map(id, head.find("tr")))
            rows = [r for r in rows if id(r) not in inside]
        out.append({"table_idx": k, "header": header, "cells": [c for c in (_cells(r, "td", "th") for r in rows) if c]})
    return out


TABLES = "table_idx int, header array<string>, cells array<array<string>>"


def column_type(values: Column) -> Column:
    """The type of a column of cell texts, by a vote of its first 20 that are not empty."""
    sample = F.slice(F.filter(values, lambda v: ~F.coalesce(v, F.lit("")).isin(*EMPTY_CELLS)), 1, SAMPLE)
    bare = F.transform(sample, lambda v: F.trim(F.regexp_replace(v, r"[,$€£%]", "")))
    n = F.size(sample)
    share = lambda hits: F.size(hits) >= F.lit(SHARE) * n
    other = F.filter(sample, lambda v: ~F.trim(F.regexp_replace(v, r"[,$€£%]", "")).rlike(FLOAT))
    is_date = lambda v: F.trim(v).rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}[/-]\d{2}[/-]\d{4})")
    is_email = lambda v: F.contains(v, F.lit("@")) & F.contains(F.substring_index(v, "@", -1), F.lit("."))
    is_url = lambda v: F.trim(v).startswith("http://") | F.trim(v).startswith("https://")
    return (
        F.when(n == 0, "string")
        .when(
            share(F.filter(bare, lambda v: v.rlike(FLOAT))),
            F.when(F.exists(sample, lambda v: v.rlike(SIGNS)), "currency").when(F.exists(sample, lambda v: F.contains(v, F.lit("%"))), "percentage").when(F.forall(bare, lambda v: v.rlike(FLOAT) & ~F.contains(v, F.lit("."))), "integer").otherwise("number"),
        )
        .when(share(F.filter(other, is_date)), "date")
        .when(share(F.filter(other, lambda v: ~is_date(v) & is_email(v))), "email")
        .when(share(F.filter(other, lambda v: ~is_date(v) & ~is_email(v) & is_url(v))), "url")
        .otherwise("string")
    )


def tables(pages: DataFrame, *, max_rows: int | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per table: columns, types, rows, total_rows, column_count, rows_returned and rows_truncated."""
    return _tables(extract(pages, _table_rows, TABLES, html_col=html_col, keep=keep), max_rows, keep)


def _tables(raw: DataFrame, max_rows: int | None, keep: tuple[str, ...]) -> DataFrame:
    width = F.greatest(F.size("header"), F.coalesce(F.array_max(F.transform("cells", lambda r: F.size(r))), F.lit(0)))
    raw = raw.withColumn("__w", width)
    places = F.when(F.col("__w") > 0, F.sequence(F.lit(1), F.col("__w"))).otherwise(F.array().cast("array<int>"))
    made = F.when(F.size("header") > 0, F.lit("column_")).otherwise(F.lit("col_"))
    columns = F.transform(places, lambda i: F.when(i <= F.size("header"), F.try_element_at("header", i)).otherwise(F.concat(made, i)))
    at = lambda row, i: F.coalesce(F.try_element_at(row, i), F.lit(""))
    types = F.transform(places, lambda i: column_type(F.transform("cells", lambda r: at(r, i))))
    rows = F.col("cells") if max_rows is None else F.slice("cells", 1, max(1, max_rows))
    cut = F.lit(False) if max_rows is None else F.size("cells") > max_rows
    return raw.select(*keep, "table_idx", columns.alias("columns"), types.alias("types"), rows.alias("rows"), F.size("cells").alias("total_rows"), F.col("__w").alias("column_count"), F.when(cut, max_rows).otherwise(F.size("cells")).alias("rows_returned"), cut.alias("rows_truncated"))


def cells(tbls: DataFrame, *, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per cell: row and column number, column name and type, text and, where it has one, number."""
    rows = tbls.select(*keep, "table_idx", "columns", "types", F.posexplode("rows").alias("row_idx", "row"))
    each = rows.select(*keep, "table_idx", "row_idx", "row", F.posexplode(F.arrays_zip("columns", "types")).alias("col_idx", "c"))
    value = F.coalesce(F.try_element_at("row", F.col("col_idx") + 1), F.lit(""))
    return each.select(*keep, "table_idx", "row_idx", "col_idx", F.col("c.columns").alias("column"), F.col("c.types").alias("type"), value.alias("value")).withColumn("number", coerce(F.col("value"), F.col("type")))


def coerce(value: Column, kind: Column) -> Column:
    """The number of a cell of a numeric type; NULL for placeholders, texts and what is no number."""
    bare = F.regexp_replace(F.regexp_replace(value, "[,$€£%]", ""), "_", "")
    return F.when(kind.isin("integer", "number", "currency", "percentage") & ~F.trim(value).isin(*EMPTY_CELLS), F.trim(bare).try_cast("double"))


def json_value(value: Column, kind: Column) -> Column:
    """A cell as JSON: null for a placeholder, a number for numeric types where it is one, else a string."""
    number = coerce(value, kind)
    integer = F.regexp_replace(F.regexp_replace(value, "[,_]", ""), r"^\s*\+?", "")
    whole = (number == F.floor(number)) & kind.isin("currency", "percentage")
    shown = F.when(kind == "integer", F.when(integer.rlike(r"^-?\d+\s*$"), F.regexp_replace(F.trim(integer), r"^(-?)0+(?=\d)", "$1"))).when(whole, F.floor(number).cast("bigint").cast("string")).otherwise(number.cast("string"))
    text = F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', "$1")
    return F.when(F.trim(value).isin(*EMPTY_CELLS), F.lit("null")).when(shown.isNotNull(), shown).otherwise(text)


def records_json(tbls: DataFrame, *, typed: bool = True, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Per table the array of its rows as JSON objects; of columns with the same name the last counts."""
    numbered = F.arrays_zip("columns", "types")

    def of_row(row: Column) -> Column:
        pairs = F.transform(numbered, lambda c, i: F.struct(c["columns"].alias("k"), F.coalesce(F.try_element_at(row, i + 1), F.lit("")).alias("v"), c["types"].alias("t"), i.alias("i")))
        last = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"])))
        quoted = lambda s: F.regexp_replace(F.to_json(F.struct(s.alias("v"))), r'^\{"v":(.*)\}$', "$1")
        value = (lambda p: json_value(p["v"], p["t"])) if typed else (lambda p: quoted(p["v"]))
        return F.concat(F.lit("{"), F.array_join(F.transform(last, lambda p: F.concat(quoted(p["k"]), F.lit(":"), value(p))), ","), F.lit("}"))

    return tbls.select(*keep, "table_idx", F.transform("rows", of_row).alias("records"))


def to_csv(tbls: DataFrame, *, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Per table its text as CSV: quoted where needed, lines ended by line feeds, none at the end."""

    def cell(v: Column) -> Column:
        return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    def line(row: Column) -> Column:
        full = F.transform("columns", lambda _, i: F.coalesce(F.try_element_at(row, i + 1), F.lit("")))
        joined = F.array_join(F.transform(full, cell), ",")
        return F.when((F.size(full) == 1) & (joined == ""), F.lit('""')).otherwise(joined)

    lines = F.concat(F.array(F.array_join(F.transform("columns", cell), ",")), F.transform("rows", line))
    return tbls.select(*keep, "table_idx", F.array_join(lines, "\n").alias("csv"))


def pick_table(tbls: DataFrame, index: int = 0, *, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The table of that number of each page; pages without it have no row."""
    return tbls.filter(F.col("table_idx") == index)


def best_table(tbls: DataFrame, *, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Per page the table that looks most like data: 100 for a named first column, 20 for two columns or more, and its rows."""
    named = ~F.coalesce(F.try_element_at("columns", F.lit(1)), F.lit("col_")).startswith("col_")
    score = F.when(named, 100).otherwise(0) + F.when(F.col("column_count") >= 2, 20).otherwise(0) + F.col("total_rows")
    return tbls.groupBy(*keep).agg(F.max_by("table_idx", F.struct(score, -F.col("table_idx"))).alias("table_idx"), F.max(score).alias("score"))


FIELDS = "form_idx int, action string, method string, field_idx int, tag string, attrs map<string,string>, content string, for_label string, wrap_label string, near_label string, options array<struct<value:string,label:string>>"


def _option_rows(select: Node) -> list[dict]:
    return [{"value": o.attrs.get("value", ""), "label": clean(o.content()) or o.attrs.get("value", "")} for o in select.find("option")]


def _labels(by_id: dict[str, Node], node: Node) -> dict:
    """The texts that may label a field: of its label by id, of the label around it, and of the first label beside it."""
    named = by_id.get(node.attrs.get("id") or "")
    around = ""
    for above in node.above():
        if above.tag == "label" and not around:
            parts = [above.text]
            for child in above.children:
                parts += ["" if child is node else clean(child.content()), child.tail.strip()]
            around = clean(" ".join(parts))
    beside = next((t for n in (node.parent.children if node.parent else ()) if n.tag == "label" and n is not node and (t := clean(n.content()))), "")
    return {"for_label": clean(named.content()) if named else "", "wrap_label": around, "near_label": beside}


def _form_rows(root: Node | None) -> list[dict]:
    out = []
    for k, form in enumerate(n for n in (root.walk() if root else ()) if n.tag == "form"):
        # First the fields by kind of element, then the buttons that submit.
        inputs = [n for n in form.find("input")]
        ordered = [n for n in inputs if n.attrs.get("type", "text") != "submit"] + list(form.find("select")) + list(form.find("textarea"))
        ordered += [n for n in form.find("button") if n.attrs.get("type", "submit") == "submit"] + [n for n in inputs if n.attrs.get("type") == "submit"]
        by_id: dict[str, Node] = {}
        for label in form.find("label"):
            if label.attrs.get("for"):
                by_id.setdefault(label.attrs["for"], label)
        base = {"form_idx": k, "action": clean(form.attrs.get("action")), "method": (form.attrs.get("method") or "get").upper()}
        for i, n in enumerate(ordered):
            out.append(base | {"field_idx": i, "tag": n.tag, "attrs": n.attrs, "content": clean(n.content()), "options": _option_rows(n) if n.tag == "select" else []} | _labels(by_id, n))
        if not ordered:
            out.append(base | {"field_idx": None})
    return out


def form_fields(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per field of each form, in the order inputs, selects, text areas, buttons: type, label, name, flags, kept attributes and options. A form without fields has one row with a NULL field_idx."""
    return _fields(extract(pages, _form_rows, FIELDS, html_col=html_col, keep=keep), keep)


def _fields(raw: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    a = F.col("attrs")
    given = F.coalesce(a["type"], F.lit("text"))
    submits = (F.col("tag") == "button") | ((F.col("tag") == "input") & (given == "submit"))
    kind = F.when(F.col("tag").isin("select", "textarea"), F.col("tag")).when(submits, "submit").when(given.isin(*INPUT_TYPES), given).otherwise("text")
    human = F.regexp_replace(squeeze(a["name"]), "[_-]", " ")
    human = F.concat(F.upper(F.substring(human, 1, 1)), F.lower(F.expr("substring(regexp_replace(trim(regexp_replace(coalesce(attrs['name'], ''), '(?U)\\\\s+', ' ')), '[_-]', ' '), 2)")))
    label = F.coalesce(*[blank_to_null(F.col(c)) for c in ("for_label", "wrap_label", "near_label")], blank_to_null(squeeze(a["placeholder"])), blank_to_null(human), F.lit(""))
    shown = F.when(F.col("tag") == "button", F.col("content")).when(submits, F.trim(F.coalesce(a["value"], F.lit("Submit")))).otherwise(label)
    names = F.coalesce(*[F.when(F.col("tag") == t, F.array(*map(F.lit, n))) for t, n in FIELD_ATTRS.items()], F.array().cast("array<string>"))
    kept = F.map_filter(a, lambda k, v: F.array_contains(names, k))
    flag = lambda name: F.when(~submits, F.map_contains_key(a, name)).otherwise(F.lit(False))
    return raw.select(*keep, "form_idx", blank_to_null(F.col("action")).alias("action"), "method", "field_idx", "tag", kind.alias("type"), shown.alias("label"), F.when(~submits, a["name"]).alias("name"), flag("required").alias("required"), flag("disabled").alias("disabled"), F.when(~submits, kept).alias("attrs"), "options")


def forms(fields: DataFrame, *, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per form: action, method, its fields in order and their count."""
    one = F.struct("field_idx", "tag", "type", "label", "name", "required", "disabled", "options")
    listed = F.array_sort(F.collect_list(F.when(F.col("field_idx").isNotNull(), one)))
    return fields.groupBy(*keep, "form_idx").agg(F.first("action").alias("action"), F.first("method").alias("method"), listed.alias("fields"), F.count("field_idx").alias("field_count"))


LISTS = "list_idx int, type string, items array<struct<value:string,label:string>>"


def _item_text(item: Node) -> str:
    parts = [item.text]
    for child in item.children:
        if child.tag in ("ul", "ol"):
            break
        parts += [clean(child.content()), child.tail]
    return clean(" ".join(parts))


def _list_rows(root: Node | None) -> list[dict]:
    out: list[dict] = []
    every = list(root.walk()) if root else []
    for tag, kind in (("ul", "unordered"), ("ol", "ordered")):
        for node in every:
            if node.tag == tag:
                items = [{"value": None, "label": t} for c in node.children if c.tag == "li" and (t := _item_text(c))]
                if items:
                    out.append({"list_idx": len(out), "type": kind, "items": items})
    for node in every:
        if node.tag == "select" and not any(a.tag == "form" for a in node.above()):
            options = _option_rows(node)
            if len(options) > 2:
                out.append({"list_idx": len(out), "type": "select", "items": options})
    return out


def lists(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per list: unordered ones first, then ordered ones, then selects outside forms; type, items, total."""
    raw = extract(pages, _list_rows, LISTS, html_col=html_col, keep=keep)
    return raw.withColumn("total", F.size("items"))


def list_items(lsts: DataFrame, *, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return lsts.select(*keep, "list_idx", "type", F.posexplode("items").alias("item_idx", "i")).select(*keep, "list_idx", "type", "item_idx", "i.value", "i.label")


def _schema_rows(root: Node | None) -> list[dict]:
    return [{"kind": kind, name: row} for kind, (name, rows) in enumerate((("t", _table_rows(root)), ("f", _form_rows(root)), ("l", _list_rows(root)))) for row in rows] + [{"kind": 3}]


def page_schema(pages: DataFrame, *, max_rows: int | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per page: its tables, forms and lists as arrays, and how many of each. Each page is parsed once, and there is one shuffle by page."""
    whole = lambda ddl: ddl.replace(" ", ":", 1)
    struct = lambda ddl: "struct<" + ",".join(whole(part.strip()) for part in _fields_of(ddl)) + ">"
    raw = extract(pages, _schema_rows, f"kind int, t {struct(TABLES)}, f {struct(FIELDS)}, l {struct(LISTS)}", html_col=html_col, keep=keep)
    names = {c: raw.schema[c].dataType.names for c in "tfl"}
    lists_ = {n: "list_type" if n == "type" else n for n in names["l"]}
    rows = raw.select(*keep, "kind", *[F.col(f"{c}.{n}").alias(n) for c in "tf" for n in names[c]], *[F.col(f"l.{n}").alias(to) for n, to in lists_.items()])
    # The expressions of each kind run over all rows, and what they make of other kinds is left out.
    rows = _tables(rows, max_rows, (*keep, "kind", *names["f"], *lists_.values()))
    table = F.struct("table_idx", "columns", "types", "rows", "total_rows")
    rows = _fields(rows.withColumn("table", table), (*keep, "kind", "table", *lists_.values()))
    field = F.struct("form_idx", "field_idx", "tag", "type", "label", "name", "required", "disabled", "options", "action", "method")
    listed = F.struct("list_idx", F.col("list_type").alias("type"), "items", F.size("items").alias("total"))
    gathered = lambda kind, one: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, one)))
    out = rows.groupBy(*keep).agg(gathered(0, F.col("table")).alias("tables"), gathered(1, field).alias("__f"), gathered(2, listed).alias("lists"))
    of_form = lambda k: F.filter("__f", lambda x: x["form_idx"] == k)
    shown = ("tag", "type", "label", "name", "required", "disabled", "options")
    fields = lambda k: F.transform(F.filter(of_form(k), lambda x: x["field_idx"].isNotNull()), lambda x: F.struct(*[x[n].alias(n) for n in shown]))
    forms_ = F.transform(F.array_distinct(F.transform("__f", lambda x: x["form_idx"])), lambda k: F.struct(k.alias("form_idx"), F.get(of_form(k), F.lit(0))["action"].alias("action"), F.get(of_form(k), F.lit(0))["method"].alias("method"), fields(k).alias("fields")))
    return out.select(*keep, "tables", forms_.alias("forms"), "lists").select("*", F.size("tables").alias("n_tables"), F.size("forms").alias("n_forms"), F.size("lists").alias("n_lists"))


def _fields_of(ddl: str) -> list[str]:
    """The top-level fields of a DDL text."""
    out, depth = [""], 0
    for c in ddl:
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
