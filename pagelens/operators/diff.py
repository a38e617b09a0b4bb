"""Snapshot diffs: fingerprints of actions, and what appeared, changed or disappeared between two versions of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze, xml_element

#: The columns of an action that its content is made of.
CONTENT = ("type", "label", "placeholder", "href", "group", "tool_name", "input_schema")


def _norm(name: str) -> Column:
    return F.lower(squeeze(F.col(name)))


def _filled(acts: DataFrame) -> DataFrame:
    """acts with every column that fingerprints read; missing ones are empty."""
    for name in (*CONTENT, "bind_id"):
        if name not in acts.columns:
            acts = acts.withColumn(name, F.lit(None).cast("string"))
    return acts


def fingerprints(acts: DataFrame, *, key: tuple[str, ...] = ("url",), order: str = "pos") -> DataFrame:
    """acts with fp: group, type, label, placeholder, href, tool and binding; the second of equal ones ends with #2, and so on."""
    acts = _filled(acts)
    raw = lambda c: F.coalesce(F.col(c), F.lit(""))
    base = F.concat_ws("|", F.coalesce("group", F.lit("Page")), raw("type"), _norm("label"), _norm("placeholder"), raw("href"), raw("tool_name"), raw("bind_id"))
    rows = acts.withColumn("__base", base).withColumn("__k", F.row_number().over(Window.partitionBy(*key, "__base").orderBy(order)))
    content = F.sha1(F.to_json(F.struct(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in sorted(CONTENT)])).cast("binary"))
    return rows.withColumn("fp", F.when(F.col("__k") > 1, F.concat("__base", F.lit("#"), "__k")).otherwise(F.col("__base"))).withColumn("content_hash", content).drop("__base", "__k")


def breadcrumb() -> Column:
    """group > type[label] (#id); a missing label is the placeholder, the tool or the type."""
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    kind = F.coalesce("type", F.lit("element"))
    return F.concat(F.coalesce(given("group"), F.lit("Page")), F.lit(" > "), kind, F.lit("["), F.coalesce(given("label"), given("placeholder"), given("tool_name"), kind), F.lit("] (#"), F.coalesce("id", F.lit("?")), F.lit(")"))


def diff(before: DataFrame, after: DataFrame, *, key: tuple[str, ...] = ("url",), order: str = "pos") -> DataFrame:
    """One row per action that appeared, changed or disappeared, with its place among those of its kind by fingerprint.

    Only pages that both versions have are compared; see full_snapshots for the others.
    """
    old, new = fingerprints(before, key=key, order=order), fingerprints(after, key=key, order=order)
    both = old.select(*key).distinct().join(new.select(*key).distinct(), list(key))
    side = lambda rows, name: rows.join(both, list(key), "left_semi").select(*key, "fp", F.struct("id", "type", "label", "group", "tool_name", "content_hash", breadcrumb().alias("breadcrumb")).alias(name))
    met = side(old, "old").join(side(new, "new"), [*key, "fp"], "full_outer")
    kind = F.when(F.col("old").isNull(), "appeared").when(F.col("new").isNull(), "disappeared").when(F.col("old.content_hash") != F.col("new.content_hash"), "changed")
    rows = met.withColumn("change", kind).filter("change is not null")
    shown = F.coalesce("new", "old")
    rows = rows.select(*key, "change", "fp", shown["id"].alias("id"), shown["type"].alias("type"), shown["label"].alias("label"), shown["group"].alias("group"), shown["tool_name"].alias("tool_name"), F.when(F.col("change") == "changed", F.col("old.label")).alias("previous_label"), shown["breadcrumb"].alias("breadcrumb"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key, "change").orderBy("fp")))


def full_snapshots(before: DataFrame, after: DataFrame, *, key: tuple[str, ...] = ("url",)) -> DataFrame:
    """The actions of pages without a baseline."""
    return after.join(before.select(*key).distinct(), list(key), "left_anti")


KINDS = ("appeared", "changed", "disappeared")


def _in_order(kind: str = "change") -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind))


def _joined(order: list[str | Column], text: Column, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("__t")))), lambda s: s["__t"]), between)


def diff_xml(changes: DataFrame, pages: DataFrame, *, key: tuple[str, ...] = ("url",)) -> DataFrame:
    """One XML text per compared page (key, title, groups): its groups, and a section for each kind of change; a note if there is none."""
    one = xml_element("action", {k: F.col(k) for k in ("id", "type", "label", "group", "tool_name", "breadcrumb", "previous_label")})
    by_kind = changes.groupBy(*key, "change").agg(F.count("*").alias("n"), _joined(["place"], one, "").alias("__in"))
    section = F.concat(F.lit("<"), "change", F.lit(' count="'), "n", F.lit('">'), "__in", F.lit("</"), "change", F.lit(">"))
    delta = by_kind.groupBy(*key).agg(_joined([_in_order().alias("o")], section, "").alias("__delta"))
    rows = pages.join(delta, list(key), "left")
    listed = F.array_join(F.transform("groups", lambda g: xml_element("group", {"name": g})), "")
    body = F.concat(F.lit("<skeleton><groups>"), listed, F.lit("</groups></skeleton><delta>"), F.coalesce("__delta", F.lit("<note>nothing changed</note>")), F.lit("</delta>"))
    return rows.select(*key, xml_element("page", {**{k: F.col(k).cast("string") for k in key}, "title": F.col("title"), "diff": F.lit("true")}, body).alias("xml"))


def diff_terse(changes: DataFrame, pages: DataFrame, *, key: tuple[str, ...] = ("url",)) -> DataFrame:
    """One text per compared page (key, groups): its groups, and under a heading for each kind of change a line per action."""
    told = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("label", "tool_name", "type")], F.lit(""))
    line = F.concat(F.lit("@"), F.coalesce("id", F.lit("")), F.lit(" "), "breadcrumb", F.lit(" — "), told)
    by_kind = changes.groupBy(*key, "change").agg(_joined(["place"], line, "\n").alias("__in"))
    body = by_kind.groupBy(*key).agg(_joined([_in_order().alias("o")], F.concat(F.lit("## "), "change", F.lit("\n"), "__in"), "\n").alias("__b"))
    rows = pages.join(body, list(key), "left")
    head = F.concat(F.lit("# diff "), F.concat_ws(" ", *[F.col(k).cast("string") for k in key]), F.lit("\ngroups: "), F.array_join("groups", ", "))
    return rows.select(*key, F.concat(head, F.lit("\n"), F.coalesce("__b", F.lit("(no changes)"))).alias("terse"))


def page_groups(acts: DataFrame, *, key: tuple[str, ...] = ("url",), order: str = "pos") -> DataFrame:
    """(key, title, groups) of the pages of a snapshot: its groups in the order in which they are first seen. The title is empty."""
    first = acts.groupBy(*key, "group").agg(F.min(order).alias("__p"))
    return first.groupBy(*key).agg(_joined(["__p"], F.coalesce("group", F.lit("Page")), "\x00").alias("__g")).select(*key, F.lit("").alias("title"), F.split("__g", "\x00").alias("groups"))


def version_diffs(snapshots: DataFrame, *, key: tuple[str, ...] = ("url",), version: str = "version", order: str = "pos") -> DataFrame:
    """Every version of a page against the one before it: snapshots has version numbers that may have gaps."""
    rank = F.dense_rank().over(Window.partitionBy(*key).orderBy(version))
    numbered = snapshots.withColumn("__v", rank)
    after = numbered.withColumn("__pair", F.col("__v"))
    before = numbered.withColumn("__pair", F.col("__v") + 1)
    return diff(before, after, key=(*key, "__pair"), order=order).withColumnRenamed("__pair", "version_no")
