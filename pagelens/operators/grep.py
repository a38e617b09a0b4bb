"""The action filter language. A query is parsed once on the driver into one predicate that Catalyst sees whole.

Clauses, all of which must hold: type:x, group:x or group:"x y", intent:x, id:1,2, href:x, label~x, label~/re/ims,
placeholder~…, and free text. ; and && separate clauses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import xml_element
from .actions import terse_line, to_xml

#: The patterns of intents.
INTENTS = {
    "login": r"login|log\s*in|sign\s*in|signin|password|username",
    "search": r"search|query|find",
    "checkout": r"checkout|payment|billing|cart",
    "fill_form": r"form|submit|subscribe|register|sign\s*up",
    "navigate": r"nav|menu|home|back|forgot",
    "read": r"read|article|details|learn\s*more|more\s*info",
    "extract": r"export|download|copy|print",
    "buy": r"buy|add\s*to\s*cart|purchase",
}
#: Fixed value: how a clause without a pattern reads, by the prefixes in any case; the first form that fits counts.
_CLAUSE = re.compile(r'group:"[^"]*"|group:.+?(?=\s+(?:type:|group:|intent:|id:|label~|placeholder~|href:)|$)|type:\S+|intent:\w+|id:[\d,]+|href:\S+|\S+', re.IGNORECASE | re.DOTALL)


@dataclass(frozen=True)
class Clause:
    """One condition; flags is None for a plain substring."""

    kind: str
    value: str
    flags: str | None = None


def _pattern_clause(field: str, rest: str) -> tuple[Clause, int]:
    """A label~ or placeholder~ clause at the start of rest, and the characters it takes. A pattern runs to the last slash."""
    last = rest.rfind("/") if rest.startswith("/") else 0
    if last > 0:
        flags = re.match("[ims]*", rest[last + 1 :])[0]
        return Clause(field, rest[1:last], flags or "i"), last + 1 + len(flags)
    word = rest if rest.startswith("/") else (re.match(r"\S+", rest) or [rest])[0]
    return Clause(field, word.strip().lower()), len(word)


def parse(query: str | None) -> list[Clause]:
    """The clauses of a query, in order."""
    out: list[Clause] = []
    for part in (query or "").split(";"):
        part = part.strip()
        while part:
            field = next((f for f in ("label", "placeholder") if part.startswith(f + "~")), None)
            if field:
                clause, used = _pattern_clause(field, part[len(field) + 1 :])
                out.append(clause)
                part = part[len(field) + 1 + used :].lstrip()
                continue
            text = _CLAUSE.match(part)[0]
            part = part[len(text) :].lstrip()
            text = text.strip()
            kind = next((k for k in ("type", "group", "intent", "id", "href") if text.startswith(k + ":")), None)
            if text == "&&":
                continue
            value = text if kind is None else text[len(kind) + 1 :].strip()
            if kind == "group" and len(value) > 1 and value[0] == value[-1] == '"':
                value = value[1:-1]
            out.append(Clause(kind or "text", value if kind == "id" else value.lower()))
    return out


def _field(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def action_text() -> Column:
    return F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("label", "placeholder", "group", "type", "href")])


def predicate(clause: Clause, keep: tuple[str, ...] = ("page_id",), by_group: bool = True) -> Column:
    """The condition of one clause. Free text that hits a group's name on a page restricts to such groups there."""
    v = clause.value
    if clause.kind == "type":
        return F.lower(_field("type")).startswith(v)
    if clause.kind == "group":
        return F.lower(_field("group")) == v
    if clause.kind == "intent":
        return action_text().rlike(f"(?iuU){INTENTS[v]}") if v in INTENTS else F.lit(False)
    if clause.kind == "id":
        ids = [x.strip() for x in v.split(",") if x.strip()]
        return F.col("id").isin(ids) if ids else F.lit(False)
    if clause.kind == "href":
        return F.contains(F.lower(_field("href")), F.lit(v))
    if clause.kind in ("label", "placeholder"):
        if clause.flags is not None:
            return _field(clause.kind).rlike(f"(?{''.join(sorted(set(clause.flags)))}uU){v}")
        return F.contains(F.lower(_field(clause.kind)), F.lit(v))
    in_text = F.contains(F.lower(action_text()), F.lit(v))
    if not by_group or not v:
        return in_text
    in_name = F.contains(F.lower(_field("group")), F.lit(v))
    return F.when(F.max(in_name).over(Window.partitionBy(*keep)), in_name).otherwise(in_text)


def grep(acts: DataFrame, query: str | None, *, keep: tuple[str, ...] = ("page_id",), by_group: bool = True) -> DataFrame:
    """The actions that meet every clause; all of them for a blank query. Group names are looked for on the whole page."""
    clauses = parse(query)
    if not clauses:
        return acts
    names = [f"__c{k}" for k in range(len(clauses))]
    windowed = [c.kind == "text" and by_group and bool(c.value) for c in clauses]
    plain = [predicate(c, keep, by_group) for c, w in zip(clauses, windowed, strict=True) if not w]
    for name, c, w in zip(names, clauses, windowed, strict=True):
        if w:  # windows come before the filters: they look at all actions of a page
            acts = acts.withColumn(name, predicate(c, keep, by_group))
    flags = [F.col(n) for n, w in zip(names, windowed, strict=True) if w]
    return acts.filter(reduce(lambda a, b: a & b, [*plain, *flags])).drop(*names)


def grep_pages(acts: DataFrame, query: str, *, fmt: str = "result", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per page with a match: count and total, and for fmt terse or xml the rendering."""
    total = acts.groupBy(*keep).agg(F.count("*").alias("total"))
    hits = grep(acts, query, keep=keep)
    if fmt == "list":
        return hits
    found = hits.groupBy(*keep).agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("grouped_pos", terse_line().alias("l")))).alias("__l"))
    out = total.join(found, list(keep), "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    if fmt == "terse":
        head = F.when(F.col("count") > 0, F.concat(F.lit(f"# grep: {query} ("), "count", F.lit("/"), "total", F.lit(")\n"), F.array_join(F.transform("__l", lambda s: s["l"]), "\n"))).otherwise(F.lit(f"# grep: {query}\n(no matches)"))
        return out.select(*keep, "count", "total", head.alias("terse"))
    if fmt == "xml":
        xml = to_xml(hits, keep=keep, title=F.lit("Query"))
        none = xml_element("page", {"url": F.lit("about:blank"), "title": F.lit("Query")}, xml_element("query", {"text": F.lit(query), "count": F.lit("0")}))
        return out.join(xml, list(keep), "left").select(*keep, "count", "total", F.coalesce("xml", none).alias("xml"))
    return out.drop("__l")


#: Words in labels of links that are no results.
JUNK_LABELS = ("settings", "sign in", "privacy", "terms", "advertise", "help", "report a concern", "suggestions", "cookie", "search again", "see full list", "skip to content", "accessibility", "feedback", "rewards")


def search_results(acts: DataFrame, *, excluded_hosts: tuple[str, ...] = (), junk: tuple[str, ...] = JUNK_LABELS, keep: tuple[str, ...] = ("page_id",), most: int = 10) -> DataFrame:
    """Links that look like search results: to other sites, with a label of 12 characters or more; the first of each href."""
    text = F.lower(_field("label"))
    wanted = F.lower(_field("href")).startswith("http") & (F.length(_field("label")) >= 12)
    for host in excluded_hosts:
        wanted &= ~F.contains(F.lower(_field("href")), F.lit(host))
    for phrase in junk:
        wanted &= ~F.contains(text, F.lit(phrase))
    first = F.row_number().over(Window.partitionBy(*keep, "href").orderBy("pos"))
    rows = acts.filter(wanted).withColumn("__n", first).filter("__n = 1")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keep).orderBy("pos"))).filter(F.col("rank") <= most).drop("__n")
