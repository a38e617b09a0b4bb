"""Page classes, readiness of captures replayed from probe logs, consent buttons, and the accessibility supplement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import fuzzy_ratio
from ..functions.text import squeeze, xml_element, xml_escape
from .dom import Node, clean, extract, scope

#: Markers of walls against bots, and the size up to which a page may be one.
BOT_MARKERS = ("captcha", "cloudflare", "bot detection", "robot check", "just a moment")
#: Fixed values of readiness: text that is enough, text beside cards or prices, text of a shell, polls and scrolls.
READY_TEXT, CARD_TEXT, CARDS, SHELL_TEXT = 800, 400, 4, 250
TIMEOUT_MS, POLL_MS, MOST_SCROLLS, STAGNANT = 10_000, 400, 6, 2
#: Interactive roles of the accessibility tree, with the tag and input type that stands for each.
ROLES = {
    "button": ("button", None),
    "link": ("a", None),
    "textbox": ("input", None),
    "searchbox": ("input", "search"),
    "combobox": ("select", None),
    "checkbox": ("input", "checkbox"),
    "radio": ("input", "radio"),
    "menuitem": ("button", None),
    "menuitemcheckbox": ("button", None),
    "menuitemradio": ("button", None),
    "tab": ("button", None),
    "switch": ("button", None),
    "slider": ("input", "range"),
    "spinbutton": ("input", "number"),
    "listbox": ("select", None),
    "option": ("option", None),
}


def _int(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long"))


def page_class(rows: DataFrame) -> DataFrame:
    """rows with url, html, n_actions, shadow_hosts, cross_origin_iframes, a11y_nodes and, from readiness, shell, has_body
    and text_chars (all three NULL where no readiness ran); adds page_class and reason. The first case that fits counts."""
    html, url = F.lower(F.coalesce("html", F.lit(""))), F.lower(F.coalesce("url", F.lit("")))
    size = F.length(html)
    marked = F.lit(False)
    for marker in BOT_MARKERS:
        marked |= F.contains(html, F.lit(marker))
    waited = F.col("shell").isNotNull() | F.col("has_body").isNotNull() | F.col("text_chars").isNotNull()
    shell = F.coalesce(F.col("shell"), F.lit(False)) | ~F.coalesce(F.col("has_body"), F.lit(True)) | ((_int("text_chars") <= 250) & (size >= 20_000) & (_int("n_actions") <= 5))
    gated = F.contains(url, F.lit("login")) | F.contains(url, F.lit("signin")) | F.contains(url, F.lit("authorize"))
    hosts = _int("shadow_hosts")
    cases = [
        ((size < 15_000) & marked, "Anti-bot", F.lit("a small page with marks of a wall against bots")),
        (waited & shell, "SparseShell", F.concat(F.lit("still a shell after waiting: "), _int("text_chars"), F.lit(" characters, "), _int("n_actions"), F.lit(" actions"))),
        (gated, "Auth-gated", F.lit("the address is a login page")),
        ((_int("n_actions") == 0) & (size > 1000), "SPA", F.lit("no interactive elements yet")),
        ((hosts > 0) & (_int("a11y_nodes") > 0), "Closed Shadow", F.concat(hosts, F.lit(" shadow hosts, closed ones among them"))),
        (hosts > 0, "Shadow DOM", F.concat(hosts, F.lit(" open shadow hosts"))),
        (_int("cross_origin_iframes") > 0, "Iframe-heavy", F.concat(_int("cross_origin_iframes"), F.lit(" frames of other origins"))),
    ]
    kind, reason = F.lit("Static"), F.lit("a page with a static layout")
    for condition, name, why in reversed(cases):
        kind, reason = F.when(condition, name).otherwise(kind), F.when(condition, why).otherwise(reason)
    return rows.withColumn("page_class", kind).withColumn("reason", reason)


def probe_ready(previous_text: Column | None = None) -> Column:
    """Whether a probe shows a page that is ready: much text, cards or prices with some, or text that no longer grows."""
    text = _int("text_chars")
    settled = F.lit(False)
    if previous_text is not None:
        last = F.coalesce(previous_text.cast("long"), F.lit(0))
        settled = (text >= READY_TEXT) & (last > 0) & (F.abs(text - last) <= F.greatest(F.lit(80), F.floor(text * 0.05)))
    some = (text >= CARD_TEXT) & ((_int("card_candidates") >= CARDS) | (_int("price_hits") >= 3))
    return F.coalesce(F.col("has_body"), F.lit(False)) & ((text >= 2000) | some | settled)


def sparse_shell() -> Column:
    """Whether a probe shows a shell: next to no text, or little beside much markup, or only a consent dialog."""
    text, size = _int("text_chars"), _int("html_chars")
    bare = (_int("card_candidates") == 0) & (_int("price_hits") == 0)
    little = (size >= 20_000) & ((text <= SHELL_TEXT) | ((text < 500) & bare))
    return ~F.coalesce(F.col("has_body"), F.lit(False)) | (text <= 40) | little | (F.coalesce(F.col("consent_only"), F.lit(False)) & bare & (text < 2000))


def probe_log(probes: DataFrame, *, key: str = "url", order: str = "at") -> DataFrame:
    """probes in order per page, with ready, shell, grew (against the probe before) and wants_scroll."""
    by_page = Window.partitionBy(key).orderBy(order)
    rows = probes.withColumn("__last", F.lag("text_chars").over(by_page)).withColumn("ready", probe_ready(F.col("__last"))).withColumn("shell", sparse_shell())
    more = lambda c, by: _int(c) > F.coalesce(F.lag(c).over(by_page).cast("long"), F.lit(0)) + by
    rows = rows.withColumn("grew", F.col("__last").isNotNull() & (more("text_chars", 40) | more("card_candidates", 0) | more("price_hits", 0)))
    stale = F.sum((F.col("__last").isNotNull() & ~F.col("grew")).cast("int")).over(by_page.rowsBetween(1 - STAGNANT, 0))
    dense = (_int("text_chars") >= READY_TEXT) | ((_int("card_candidates") >= CARDS) & (_int("text_chars") >= CARD_TEXT))
    allowed = (F.row_number().over(by_page) <= MOST_SCROLLS) & (stale < STAGNANT)
    return rows.withColumn("wants_scroll", allowed & F.coalesce(F.col("has_body"), F.lit(False)) & ~(F.col("shell") & (_int("text_chars") < 100)) & ~dense).drop("__last")


def replay_readiness(probes: DataFrame, *, key: str = "url", order: str = "at") -> DataFrame:
    """One row per page: whether a probe within the time was ready, the probe that decided (the first ready, else the last), and why."""
    rows = probe_log(probes, key=key, order=order).withColumn("__since", F.col(order) - F.min(order).over(Window.partitionBy(key)))
    in_time = F.col("__since") <= TIMEOUT_MS
    state = F.struct("text_chars", "html_chars", "card_candidates", "price_hits", "shell", F.col("__since").alias("wait_ms"))
    out = rows.filter(in_time).groupBy(key).agg(F.min_by(F.when(F.col("ready"), state), F.when(F.col("ready"), F.col(order))).alias("r"), F.max_by(state, F.col(order)).alias("l"), F.count("*").alias("n_probes"))
    s = F.coalesce("r", "l")
    ready = F.col("r").isNotNull()
    shell = ~ready & F.col("l.shell")
    return out.select(key, ready.alias("ready"), shell.alias("shell"), F.when(ready, "ready").when(shell, "sparse_shell").otherwise("timeout").alias("why"), *[s[n].alias(n) for n in ("text_chars", "html_chars", "card_candidates", "price_hits", "wait_ms")], "n_probes")


#: Labels of buttons that accept cookies, and words that refuse.
ACCEPT = (
    "accept all", "accept all cookies", "allow all", "allow cookies", "accept cookies", "i agree", "i accept", "agree and continue", "got it",
    "agree", "accept", "allow", "consent", "continue", "alle akzeptieren", "alles akzeptieren", "akzeptieren und weiter", "akzeptieren", "zustimmen",
    "einverstanden", "alle zulassen", "tout accepter", "accepter tout", "accepter", "j'accepte", "aceptar todo", "aceptar todas", "aceptar",
    "acepto", "принять все", "принять всё", "согласен", "согласна", "разрешить", "принять", "соглашаюсь", "accetta tutto", "accetta tutti",
    "accetta", "accetto", "aceitar todos", "aceitar tudo", "aceitar", "concordo", "zaakceptuj wszystkie", "zaakceptuj", "akceptuję", "accepteren",
    "alles toestaan",
)
REFUSE = ("reject", "decline", "deny", "refuse", "necessary only", "ablehnen", "nur erforderliche", "refus", "rechazar", "отклонить", "только необходимые", "rifiuta", "recusar")
#: Prices and consent words as a probe of visible text counts them, and elements whose children may be cards.
PROBE_PRICE = r"(?iu)(?:€|\$|£|¥|₽)\s?\d|(?:\d[\d.,\s]{0,12}\s?(?:€|\$|£|¥|₽|eur|usd|gbp|rub|руб))"
PROBE_CONSENT = "cookie|privacy|consent|we use cookies|datenschutz|akzeptieren|alle akzeptieren"
CARD_PARENTS = ("div", "ul", "ol", "section", "main")


def consent_buttons(acts: DataFrame, *, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Per page the button that accepts cookies: an exact phrase scores 100 and its length, one held in the label 50 and its length; labels of 80 characters at most, none that refuses."""
    label = F.lower(squeeze(F.col("label")))
    score = F.lit(0)
    for phrase in ACCEPT:
        score = F.greatest(score, F.when(label == phrase, 100 + len(phrase)).when(F.contains(label, F.lit(phrase)), 50 + len(phrase)).otherwise(0))
    refused = F.lit(False)
    for word in REFUSE:
        refused |= F.contains(label, F.lit(word))
    rows = acts.filter((F.length(label) <= 80) & ~refused).withColumn("score", score).filter("score > 0")
    best = F.row_number().over(Window.partitionBy(*keep).orderBy(F.col("score").desc(), "pos"))
    return rows.withColumn("__n", best).filter("__n = 1").select(*keep, "id", "label", "score")


def _probe_rows(root: Node | None) -> list[dict]:
    """Visible text and the greatest set of like children with text, as a browser's probe would see them."""
    if root is None:
        return [{"has_body": False, "visible": "", "card_candidates": 0}]
    hidden = ("script", "style", "noscript", "template", "head")
    parts: list[str] = []

    def gather(node: Node) -> None:
        if node.tag and node.tag not in hidden:
            parts.append(node.text)
            for child in node.children:
                gather(child)
                parts.append(child.tail)

    top = scope(root)
    gather(top)
    cards = 0
    for node in top.walk():
        if node.tag in CARD_PARENTS or node.attrs.get("role") == "list":
            full = [c.tag for c in node.children if c.tag and c.tag not in hidden and any(k.tag for k in c.children) and len(clean(c.content())) >= 16]
            most = max((full.count(t) for t in set(full)), default=0)
            if most >= 4 and most >= 0.6 * len(full):
                cards = max(cards, most)
    return [{"has_body": True, "visible": " ".join("".join(parts).split()), "card_candidates": cards}]


def probes_of(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """One probe per stored page: has_body, text_chars, html_chars, card_candidates, price_hits, consent_only."""
    rows = extract(pages.select("page_id", F.col(html_col).alias("html"), F.length(html_col).alias("html_chars")), _probe_rows, "has_body boolean, visible string, card_candidates int", keep=("page_id", "html_chars"))
    prices = F.regexp_count("visible", F.lit(PROBE_PRICE))
    content = (prices > 0) | (F.col("card_candidates") > 0) | (F.length("visible") >= 2000)
    consent = F.lower("visible").rlike(PROBE_CONSENT) & ~content
    return rows.select("page_id", "has_body", F.length("visible").alias("text_chars"), "html_chars", "card_candidates", prices.alias("price_hits"), consent.alias("consent_only"))


def ax_nodes(raw: DataFrame, *, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Interactive nodes of an accessibility tree: raw has pos, ignored, role, name, value, backend_id. The first of each
    (backend_id, role); a name falls back to the value."""
    rows = raw.filter(~F.coalesce("ignored", F.lit(False)) & F.col("role").isin(*ROLES) & (F.coalesce("backend_id", F.lit(0)) != 0))
    first = F.row_number().over(Window.partitionBy(*keep, "backend_id", "role").orderBy("pos"))
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("value"), F.lit(""))
    return rows.withColumn("__n", first).filter("__n = 1").select(*keep, "pos", "role", name.alias("name"), "backend_id", "value")


def ax_supplement(nodes: DataFrame, labels: DataFrame, *, threshold: float = 0.85, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Accessibility nodes that no label of the page covers (labels: label), numbered as sw-a11y-n, with tag, type and markup.

    Only names and labels of one page meet, each once. Those that are equal or hold one another are settled as expressions;
    the others are compared in Python where their lengths allow the threshold.
    """
    names = nodes.filter("name <> ''").select(*keep, "name").distinct()
    known = labels.filter("label <> ''").select(*keep, "label").distinct()
    x, y = F.trim(F.lower("name")), F.trim(F.lower("label"))
    holds = (F.contains(x, y) | F.contains(y, x)) if threshold <= 0.92 else x == y
    plain = names.join(known, list(keep)).filter((x == y) | holds).select(*keep, "name").distinct()
    near = 2 * F.least(F.length(x), F.length(y)) >= threshold * (F.length(x) + F.length(y))
    left = names.join(plain, [*keep, "name"], "left_anti").join(known, list(keep)).filter(near)
    covered = plain.unionByName(left.filter(fuzzy_ratio(F.col("name"), F.col("label")) >= threshold).select(*keep, "name").distinct())
    rows = nodes.join(covered, [*keep, "name"], "left_anti")
    bind = F.concat(F.lit("sw-a11y-"), F.row_number().over(Window.partitionBy(*keep).orderBy("pos")))
    tag, kind = F.lit("button"), F.lit(None).cast("string")
    for role, (t, k) in ROLES.items():
        tag = F.when(F.col("role") == role, t).otherwise(tag)
        kind = F.when(F.col("role") == role, F.lit(k)).otherwise(kind)
    rows = rows.withColumn("bind_id", bind).withColumn("tag", tag).withColumn("input_type", kind)
    shown = F.when(F.col("name") != "", F.col("name")).otherwise(F.col("role"))
    parts = [F.lit("<"), "tag", F.lit(' data-sw-bind="'), "bind_id", F.lit('" data-sw-source="a11y"'), F.when(F.col("name") != "", F.concat(F.lit(' aria-label="'), xml_escape(F.col("name")), F.lit('"'))).otherwise("")]
    parts += [F.when(F.col("input_type").isNotNull(), F.concat(F.lit(' type="'), "input_type", F.lit('"'))).otherwise(""), F.when(F.col("tag") == "a", ' href="#"').otherwise(""), F.lit(">"), xml_escape(shown), F.lit("</"), "tag", F.lit(">")]
    return rows.withColumn("markup", F.concat(*parts))


def merge_captures(pages: DataFrame, supplement: DataFrame, *, mode: str = "dual") -> DataFrame:
    """pages (page_id, html, shadow_hosts) with the supplement's markup before </body>; mode is dom, a11y, dual or auto (only where there are shadow hosts)."""
    if mode == "dom":
        return pages.withColumn("a11y_nodes", F.lit(0).cast("long"))
    extra = supplement.groupBy("page_id").agg(F.count("*").alias("a11y_nodes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "markup"))), lambda s: s["markup"]), "").alias("__m"))
    rows = pages.join(extra, "page_id", "left").withColumn("a11y_nodes", F.coalesce("a11y_nodes", F.lit(0).cast("long")))
    section = F.concat(F.lit('<section data-sw-a11y-supplement="true">'), "__m", F.lit("</section>"))
    if mode == "a11y":
        return rows.withColumn("html", F.concat(F.lit("<body>"), F.coalesce(section, F.lit("")), F.lit("</body>"))).drop("__m")
    at = F.instr("html", "</body>")
    joined = F.when(at > 0, F.concat(F.substring("html", F.lit(1), at - 1), section, F.substring("html", at, F.length("html")))).otherwise(F.concat("html", section))
    wanted = F.col("__m").isNotNull() & ((F.coalesce("shadow_hosts", F.lit(0)) > 0) if mode == "auto" else F.lit(True))
    return rows.withColumn("html", F.when(wanted, joined).otherwise(F.col("html"))).withColumn("a11y_nodes", F.when(wanted, F.col("a11y_nodes")).otherwise(0)).drop("__m")


def webmcp_tools(pages: DataFrame, *, json_col: str = "tools") -> DataFrame:
    """Tools that a page offers, from its JSON array: name, description, input_schema (JSON text), and their place."""
    kind = "array<struct<name:string,description:string,inputSchema:string,input_schema:string>>"
    rows = pages.select("page_id", F.posexplode(F.from_json(json_col, kind)).alias("pos", "t")).filter("coalesce(t.name, '') <> ''")
    return rows.select("page_id", "pos", "t.name", F.coalesce("t.description", F.lit("")).alias("description"), F.coalesce("t.inputSchema", "t.input_schema", F.lit("{}")).alias("input_schema"))


def webmcp_actions(tools: DataFrame) -> DataFrame:
    """Tools as rows of the action map."""
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return tools.select("page_id", n.alias("pos"), n.cast("string").alias("id"), F.lit("webmcp_tool").alias("type"), F.coalesce(F.when(F.col("description") != "", F.col("description")), F.col("name")).alias("label"), F.col("name").alias("tool_name"), F.lit("WebMCP Tools").alias("group"), "input_schema")


def webmcp_terse(tools: DataFrame) -> DataFrame:
    """One text per page: how many tools, and a line for each with its number, name and description."""
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    line = F.trim(F.concat(F.lit("@"), "n", F.lit(" tool:"), "name", F.lit(" "), "description"))
    rows = tools.withColumn("n", n)
    return rows.groupBy("page_id").agg(F.concat(F.lit("# webmcp tools ("), F.count("*"), F.lit(")\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda s: s["l"]), "\n")).alias("terse"))


def webmcp_xml(tools: DataFrame, pages: DataFrame) -> DataFrame:
    """One XML text per page (page_id, url, title): its tools as actions, with a label of 200 characters and a schema of 500 at most."""
    acts = webmcp_actions(tools)
    one = xml_element("action", {"id": F.col("id"), "type": F.col("type"), "tool_name": F.col("tool_name"), "label": F.substring("label", 1, 200), "input_schema": F.substring("input_schema", 1, 500)})
    body = acts.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("x")))), lambda s: s["x"]), "").alias("b"))
    rows = body.join(pages.select("page_id", "url", "title"), "page_id")
    group = xml_element("group", {"name": F.lit("WebMCP Tools")}, F.col("b"))
    return rows.select("page_id", xml_element("page", {"url": F.col("url"), "title": F.col("title"), "mode": F.lit("webmcp")}, group).alias("xml"))
