"""Security surface rules: conditions that become findings, their roll-up per page, and the report over pages.

Each rule is a condition with a severity; a family of rules is an array of structs that are kept where their condition
holds. Families read what other operators give: fields of forms, actions, tags of raw pages, headers, cookies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from .dom import Node, extract

SEVERITIES = ("critical", "high", "medium", "low", "info")
#: Paths and labels that are sensitive, names of session cookies.
SENSITIVE_PATH = r"(?iu)/(?:admin|api|debug|backup|config|wp-admin|phpmyadmin|\.env|actuator)(?:/|$)"
SENSITIVE_LABEL = r"(?iuU)\b(admin panel|delete all|reset password|debug mode|export all data)\b"
SESSION_COOKIE = r"(?iu)(session|sess|auth|token|jwt|sid|login|csrf|xsrf|remember|phpssid|connect\.sid)|^__host-|^__secure-"
#: The tag and attribute of mixed content, with severity and rule.
MIXED = (
    ("script", "src", "high", "MIXED_ACTIVE_SCRIPT"),
    ("iframe", "src", "high", "MIXED_ACTIVE_IFRAME"),
    ("link", "href", "high", "MIXED_ACTIVE_STYLESHEET"),
    ("video", "src", "medium", "MIXED_PASSIVE_VIDEO"),
    ("audio", "src", "medium", "MIXED_PASSIVE_AUDIO"),
    ("img", "src", "medium", "MIXED_PASSIVE_IMAGE"),
    ("object", "data", "medium", "MIXED_PASSIVE_OBJECT"),
    ("source", "src", "medium", "MIXED_PASSIVE_SOURCE"),
    ("embed", "src", "medium", "MIXED_PASSIVE_EMBED"),
)
#: The order in which a page's findings are listed before severity sorts them.
FAMILIES = ("headers", "cookies", "forms", "links", "meta", "sri", "mixed", "cors")
COLUMNS = ("page_id", "family", "pos", "severity", "rule_id", "detail", "evidence")


def _rule(condition: Column, severity: str | Column, rule_id: str, detail: str | Column, **evidence: Column) -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail
    level = F.lit(severity) if isinstance(severity, str) else severity
    proof = F.to_json(F.struct(*[c.alias(k) for k, c in evidence.items()])) if evidence else F.lit("{}")
    return F.when(condition, F.struct(level.alias("severity"), F.lit(rule_id).alias("rule_id"), text.alias("detail"), proof.alias("evidence")))


def _emit(rows: DataFrame, family: str, pos: Column, rules: list[Column]) -> DataFrame:
    """The findings of each row, in the order of the rules."""
    kept = F.filter(F.array(*rules), lambda r: r.isNotNull())
    out = rows.select("page_id", pos.cast("long").alias("__pos"), F.posexplode(kept).alias("__k", "r"))
    return out.select("page_id", F.lit(FAMILIES.index(family)).alias("family"), (F.col("__pos") * 16 + F.col("__k")).alias("pos"), "r.*")


def form_findings(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """Rules on forms, from form_fields rows; pages gives page_id and url."""
    named = F.coalesce(F.col("name"), F.col("label"))
    password = F.col("type") == "password"
    weak = password & ~F.map_contains_key("attrs", "minlength") & ~F.map_contains_key("attrs", "pattern")
    listed = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("field_idx", named.alias("n"))))), lambda s: s["n"])
    by_form = fields.groupBy("page_id", "form_idx").agg(F.first("action").alias("action"), F.first("method").alias("method"), listed(password).alias("passwords"), listed(weak).alias("weak"), F.count_if(F.col("type") == "hidden").alias("hidden"), listed(F.col("type") == "file").alias("files"))
    rows = by_form.join(pages.select("page_id", "url"), "page_id").withColumn("target", F.coalesce(F.col("action"), F.col("url")))
    about = {"form_index": F.col("form_idx") + 1, "method": F.col("method"), "action": F.col("target")}
    first = [
        _rule((F.size("passwords") > 0) & (F.col("method") == "GET"), "critical", "FORM_PASSWORD_GET", "a password is sent in the address", **about, fields=F.col("passwords")),
        _rule(urls.is_plain_http(F.col("target")), "high", "FORM_INSECURE_ACTION", F.concat(F.lit("the form is sent over plain HTTP to "), "target"), **about),
    ]
    each = rows.select("*", F.posexplode("weak").alias("w", "field"))
    last = [
        _rule(F.col("hidden") > 3, "low", "FORM_MANY_HIDDEN", F.concat("hidden", F.lit(" hidden fields")), **about, hidden_count=F.col("hidden")),
        _rule(F.size("files") > 0, "medium", "FORM_FILE_UPLOAD", "files can be uploaded", **about, fields=F.col("files")),
    ]
    at = F.col("form_idx") * 1000
    weak_rule = _rule(F.lit(True), "medium", "FORM_WEAK_PASSWORD", "a password field without least length or pattern", **about, field=F.coalesce("field", F.lit("password")))
    return _emit(rows, "forms", at, first).union(_emit(each, "forms", at + 1 + F.col("w"), [weak_rule])).union(_emit(rows, "forms", at + 999, last))


def link_rows(acts: DataFrame, pages: DataFrame) -> DataFrame:
    """The links of actions that lead somewhere: page_id, url, pos, label, href, absolute."""
    href = F.trim(F.coalesce("href", F.lit("")))
    rows = acts.select("page_id", "grouped_pos", F.coalesce("label", F.lit("")).alias("label"), href.alias("href")).filter("href <> '' and href not like '#%'")
    return rows.join(pages.select("page_id", "url"), "page_id").withColumn("absolute", urls.join(F.col("url"), F.col("href")))


def link_findings(acts: DataFrame, pages: DataFrame) -> DataFrame:
    """Rules on links: scripts, plain HTTP, other hosts, sensitive targets."""
    rows = link_rows(acts, pages).filter("href not like 'mailto:%' and href not like 'tel:%'")
    script = F.col("href").startswith("javascript:")
    scripts = _emit(rows.filter(script), "links", F.col("grouped_pos"), [_rule(F.lit(True), "low", "LINK_JAVASCRIPT", F.concat(F.lit("a link runs a script: "), F.substring("label", 1, 80)), href=F.substring("href", 1, 120), label=F.col("label"))])
    web = rows.filter(~script & urls.scheme(F.col("absolute")).isin("http", "https"))
    host, page_host = urls.authority(F.col("absolute")), urls.authority(F.col("url"))
    outside = (page_host != "") & (host != "") & (host != page_host)
    target = urls.path(F.col("absolute"))
    target = F.when(target == "", "/").otherwise(target)
    sensitive = target.rlike(SENSITIVE_PATH) | F.col("label").rlike(SENSITIVE_LABEL)
    web = web.withColumn("__sensitive", sensitive).withColumn("__n", F.sum(sensitive.cast("int")).over(Window.partitionBy("page_id").orderBy("grouped_pos")))
    seen = web.groupBy("page_id").agg(F.sort_array(F.collect_set(F.when(urls.is_plain_http(F.col("absolute")), F.col("absolute")))).alias("plain"), F.sort_array(F.collect_set(F.when(outside, F.col("absolute")))).alias("outside"))
    page_rules = [_rule(urls.is_plain_http(F.col("url")), "high", "PAGE_HTTP", "the page came over plain HTTP", url=F.col("url"))]
    counts = [
        _rule(F.size("plain") > 0, "high", "LINK_HTTP_RESOURCE", F.concat(F.size("plain"), F.lit(" plain HTTP links")), sample=F.slice("plain", 1, 10)),
        _rule(F.size("outside") > 0, "info", "LINK_EXTERNAL", F.concat(F.size("outside"), F.lit(" links to other hosts")), count=F.size("outside"), sample=F.slice("outside", 1, 15)),
    ]
    far = 10**9
    out = scripts.union(_emit(pages, "links", F.lit(far), page_rules)).union(_emit(seen, "links", F.lit(far + 1), counts))
    return out.union(_emit(web.filter("__sensitive and __n <= 10"), "links", F.col("grouped_pos") + far + 2, [_rule(F.lit(True), "medium", "LINK_SENSITIVE_PATH", F.concat(F.lit("a link leads to "), "absolute"), url=F.col("absolute"), label=F.substring("label", 1, 100))]))


def meta_findings(classes: DataFrame) -> DataFrame:
    """Rules on page classes: page_id, url, page_class, reason, n_actions, shadow_hosts, cross_origin_iframes."""
    kind, frames = F.col("page_class"), F.coalesce("cross_origin_iframes", F.lit(0))
    return _emit(
        classes,
        "meta",
        F.lit(0),
        [
            _rule(kind == "Anti-bot", "info", "PAGE_ANTIBOT", F.col("reason"), url=F.col("url")),
            _rule(kind == "Auth-gated", "info", "PAGE_AUTH_GATED", F.col("reason"), url=F.col("url")),
            _rule((kind == "SPA") & (F.col("n_actions") == 0), "low", "PAGE_SPA_EMPTY", "no interactive element was there yet", url=F.col("url"), reason=F.col("reason")),
            _rule(kind.isin("Shadow DOM", "Closed Shadow"), "info", "PAGE_SHADOW_DOM", F.col("reason"), shadow_hosts=F.coalesce("shadow_hosts", F.lit(0))),
            _rule((frames > 0) | (kind == "Iframe-heavy"), "info", "PAGE_CROSS_ORIGIN_IFRAME", "frames of other origins", cross_origin_iframes=frames),
        ],
    )


_WANTED = tuple(dict.fromkeys([m[0] for m in MIXED]))


def _resource_rows(root: Node | None) -> list[dict]:
    return [{"pos": k, "tag": n.tag, "attrs": {a: v for a, v in n.attrs.items() if a in ("src", "href", "data", "rel", "as", "integrity")}} for k, n in enumerate(root.walk() if root else ()) if n.tag in _WANTED]


def resources(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """The elements of raw pages that load something: page_id, url, pos, tag, attrs."""
    return extract(pages, _resource_rows, "pos int, tag string, attrs map<string,string>", html_col=html_col, keep=("page_id", "url"))


def sri_findings(res: DataFrame) -> DataFrame:
    """Scripts and style-like links without an integrity attribute."""
    a, rel = F.col("attrs"), F.col("attrs")["rel"].isin("stylesheet", "preload", "prefetch")
    loads = (F.col("tag") == "script") | ((F.col("tag") == "link") & (F.coalesce(rel, F.lit(False)) | F.coalesce(a["as"].isin("style", "font", "image", "script"), F.lit(False))))
    url = F.coalesce(F.when(F.col("tag") == "script", a["src"]).otherwise(a["href"]), F.lit(""))
    bad = loads & (url != "") & ~url.startswith("data:") & ~url.startswith("#") & (F.coalesce(a["integrity"], F.lit("")) == "")
    order = F.col("pos") + F.when(F.col("tag") == "link", 10**8).otherwise(0)
    return _emit(res.filter(F.col("tag").isin("script", "link")), "sri", order, [_rule(bad, "high", "SRI_MISSING", F.concat("tag", F.lit(" without integrity: "), F.substring(url, 1, 120)), tag=F.col("tag"), url=F.substring(url, 1, 200))])


def mixed_findings(res: DataFrame) -> DataFrame:
    """Plain HTTP resources on HTTPS pages."""
    a = F.col("attrs")
    https = urls.scheme(F.col("url")) == "https"
    rules, order = [], F.lit(0)
    for k, (tag, attr, severity, rule_id) in enumerate(MIXED):
        mine = F.col("tag") == tag
        if tag == "link":
            mine &= F.coalesce(a["rel"].isin("stylesheet", "preload", "prefetch"), F.lit(False))
        order = F.when(F.col("tag") == tag, k * 10**8).otherwise(order)
        rules.append(_rule(https & mine & urls.is_plain_http(a[attr]), severity, rule_id, F.concat(F.substring(a[attr], 1, 200), F.lit(" over plain HTTP")), tag=F.col("tag"), url=F.substring(a[attr], 1, 250)))
    return _emit(res, "mixed", order + F.col("pos"), rules)


def cors_findings(probes: DataFrame) -> DataFrame:
    """Rules on a preflight's reply: page_id, url, origin_sent, acao, acac, allow_methods."""
    acao, acac = F.trim(F.coalesce("acao", F.lit(""))), F.lower(F.trim(F.coalesce("acac", F.lit(""))))
    sent = F.coalesce("origin_sent", F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.authority(F.col("url"))))
    methods = F.coalesce(F.when(F.col("allow_methods") != "", F.col("allow_methods")), F.lit("not sent"))
    return _emit(
        probes,
        "cors",
        F.lit(0),
        [
            _rule(acao == sent, F.when(acac == "true", "high").otherwise("medium"), "CORS_ORIGIN_ECHO", F.concat(F.lit("the origin sent comes back, credentials="), acac), url=F.col("url"), origin_sent=sent, acao_received=acao, acac_received=acac, allow_methods=methods),
            _rule((acao == "*") & (acac == "true"), "critical", "CORS_WILDCARD_WITH_CREDENTIALS", "any origin may read with credentials", url=F.col("url"), allow_methods=methods),
        ],
    )


def lower_headers(headers: Column) -> Column:
    """A header map with names in lower case; of names that then meet, the last counts."""
    return F.map_from_entries(F.transform(F.map_keys(F.map_from_arrays(F.array_distinct(F.transform(F.map_keys(headers), lambda k: F.lower(k))), F.array_distinct(F.transform(F.map_keys(headers), lambda k: F.lower(k))))), lambda n: F.struct(n, F.element_at(F.transform(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == n), lambda e: e["value"]), -1))))


def header_summary(headers: Column) -> Column:
    """The security headers as a struct; a long policy is cut at 240 characters."""
    csp = headers["content-security-policy"]
    short = F.when(F.length(csp) > 240, F.concat(F.substring(csp, 1, 240), F.lit("..."))).otherwise(F.when(csp != "", csp))
    names = ("strict-transport-security", "x-frame-options", "x-content-type-options", "referrer-policy", "permissions-policy", "access-control-allow-origin")
    return F.struct(short.alias("content-security-policy"), *[headers[n].alias(n) for n in names])


def header_findings(responses: DataFrame) -> DataFrame:
    """Rules on response headers: page_id, url, headers (map), probe_status, probe_location."""
    rows = responses.withColumn("h", lower_headers(F.col("headers")))
    h = lambda name: F.coalesce(F.col("h")[name], F.lit(""))
    https = urls.scheme(F.col("url")) == "https"
    hsts, csp, xfo, xcto = h("strict-transport-security"), h("content-security-policy"), h("x-frame-options"), h("x-content-type-options")
    age = F.trim(F.regexp_extract(F.lower(hsts), r"max-age=([^;]*)", 1)).try_cast("bigint")
    status = F.col("probe_status")
    moved = status.isin(301, 302, 307, 308) & ~F.lower(F.coalesce("probe_location", F.lit(""))).startswith("https://")
    return _emit(
        rows,
        "headers",
        F.lit(0),
        [
            _rule(https & (hsts == ""), "high", "HEADER_MISSING_HSTS", "no strict transport security", url=F.col("url")),
            _rule(https & (hsts != "") & (age < 31_536_000), "low", "HEADER_SHORT_HSTS", F.concat(F.lit("strict transport for "), age, F.lit(" seconds only")), max_age=age),
            _rule(csp == "", "medium", "HEADER_MISSING_CSP", "no content security policy", url=F.col("url")),
            _rule(F.lower(csp).rlike("'unsafe-inline'|'unsafe-eval'"), "low", "HEADER_CSP_UNSAFE", "the policy allows inline code or eval", csp_excerpt=F.substring(csp, 1, 200)),
            _rule((csp != "") & ~F.contains(F.lower(csp), F.lit("frame-ancestors")) & (xfo == ""), "medium", "HEADER_MISSING_CLICKJACKING_PROTECTION", "other sites may frame the page", url=F.col("url")),
            _rule((xfo != "") & ~F.upper(xfo).isin("DENY", "SAMEORIGIN"), "low", "HEADER_WEAK_XFO", F.concat(F.lit("frame option "), xfo), value=xfo),
            _rule(xcto == "", "low", "HEADER_MISSING_NOSNIFF", "content types may be guessed", url=F.col("url")),
            _rule((xcto != "") & (F.lower(xcto) != "nosniff"), "low", "HEADER_WEAK_NOSNIFF", F.concat(F.lit("content type option "), xcto), value=xcto),
            _rule(h("access-control-allow-origin") == "*", "info", "HEADER_CORS_WILDCARD", "any origin may read this response", value=h("access-control-allow-origin")),
            _rule(https & moved, "high", "HEADER_HTTP_WEAK_REDIRECT", F.concat(F.lit("plain HTTP gave "), status, F.lit(" to "), F.coalesce("probe_location", F.lit("nowhere"))), status=status, location=F.col("probe_location")),
            _rule(https & (status == 200), "high", "HEADER_HTTP_AVAILABLE", "plain HTTP serves the page", status=status),
            _rule(~https, "high", "PAGE_HTTP", "no encryption: strict transport and secure cookies can't apply", url=F.col("url")),
        ],
    )


def cookie_findings(cookies: DataFrame) -> DataFrame:
    """Rules on cookies: page_id, url, pos, name, domain, path, secure, http_only, same_site."""
    rows = cookies.filter("coalesce(name, '') <> ''").withColumn("same", F.lower(F.coalesce("same_site", F.lit("")))).withColumn("domain", F.coalesce("domain", F.lit(""))).withColumn("path", F.coalesce("path", F.lit("/")))
    https, secure = urls.scheme(F.col("url")) == "https", F.coalesce("secure", F.lit(False))
    session = F.col("name").rlike(SESSION_COOKIE)
    host, domain = urls.authority(F.col("url")), F.lower(F.regexp_replace("domain", r"^\.+", ""))
    fits = (domain == "") | (host == domain) | host.endswith(F.concat(F.lit("."), domain))
    lower = F.lower("name")
    about = {k: F.col(k) for k in ("name", "domain", "path", "secure", "http_only", "same_site")}
    say = lambda text: F.concat(F.lit("cookie "), F.col("name"), F.lit(": " + text))
    return _emit(
        rows,
        "cookies",
        F.col("pos"),
        [
            _rule(https & ~secure, F.when(session, "high").otherwise("medium"), "COOKIE_MISSING_SECURE", say("not secure on an HTTPS page"), **about),
            _rule(session & ~F.coalesce("http_only", F.lit(False)), "high", "COOKIE_MISSING_HTTPONLY", say("scripts can read it"), **about),
            _rule((F.col("same") == "none") & ~secure, "high", "COOKIE_SAMESITE_NONE_INSECURE", say("sent to all sites without secure"), **about),
            _rule(F.col("same") == "", "low", "COOKIE_MISSING_SAMESITE", say("no same-site rule"), **about),
            _rule(lower.startswith("__host-") & ((F.col("domain") != "") | (F.col("path") != "/")), "medium", "COOKIE_HOST_PREFIX_VIOLATION", say("a host cookie has no domain and the path /"), **about),
            _rule(lower.startswith("__host-") & ~secure, "high", "COOKIE_HOST_PREFIX_INSECURE", say("a host cookie is secure"), **about),
            _rule(lower.startswith("__secure-") & ~secure, "high", "COOKIE_SECURE_PREFIX_INSECURE", say("a secure cookie is secure"), **about),
            _rule((host != "") & (F.col("domain") != "") & ~fits, "info", "COOKIE_THIRD_PARTY", say("belongs to another site"), **about),
        ],
    )


def cookie_summary(cookies: DataFrame) -> DataFrame:
    """Per page the flags of its first 25 cookies, without values, and how many more there are."""
    rows = cookies.withColumn("__n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")))
    one = F.struct("pos", "name", "domain", "path", "secure", "http_only", "same_site", (F.coalesce("expires", F.lit(-1.0)) == -1).alias("session"))
    return rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.when(F.col("__n") <= 25, one))).alias("cookies"), F.greatest(F.count("*") - 25, F.lit(0)).alias("truncated"))


def _severity_order() -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))


def roll_up(findings: DataFrame) -> DataFrame:
    """All families' findings, the first of each (rule, detail) of a page, with their place by severity, family and position."""
    order = [_severity_order(), "family", "pos"]
    once = F.row_number().over(Window.partitionBy("page_id", "rule_id", "detail").orderBy(*order))
    rows = findings.withColumn("__n", once).filter("__n = 1").drop("__n")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(*order)))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Per page the findings of each severity and the risk: 100 for a critical one, 25 for a high and 5 for a medium one."""
    counts = findings.groupBy("page_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return counts.withColumn("risk_score", F.col("critical") * 100 + F.col("high") * 25 + F.col("medium") * 5)


def report(counts: DataFrame, pages: DataFrame, *, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(totals, riskiest pages): pages gives page_id, url and error (NULL for a page that was scanned)."""
    rows = pages.join(counts, "page_id", "left").fillna(0, [*SEVERITIES, "risk_score"])
    scanned = F.col("error").isNull()
    totals = rows.agg(F.count_if(scanned).alias("pages_scanned"), F.count_if(~scanned).alias("pages_failed"), *[F.coalesce(F.sum(F.when(scanned, F.col(s))), F.lit(0)).alias(s) for s in SEVERITIES])
    riskiest = rows.filter(scanned).orderBy(F.col("risk_score").desc(), "page_id").limit(most).select("page_id", "url", "risk_score", *SEVERITIES)
    return totals, riskiest


def markdown(totals: DataFrame, riskiest: DataFrame, findings: DataFrame, pages: DataFrame) -> DataFrame:
    """The report as one row of Markdown: summary, the riskiest pages with a risk, and the findings of those pages."""
    t = totals.select(F.concat(F.lit("# Security surface\n\n- Pages scanned: "), "pages_scanned", F.lit("\n- Pages failed: "), "pages_failed", *[F.concat(F.lit(f"\n- {s}: "), F.col(s)) for s in SEVERITIES]).alias("head"))
    top = riskiest.filter("risk_score > 0")
    lines = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("risk_score")).alias("o"), "page_id", F.concat(F.lit("- "), "url", F.lit(" (risk "), "risk_score", F.lit(")")).alias("l")))), lambda s: s["l"]), "\n").alias("top"))
    shown = findings.join(F.broadcast(top.select("page_id", "url")), "page_id")
    each = shown.groupBy("page_id", "url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("- **"), "severity", F.lit("** `"), "rule_id", F.lit("` "), "detail").alias("l")))), lambda s: s["l"]), "\n").alias("l"))
    body = each.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", F.concat(F.lit("## "), "url", F.lit("\n\n"), "l").alias("l")))), lambda s: s["l"]), "\n\n").alias("body"))
    return t.crossJoin(lines).crossJoin(body).select(F.concat_ws("\n\n", "head", F.when(F.col("top") != "", F.concat(F.lit("Riskiest pages:\n"), "top")), F.when(F.col("body") != "", F.col("body")), F.lit("Found by surface rules; no attack was tried.")).alias("markdown"))


def _listed(one: Column, order: list[str]) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, one.alias("__one")))), lambda s: s["__one"])


def page_reports(pages: DataFrame, findings: DataFrame, *, headers: DataFrame | None = None, cookies: DataFrame | None = None) -> DataFrame:
    """One row per page (page_id, url, error): its finding counts, risk, findings in order and, where given, the summaries of its headers (page_id, headers) and cookies.

    A row per page is the report's body at any size; `report_json` and `report_markdown` write one out.
    """
    one = F.struct("severity", "rule_id", "detail")
    found = findings.groupBy("page_id").agg(_listed(one, ["place"]).alias("findings"))
    out = pages.select("page_id", "url", "error").join(severity_counts(findings), "page_id", "left").fillna(0, [*SEVERITIES, "risk_score"]).join(found, "page_id", "left")
    out = out.withColumn("findings", F.coalesce("findings", F.array().cast(out.schema["findings"].dataType)))
    if headers is not None:
        out = out.join(headers.select("page_id", header_summary(lower_headers(F.col("headers"))).alias("http_headers")), "page_id", "left")
    if cookies is not None:
        counted = cookies.groupBy("page_id").agg(F.count("*").alias("cookie_count"))
        out = out.join(cookie_summary(cookies), "page_id", "left").join(counted, "page_id", "left").fillna(0, ["cookie_count", "truncated"])
    return out


def report_json(reports: DataFrame) -> DataFrame:
    """(page_id, json): each page's report as a JSON object; a failed page has its url and error only."""
    counts = F.struct(*SEVERITIES).alias("finding_counts")
    rest = [c for c in ("http_headers", "cookie_count", "cookies", "truncated") if c in reports.columns]
    whole = F.to_json(F.struct("url", counts, "risk_score", "findings", *rest))
    return reports.select("page_id", F.when(F.col("error").isNull(), whole).otherwise(F.to_json(F.struct("url", "error"))).alias("json"))


def report_summary(totals: DataFrame, riskiest: DataFrame, *, seeds: list[str], crawl_depth: int = 0, most_pages: int | None = None, generated_at: Column | None = None) -> DataFrame:
    """One row: the report's head as a JSON object, with the totals and the riskiest pages (five at most) that `report` gives."""
    worst = riskiest.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("risk_score")).alias("o"), "page_id", "url", "risk_score"))), lambda s: F.struct(s["url"].alias("url"), s["risk_score"].alias("risk_score"))).alias("highest_risk_pages"))
    when = F.date_format(F.current_timestamp() if generated_at is None else generated_at, "yyyy-MM-dd'T'HH:mm:ssXXX")
    summary = F.struct("pages_scanned", "pages_failed", F.struct(*SEVERITIES).alias("finding_totals"), "highest_risk_pages")
    head = [when.alias("generated_at"), F.array(*map(F.lit, seeds)).alias("seeds"), F.lit(crawl_depth).alias("crawl_depth"), F.lit(most_pages).cast("int").alias("max_pages")]
    return totals.crossJoin(worst).select(F.to_json(F.struct(*head, summary.alias("summary"))).alias("json"))


def write_json(reports: DataFrame, summary: DataFrame, path: str) -> None:
    """The report as files: a JSON line per page under path/pages, and the head under path/summary."""
    report_json(reports).select(F.col("json").alias("value")).write.mode("overwrite").text(f"{path}/pages")
    summary.select(F.col("json").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def report_markdown(reports: DataFrame) -> DataFrame:
    """(page_id, markdown): a section for each page with its counts, headers, cookies and findings, or its error."""
    lines = [F.concat(F.lit("### "), F.coalesce("url", F.lit("?")))]
    lines += [F.concat(F.lit("- Risk: "), "risk_score", F.lit(" ("), F.concat_ws(", ", *[F.concat(F.lit(f"{s} "), F.col(s)) for s in SEVERITIES]), F.lit(")"))]
    if "http_headers" in reports.columns:
        names = reports.schema["http_headers"].dataType.names
        shown = [F.when(F.coalesce(F.col("http_headers")[n], F.lit("")) != "", F.concat(F.lit(f"- `{n}`: "), F.col("http_headers")[n])) for n in names]
        lines += [F.when(F.concat_ws("", *shown) != "", F.concat_ws("\n", *shown))]
    if "cookies" in reports.columns:
        flags = lambda c: F.concat_ws(", ", F.when(c["secure"], "Secure"), F.when(c["http_only"], "HttpOnly"), F.when(F.coalesce(c["same_site"], F.lit("")) != "", F.concat(F.lit("SameSite="), c["same_site"])))
        one = lambda c: F.concat(F.lit("- cookie `"), F.coalesce(c["name"], F.lit("")), F.lit("` ("), F.coalesce(c["domain"], F.lit("")), F.lit("): "), F.when(flags(c) == "", "no flags").otherwise(flags(c)))
        more = F.when(F.col("truncated") > 0, F.concat(F.lit("- and "), "truncated", F.lit(" cookies more")))
        lines += [F.when(F.size("cookies") > 0, F.array_join(F.transform("cookies", one), "\n")), more]
    each = F.transform("findings", lambda f: F.concat(F.lit("- **["), F.upper(f["severity"]), F.lit("]** `"), f["rule_id"], F.lit("` "), F.coalesce(f["detail"], F.lit(""))))
    lines += [F.when(F.size("findings") > 0, F.array_join(each, "\n")).otherwise(F.lit("No rule has found anything."))]
    failed = F.concat(lines[0], F.lit("\n`"), "error", F.lit("`"))
    return reports.select("page_id", F.when(F.col("error").isNull(), F.concat_ws("\n", *lines)).otherwise(failed).alias("markdown"))


def same_domain_links(acts: DataFrame, pages: DataFrame, *, most: int = 30) -> DataFrame:
    """Per page its links to its own host, without query and fragment, the first of each, at most `most`."""
    rows = link_rows(acts, pages).filter("href not like 'javascript:%'")
    host = urls.authority(F.col("absolute"))
    rows = rows.filter(urls.scheme(F.col("absolute")).isin("http", "https") & (host == urls.authority(F.col("url"))) & (host != ""))
    kept_host = F.regexp_extract("absolute", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    link = F.concat(urls.scheme(F.col("absolute")), F.lit("://"), kept_host, urls.without_end_slash(urls.path(F.col("absolute"))))
    first = rows.groupBy("page_id", "url", link.alias("link")).agg(F.min("grouped_pos").alias("first_pos"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("first_pos"))).filter(F.col("n") <= most)


def crawl_frontier(links: DataFrame, seeds: DataFrame, *, depth: int = 2, most_pages: int | None = None) -> DataFrame:
    """The urls reached from `seeds` (url) over the edges `links` (url, link) within `depth` steps, each with its least depth.

    One anti-join a step, so the loop is as long as the depth; most_pages keeps the first by depth and url.
    """
    key = lambda c: F.regexp_replace(F.regexp_extract(c, "^([^?#]*)", 1), "/+$", "")
    seen = seeds.select(key("url").alias("url")).distinct().withColumn("depth", F.lit(0))
    edge = links.select(key("url").alias("url"), key("link").alias("link")).distinct()
    frontier = seen
    for step in range(1, depth + 1):
        found = frontier.join(edge, "url").select(F.col("link").alias("url")).distinct()
        frontier = found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(step))
        seen = seen.unionByName(frontier)
    if most_pages is None:
        return seen
    return seen.orderBy("depth", "url").limit(most_pages)
