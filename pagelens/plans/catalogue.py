"""The registered page queries and their oracle SQL.

Where the page table has no markup of a kind (tables, forms, headers, cookies), the query renders it from the relational
tables first and reads it back, so that plain SQL over those tables says what must come out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import actions, blocks, classify, compare, diff, dom, forms, grep, heal, schema, security
from ..sources.tables import table
from ..streaming import state

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.actions(_pages(spark, sf_dir))


# SQL that reads the links of the page table: each is <a href="…">…</a> in the page's navigation.
_UNESCAPE = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"
_LINKS = f"""links AS (
  SELECT page_id, url, pos, {_UNESCAPE.format("hrefs[pos]")} AS href,
         trim(regexp_replace({_UNESCAPE.format("labels[pos]")}, '\\s+', ' ', 'g')) AS label
  FROM (SELECT page_id, url, unnest(range(1, len(hrefs) + 1)) AS pos, hrefs, labels
        FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
                     regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS labels FROM pages)))"""


@_query("SELECT page_id, 'Navigation' AS \"group\", len(regexp_extract_all(html, '<a href=\"')) AS n FROM pages WHERE len(regexp_extract_all(html, '<a href=\"')) > 0")
def links_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page by semantic group."""
    return _actions(spark, sf_dir).groupBy("page_id", "group").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_per_group(spark, sf_dir)


@_query(f"WITH {_LINKS} SELECT page_id, CAST(pos AS VARCHAR) AS id, 'a' AS type, nullif(substr(label, 1, 100), '') AS label, nullif(href, '') AS href, 'Navigation' AS \"group\" FROM links")
def action_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _actions(spark, sf_dir).select("page_id", "id", "type", "label", "href", "group")


def _grep_oracle(condition: str) -> str:
    return f"WITH {_LINKS} SELECT page_id, CAST(pos AS VARCHAR) AS id, nullif(label, '') AS label FROM links WHERE {condition}"


def _grep(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return grep.grep(_actions(spark, sf_dir), query).select("page_id", "id", "label")


def _menu_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per customer: a menu, the form of its page, and a footer link that half of them have."""
    forms_ = _form_pages(spark, sf_dir).select("page_id", F.regexp_extract("html", "(<form.*</form>)", 1).alias("form"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), "c_mktsegment")
    menu = F.concat(F.lit('<nav><a href="/c'), "page_id", F.lit('">Start</a><a href="/seg/'), "c_mktsegment", F.lit('">About '), "c_mktsegment", F.lit("</a></nav>"))
    foot = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<footer><a href="/read/'), "page_id", F.lit('">Read more</a></footer>'))).otherwise(F.lit(""))
    return forms_.join(c, "page_id").select("page_id", F.concat(F.lit("<html><body>"), menu, "form", foot, F.lit("</body></html>")).alias("html"))


# The actions of those pages: a row each.
_MENU = """menu AS (SELECT c_custkey AS page_id, a.pos, a.type, CASE a.pos WHEN 2 THEN 'About ' || c_mktsegment ELSE a.label END AS label,
  CASE a.pos WHEN 1 THEN '/c' || c_custkey WHEN 2 THEN '/seg/' || c_mktsegment WHEN 9 THEN '/read/' || c_custkey END AS href, a.grp
  FROM customer CROSS JOIN (VALUES (1, 'a', 'Start', 'Navigation'), (2, 'a', '', 'Navigation'), (3, 'input[email]', 'email', 'Login Form'), (4, 'input[text]', 'company', 'Login Form'),
    (5, 'input[password]', 'pw', 'Login Form'), (6, 'select', 's1s2s3', 'Login Form'), (7, 'textarea', 'about_you', 'Login Form'), (8, 'button', 'Sign up', 'Login Form'), (9, 'a', 'Read more', 'Footer')) a(pos, type, label, grp)
  WHERE a.pos < 9 OR c_custkey % 2 = 0)"""


def _menu_oracle(condition: str) -> str:
    return f"WITH {_MENU} SELECT page_id, CAST(pos AS VARCHAR) AS id, label FROM menu WHERE {condition}"


def _menu_grep(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return grep.grep(actions.actions(_menu_pages(spark, sf_dir)), query).select("page_id", "id", "label")


@_query(f"WITH {_MENU} SELECT page_id, CAST(pos AS VARCHAR) AS id, type, label, href, grp AS \"group\" FROM menu")
def menu_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of several groups and kinds."""
    return actions.actions(_menu_pages(spark, sf_dir)).select("page_id", "id", "type", "label", "href", "group")


@_query(_menu_oracle("starts_with(type, 'input[p')"))
def grep_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _menu_grep(spark, sf_dir, "type:input[p")


@_query(_grep_oracle("contains(lower(href), 'th') AND pos IN (1, 3, 5)"))
def grep_href_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grep(spark, sf_dir, "href:th; id:1,3,5")


@_query(_grep_oracle("regexp_matches(label, '^th.*e', 'i')"))
def grep_label_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grep(spark, sf_dir, "label~/^th.*e/i")


@_query(_menu_oracle("grp = 'Login Form' AND starts_with(type, 'select')"))
def grep_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _menu_grep(spark, sf_dir, 'group:"Login Form" && type:select')


@_query(_menu_oracle("grp = 'Navigation'"))
def grep_group_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text that hits a group's name takes the whole group."""
    return _menu_grep(spark, sf_dir, "navig")


@_query(" UNION ALL ".join(
    f"SELECT * FROM (WITH {_MENU} SELECT '{name}' AS intent, page_id, CAST(pos AS VARCHAR) AS id FROM menu WHERE regexp_matches(concat_ws(' ', label, grp, type, href), '{pattern}', 'i'))"
    for name, pattern in grep.INTENTS.items()
))
def grep_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every intent over the same pages."""
    acts = actions.actions(_menu_pages(spark, sf_dir))
    each = [grep.grep(acts, f"intent:{name}").select(F.lit(name).alias("intent"), "page_id", "id") for name in grep.INTENTS]
    return reduce(DataFrame.unionByName, each)


@_query(_menu_oracle("contains(lower(concat_ws(' ', label, grp, type, href)), 'about build')"))
def grep_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _menu_grep(spark, sf_dir, "about && build")


@_query(f"WITH {_LINKS} SELECT page_id, count(*) AS total, count(*) FILTER (WHERE contains(lower(label), 'the')) AS \"count\" FROM links GROUP BY page_id")
def grep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.grep_pages(_actions(spark, sf_dir), "label~the").select("page_id", "total", "count")


# The links of the page table as lines and as XML.
_LINE = "trim('@' || pos || ' a ' || substr(label, 1, 100) || ' [Navigation]')"
_ESCAPE = "replace(replace(replace(replace({}, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;')"
_ACTION = "'<action id=\"' || pos || '\" type=\"a\"' || coalesce(' label=\"' || " + _ESCAPE.format("nullif(substr(label, 1, 100), '')") + " || '\"', '') || coalesce(' href=\"' || " + _ESCAPE.format("nullif(href, '')") + " || '\"', '') || ' group=\"Navigation\"/>'"


@_query(f"WITH {_LINKS} SELECT page_id, count(*) AS \"count\", count(*) AS total, '# grep: type:a (' || count(*) || '/' || count(*) || ')' || chr(10) || string_agg({_LINE}, chr(10) ORDER BY pos) AS terse FROM links GROUP BY page_id")
def grep_terse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.grep_pages(_actions(spark, sf_dir), "type:a", fmt="terse")


@_query(f"""WITH {_LINKS}, h AS (SELECT *, contains(lower(substr(label, 1, 100)), 'the') AS hit FROM links)
SELECT page_id, count(*) FILTER (WHERE hit) AS "count", count(*) AS total,
  '<page url="about:blank" title="Query">' || CASE WHEN count(*) FILTER (WHERE hit) > 0 THEN '<group name="Navigation">' || string_agg({_ACTION}, chr(10) ORDER BY pos) FILTER (WHERE hit) || '</group>'
    ELSE '<query text="label~the" count="0"/>' END || '</page>' AS xml FROM h GROUP BY page_id""")
def grep_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.grep_pages(_actions(spark, sf_dir), "label~the", fmt="xml")


@_query(
    f"WITH {_LINKS} SELECT page_id, string_agg('@' || pos || ' a ' || CASE WHEN label = '' THEN '' ELSE substr(label, 1, 100) END || ' [Navigation]', chr(10) ORDER BY pos) AS terse FROM links GROUP BY page_id"
)
def actions_terse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.to_terse(_actions(spark, sf_dir))


@_query(f"""WITH {_LINKS} SELECT page_id, '<page url="about:blank" title=""><group name="Navigation">' || string_agg({_ACTION}, chr(10) ORDER BY pos) || '</group></page>' AS xml FROM links GROUP BY page_id""")
def actions_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.to_xml(_actions(spark, sf_dir))


@_query(f"WITH {_LINKS} SELECT p.page_id, p.url, count(l.pos) AS n_actions, CASE WHEN count(l.pos) > 0 THEN 1 ELSE 0 END AS n_groups, CASE WHEN count(l.pos) > 0 THEN 'Navigation=' || count(l.pos) ELSE '' END AS groups FROM pages p LEFT JOIN links l ON p.page_id = l.page_id GROUP BY p.page_id, p.url")
def page_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return actions.page_response(actions.actions(pages), pages, detail="minimal")


@_query("SELECT page_id, len(html) > 2000 AS was_cut, least(len(html), 2000) AS kept, len(html) AS total_chars FROM pages")
def html_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = actions.truncated_html(_pages(spark, sf_dir), most=2000)
    kept = F.length(F.regexp_extract("html", r"(?s)^(.*?)(?:\n<!-- truncated: \d+ chars total, returned \d+ -->)?$", 1))
    return cut.select("page_id", F.contains("html", F.lit("\n<!-- truncated: ")).alias("was_cut"), kept.alias("kept"), "total_chars")


@_query("SELECT page_id, 0 AS scripts, 0 AS styles, len(regexp_extract_all(html, '<a href=\"')) AS n_actions, len(regexp_extract_all(html, '<h1>')) AS headings FROM pages")
def clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without removed tags and attributes; what is left is counted."""
    cleaned = actions.clean_pages(_pages(spark, sf_dir))
    count = lambda p: F.regexp_count("clean_html", F.lit(p))
    return cleaned.select("page_id", count("<script").alias("scripts"), (count("<style") + count("class=")).alias("styles"), "n_actions", count("<h1>").alias("headings"))


@_query(f"WITH {_LINKS} SELECT page_id, pos - 1 AS item_idx, label FROM (SELECT page_id, label, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos FROM links WHERE label <> '')")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of every list of the pages; each has one, its navigation."""
    return schema.list_items(schema.lists(_pages(spark, sf_dir))).select("page_id", F.col("item_idx").cast("long").alias("item_idx"), "label")


# Tables: one page per region with its nations, one per brand with its parts.


def _nation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("<tr><td>"), "n_nationkey", F.lit("</td><td>"), "n_name", F.lit("</td><td>n"), "n_nationkey", F.lit("@example.com</td><td>2024-01-"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit("</td></tr>"))
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda s: s["r"]), "").alias("rows"))
    head = "<html><body><table><thead><tr><th>key</th><th>name</th><th>mail</th><th>day</th></tr></thead><tbody>"
    return rows.select("page_id", F.concat(F.lit(head), F.col("rows"), F.lit("</tbody></table></body></html>")).alias("html"))


@_query("SELECT n_regionkey::BIGINT AS page_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS row_idx, n_nationkey::VARCHAR AS key, n_name AS name FROM nation")
def table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = schema.cells(schema.tables(_nation_pages(spark, sf_dir)))
    return cells.groupBy("page_id", "row_idx").agg(F.max(F.when(F.col("column") == "key", F.col("value"))).alias("key"), F.max(F.when(F.col("column") == "name", F.col("value"))).alias("name"))


@_query("SELECT DISTINCT n_regionkey::BIGINT AS page_id, unnest(['key', 'name', 'mail', 'day']) AS \"column\", unnest(['integer', 'string', 'email', 'date']) AS type FROM nation")
def table_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.tables(_nation_pages(spark, sf_dir)).select("page_id", F.explode(F.arrays_zip("columns", "types")).alias("c")).select("page_id", F.col("c.columns").alias("column"), F.col("c.types").alias("type"))


@_query("SELECT n_regionkey::BIGINT AS page_id, 'key,name,mail,day' || chr(10) || string_agg(n_nationkey || ',' || n_name || ',n' || n_nationkey || '@example.com,2024-01-' || lpad(n_nationkey::VARCHAR, 2, '0'), chr(10) ORDER BY n_nationkey) AS csv FROM nation GROUP BY n_regionkey")
def table_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.to_csv(schema.pick_table(schema.tables(_nation_pages(spark, sf_dir)))).select("page_id", "csv")


@_query("SELECT n_regionkey::BIGINT AS page_id, '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"mail\":\"n' || n_nationkey || '@example.com\",\"day\":\"2024-01-' || lpad(n_nationkey::VARCHAR, 2, '0') || '\"}' AS record FROM nation")
def table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.records_json(schema.tables(_nation_pages(spark, sf_dir))).select("page_id", F.explode("records").alias("record"))


@_query("SELECT n_regionkey::BIGINT AS page_id, count(*)::INT AS total_rows, least(count(*), 3)::INT AS rows_returned, count(*) > 3 AS rows_truncated FROM nation GROUP BY n_regionkey")
def table_max_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.tables(_nation_pages(spark, sf_dir), max_rows=3).select("page_id", "total_rows", "rows_returned", "rows_truncated")


@_query("""SELECT c_custkey AS page_id, 0 AS n_tables, 1 AS n_forms, 0 AS n_lists, CASE WHEN c_custkey % 3 = 0 THEN 'GET' ELSE 'POST' END AS method, 'Work email,Company,Work email,Work email,Work email,Sign up' AS labels, NULL::BIGINT AS list_total FROM customer
UNION ALL SELECT -1 - page_id, 0, 0, 1, NULL, NULL, len(regexp_extract_all(html, '<li>')) FROM pages WHERE contains(html, '<li>')""")
def page_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, forms and lists of the form pages and of the page table's pages with a list (as negative numbers), in one parse."""
    listed = _pages(spark, sf_dir).filter(F.contains("html", F.lit("<li>"))).select((-1 - F.col("page_id")).alias("page_id"), "html")
    found = schema.page_schema(_form_pages(spark, sf_dir).select("page_id", "html").unionByName(listed))
    first = F.get("forms", F.lit(0))
    return found.select("page_id", "n_tables", "n_forms", "n_lists", first["method"].alias("method"), F.array_join(F.transform(first["fields"], lambda f: f["label"]), ",").alias("labels"), F.get("lists", F.lit(0))["total"].cast("long").alias("list_total"))


def _price_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per brand: a table without head, prices with sign and thousands, sizes in per cent."""
    price = F.concat(F.lit("$"), F.format_number(F.col("p_retailprice").cast("decimal(15,2)"), 2))
    row = F.concat(F.lit("<tr><td>"), "p_partkey", F.lit("</td><td>"), price, F.lit("</td><td>"), "p_size", F.lit("%</td></tr>"))
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("page_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda s: s["r"]), "").alias("rows"))
    return rows.select("page_id", F.concat(F.lit("<table><tbody>"), F.col("rows"), F.lit("</tbody></table>")).alias("html"))


@_query("SELECT page_id, count(*) AS n, sum(price)::DOUBLE AS total, 'currency' AS type FROM (SELECT min(p_partkey) OVER (PARTITION BY p_brand) AS page_id, p_retailprice::DECIMAL(15,2) AS price FROM part) GROUP BY page_id")
def table_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = schema.cells(schema.tables(_price_pages(spark, sf_dir))).filter(F.col("column") == "col_2")
    return cells.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("number").cast("decimal(15,2)")).cast("double").alias("total"), F.max("type").alias("type"))


@_query("SELECT min(p_partkey) AS page_id, 0 AS table_idx, 20 + count(*) AS score FROM part GROUP BY p_brand")
def best_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.best_table(schema.tables(_price_pages(spark, sf_dir))).select("page_id", F.col("table_idx").cast("int").alias("table_idx"), F.col("score").cast("long").alias("score"))


# Forms: one page per customer.


def _form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    secure = F.col("c_custkey") % 2 == 0
    html = F.concat(
        F.lit('<html><body><form action="'),
        F.when(secure, "https").otherwise("http"),
        F.lit('://pay.example.com/c'),
        "c_custkey",
        F.lit('" method="'),
        F.when(F.col("c_custkey") % 3 == 0, "get").otherwise("post"),
        F.lit('"><label for="e">Work email</label><input type="email" id="e" name="email" required><label>Company <input name="company"></label><input type="password" name="pw"'),
        F.when(F.col("c_custkey") % 5 == 0, ' minlength="8"').otherwise(""),
        F.lit('><select name="segment">'),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.lit('<option value="'), i, F.lit('">s'), i, F.lit("</option>"))), ""),
        F.lit('</select><textarea name="about_you"></textarea><button type="submit">Sign up</button></form></body></html>'),
    )
    return c.select(F.col("c_custkey").alias("page_id"), F.concat(F.when(secure, "https").otherwise("http"), F.lit("://shop.example.com/c"), "c_custkey").alias("url"), html.alias("html"))


@_query("""SELECT c_custkey AS page_id, f.field_idx, f.type, f.label, f.name, f.required FROM customer CROSS JOIN (VALUES
  (0, 'email', 'Work email', 'email', true), (1, 'text', 'Company', 'company', false), (2, 'password', 'Work email', 'pw', false),
  (3, 'select', 'Work email', 'segment', false), (4, 'textarea', 'Work email', 'about_you', false), (5, 'submit', 'Sign up', NULL, false)) f(field_idx, type, label, name, required)""")
def form_fields_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.form_fields(_form_pages(spark, sf_dir)).select("page_id", "field_idx", "type", "label", "name", "required")


@_query("SELECT c_custkey AS page_id, CASE WHEN c_custkey % 3 = 0 THEN 'GET' ELSE 'POST' END AS method, CASE WHEN c_custkey % 2 = 0 THEN 'https' ELSE 'http' END || '://pay.example.com/c' || c_custkey AS action, 6 AS field_count FROM customer")
def forms_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.forms(schema.form_fields(_form_pages(spark, sf_dir))).select("page_id", "method", "action", F.col("field_count").cast("int").alias("field_count"))


@_query("""WITH r AS (SELECT c_custkey AS page_id, c_custkey % 3 = 0 AS got, c_custkey % 2 <> 0 AS plain, c_custkey % 5 <> 0 AS weak FROM customer)
SELECT page_id, 'FORM_PASSWORD_GET' AS rule_id, 'critical' AS severity FROM r WHERE got
UNION ALL SELECT page_id, 'FORM_INSECURE_ACTION', 'high' FROM r WHERE plain
UNION ALL SELECT page_id, 'FORM_WEAK_PASSWORD', 'medium' FROM r WHERE weak""")
def security_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _form_pages(spark, sf_dir)
    return security.form_findings(schema.form_fields(pages), pages).select("page_id", "rule_id", "severity")


_HEADERS = """h AS (SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 4 = 0 THEN 'http' ELSE 'https' END AS scheme,
  CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'max-age=600' ELSE 'max-age=63072000; includeSubDomains' END AS hsts,
  CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'default-src ''self'' ''unsafe-inline''' ELSE 'default-src ''self''; frame-ancestors ''none''' END AS csp,
  CASE s_suppkey % 7 WHEN 0 THEN 'ALLOWALL' WHEN 1 THEN 'DENY' ELSE '' END AS xfo,
  CASE s_suppkey % 2 WHEN 0 THEN 'nosniff' ELSE '' END AS xcto, CASE WHEN s_suppkey % 6 = 0 THEN '*' ELSE '' END AS acao,
  CASE s_suppkey % 8 WHEN 1 THEN 200 WHEN 2 THEN 301 WHEN 3 THEN 302 END AS status,
  CASE s_suppkey % 8 WHEN 2 THEN 'https://x.example.com/' WHEN 3 THEN 'http://x.example.com/' END AS location FROM supplier)"""


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")

    def pick(n: int, values: dict[int, str], other: str | None) -> Column:
        out = F.lit(other)
        for key, value in values.items():
            out = F.when(k % n == key, value).otherwise(out)
        return out

    headers = F.create_map(
        *[x for name, value in (
            ("Strict-Transport-Security", pick(3, {0: "", 1: "max-age=600"}, "max-age=63072000; includeSubDomains")),
            ("Content-Security-Policy", pick(5, {0: "", 1: "default-src 'self' 'unsafe-inline'"}, "default-src 'self'; frame-ancestors 'none'")),
            ("X-Frame-Options", pick(7, {0: "ALLOWALL", 1: "DENY"}, "")),
            ("X-Content-Type-Options", pick(2, {0: "nosniff"}, "")),
            ("Access-Control-Allow-Origin", pick(6, {0: "*"}, "")),
        ) for x in (F.lit(name), value)]
    )
    status = F.when(k % 8 == 1, 200).when(k % 8 == 2, 301).when(k % 8 == 3, 302)
    return table(spark, sf_dir, "supplier").select(k.alias("page_id"), F.concat(pick(4, {0: "http"}, "https"), F.lit("://x.example.com/s"), k).alias("url"), headers.alias("headers"), status.alias("probe_status"), pick(8, {2: "https://x.example.com/", 3: "http://x.example.com/"}, None).alias("probe_location"))


_HEADER_RULES = f"""WITH {_HEADERS}, f AS (
SELECT page_id, 'HEADER_MISSING_HSTS' AS rule_id, 'high' AS severity FROM h WHERE scheme = 'https' AND hsts = ''
UNION ALL SELECT page_id, 'HEADER_SHORT_HSTS', 'low' FROM h WHERE scheme = 'https' AND hsts = 'max-age=600'
UNION ALL SELECT page_id, 'HEADER_MISSING_CSP', 'medium' FROM h WHERE csp = ''
UNION ALL SELECT page_id, 'HEADER_CSP_UNSAFE', 'low' FROM h WHERE contains(csp, 'unsafe-inline')
UNION ALL SELECT page_id, 'HEADER_MISSING_CLICKJACKING_PROTECTION', 'medium' FROM h WHERE csp <> '' AND NOT contains(csp, 'frame-ancestors') AND xfo = ''
UNION ALL SELECT page_id, 'HEADER_WEAK_XFO', 'low' FROM h WHERE xfo = 'ALLOWALL'
UNION ALL SELECT page_id, 'HEADER_MISSING_NOSNIFF', 'low' FROM h WHERE xcto = ''
UNION ALL SELECT page_id, 'HEADER_CORS_WILDCARD', 'info' FROM h WHERE acao = '*'
UNION ALL SELECT page_id, 'HEADER_HTTP_WEAK_REDIRECT', 'high' FROM h WHERE scheme = 'https' AND status = 302
UNION ALL SELECT page_id, 'HEADER_HTTP_AVAILABLE', 'high' FROM h WHERE scheme = 'https' AND status = 200
UNION ALL SELECT page_id, 'PAGE_HTTP', 'high' FROM h WHERE scheme = 'http')"""


@_query(f"{_HEADER_RULES} SELECT * FROM f")
def security_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.header_findings(_responses(spark, sf_dir)).select("page_id", "rule_id", "severity")


@_query(f"""{_HEADER_RULES}, c AS (SELECT page_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high,
  count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'info') AS info FROM f GROUP BY page_id)
SELECT *, critical * 100 + high * 25 + medium * 5 AS risk_score FROM c""")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.severity_counts(security.roll_up(security.header_findings(_responses(spark, sf_dir))))


@_query(f"""{_HEADER_RULES} SELECT page_id, sum(CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 25 WHEN 'medium' THEN 5 ELSE 0 END)::BIGINT AS risk_score
FROM f GROUP BY page_id ORDER BY risk_score DESC, page_id LIMIT 5""")
def risk_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _responses(spark, sf_dir).select("page_id", "url", F.lit(None).cast("string").alias("error"))
    counts = security.severity_counts(security.roll_up(security.header_findings(_responses(spark, sf_dir))))
    return security.report(counts, pages)[1].select("page_id", "risk_score")


@_query()
def security_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _responses(spark, sf_dir).select("page_id", "url", F.lit(None).cast("string").alias("error"))
    found = security.roll_up(security.header_findings(_responses(spark, sf_dir)))
    return security.markdown(*security.report(security.severity_counts(found), pages), found, pages)


@_query(f"""{_HEADER_RULES}, o AS (SELECT *, CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 25 WHEN 'medium' THEN 5 ELSE 0 END AS points, list_position(['critical', 'high', 'medium', 'low', 'info'], severity) AS place FROM f)
SELECT s_suppkey AS page_id, coalesce(sum(points), 0)::VARCHAR AS risk, count(o.rule_id) AS n_findings, coalesce(arg_min(severity, place), '') AS worst, 0::VARCHAR AS critical FROM supplier LEFT JOIN o ON s_suppkey = o.page_id GROUP BY s_suppkey""")
def security_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's report as JSON, read back."""
    pages = _responses(spark, sf_dir).select("page_id", "url", F.lit(None).cast("string").alias("error"))
    found = security.roll_up(security.header_findings(_responses(spark, sf_dir)))
    told = security.report_json(security.page_reports(pages, found, headers=_responses(spark, sf_dir)))
    at = lambda path: F.get_json_object("json", path)
    return told.select("page_id", at("$.risk_score").alias("risk"), F.json_array_length(at("$.findings")).cast("long").alias("n_findings"), F.coalesce(at("$.findings[0].severity"), F.lit("")).alias("worst"), at("$.finding_counts.critical").alias("critical"))


@_query()
def security_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's section of every page."""
    pages = _responses(spark, sf_dir).select("page_id", "url", F.lit(None).cast("string").alias("error"))
    found = security.roll_up(security.header_findings(_responses(spark, sf_dir)))
    return security.report_markdown(security.page_reports(pages, found, headers=_responses(spark, sf_dir)))


@_query("""WITH c AS (SELECT user_id AS page_id, event_id AS pos, event_id % 4 = 0 AS secure, event_id % 3 = 0 AS http_only,
  CASE event_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN '' ELSE 'lax' END AS same, CASE event_id % 6 WHEN 0 THEN 'session_' WHEN 1 THEN '__Host-' WHEN 2 THEN '__Secure-' ELSE 'pref_' END AS prefix,
  CASE WHEN event_id % 7 = 0 THEN '.other.example.org' ELSE '' END AS domain FROM events),
d AS (SELECT *, prefix <> 'pref_' AS session FROM c)
SELECT page_id, pos, 'COOKIE_MISSING_SECURE' AS rule_id, CASE WHEN session THEN 'high' ELSE 'medium' END AS severity FROM d WHERE NOT secure
UNION ALL SELECT page_id, pos, 'COOKIE_MISSING_HTTPONLY', 'high' FROM d WHERE session AND NOT http_only
UNION ALL SELECT page_id, pos, 'COOKIE_SAMESITE_NONE_INSECURE', 'high' FROM d WHERE same = 'none' AND NOT secure
UNION ALL SELECT page_id, pos, 'COOKIE_MISSING_SAMESITE', 'low' FROM d WHERE same = ''
UNION ALL SELECT page_id, pos, 'COOKIE_HOST_PREFIX_VIOLATION', 'medium' FROM d WHERE prefix = '__Host-' AND domain <> ''
UNION ALL SELECT page_id, pos, 'COOKIE_HOST_PREFIX_INSECURE', 'high' FROM d WHERE prefix = '__Host-' AND NOT secure
UNION ALL SELECT page_id, pos, 'COOKIE_SECURE_PREFIX_INSECURE', 'high' FROM d WHERE prefix = '__Secure-' AND NOT secure
UNION ALL SELECT page_id, pos, 'COOKIE_THIRD_PARTY', 'info' FROM d WHERE domain <> ''""")
def security_cookies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    prefix = F.when(k % 6 == 0, "session_").when(k % 6 == 1, "__Host-").when(k % 6 == 2, "__Secure-").otherwise("pref_")
    cookies = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("page_id"),
        F.lit("https://www.example.com/").alias("url"),
        k.alias("pos"),
        F.concat(prefix, k).alias("name"),
        F.when(k % 7 == 0, ".other.example.org").otherwise("").alias("domain"),
        F.lit("/").alias("path"),
        (k % 4 == 0).alias("secure"),
        (k % 3 == 0).alias("http_only"),
        F.when(k % 5 == 0, "None").when(k % 5 == 1, "").otherwise("Lax").alias("same_site"),
        F.lit(-1.0).alias("expires"),
    )
    return security.cookie_findings(cookies).select("page_id", F.floor(F.col("pos") / 16).alias("pos"), "rule_id", "severity")


def _resource_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    scheme = F.when(k % 2 == 0, "http").otherwise("https")
    integrity = F.when(k % 3 == 0, ' integrity="sha384-x"').otherwise("")
    html = F.concat(F.lit('<html><head><script src="'), scheme, F.lit('://cdn.example.com/a.js"'), integrity, F.lit('></script><link rel="stylesheet" href="'), scheme, F.lit('://cdn.example.com/a.css"'), integrity, F.lit('></head><body><img src="'), scheme, F.lit('://cdn.example.com/i.png"><iframe src="https://x.example.com/"></iframe></body></html>'))
    return table(spark, sf_dir, "part").select(k.alias("page_id"), F.concat(F.lit("https://www.example.com/p"), k).alias("url"), html.alias("html"))


@_query("""SELECT p_partkey AS page_id, r.rule_id, r.severity FROM part CROSS JOIN (VALUES ('MIXED_ACTIVE_SCRIPT', 'high'), ('MIXED_ACTIVE_STYLESHEET', 'high'), ('MIXED_PASSIVE_IMAGE', 'medium')) r(rule_id, severity) WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'SRI_MISSING', 'high' FROM part CROSS JOIN (VALUES (1), (2)) v(n) WHERE p_partkey % 3 <> 0""")
def security_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = security.resources(_resource_pages(spark, sf_dir))
    return security.sri_findings(res).unionByName(security.mixed_findings(res)).select("page_id", "rule_id", "severity")


_SITE = "regexp_extract(url, '^([a-z]+)://', 1)"


@_query(f"""WITH {_LINKS}, a AS (SELECT page_id, url, {_SITE} || '://' || regexp_extract(url, '://([^/?#]*)', 1) || href AS absolute, label, pos FROM links WHERE href LIKE '/%'),
p AS (SELECT page_id, url FROM pages)
SELECT page_id, 'PAGE_HTTP' AS rule_id, 'high' AS severity FROM p WHERE url LIKE 'http://%'
UNION ALL SELECT page_id, 'LINK_HTTP_RESOURCE', 'high' FROM (SELECT DISTINCT page_id FROM a WHERE absolute LIKE 'http://%')
UNION ALL SELECT page_id, 'LINK_SENSITIVE_PATH', 'medium' FROM a WHERE regexp_matches(absolute, '^[a-z]+://[^/]*[^?#]*/(?:admin|api|debug|backup|config|wp-admin|phpmyadmin|\\.env|actuator)(?:/|$|[?#])', 'i')""")
def security_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return security.link_findings(actions.actions(pages), pages).select("page_id", "rule_id", "severity")


@_query(f"""WITH {_LINKS}, a AS (SELECT page_id, pos, {_SITE} || '://' || regexp_extract(url, '://([^/?#]*)', 1) || CASE WHEN regexp_extract(href, '^([^?#]*)', 1) = '/' THEN '/' ELSE regexp_replace(regexp_extract(href, '^([^?#]*)', 1), '/+$', '') END AS link FROM links WHERE href LIKE '/%')
SELECT page_id, link, min(pos)::INT AS first_pos FROM a GROUP BY page_id, link""")
def same_domain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return security.same_domain_links(actions.actions(pages), pages).select("page_id", "link", F.col("first_pos").cast("int").alias("first_pos"))


@_query("SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return _pages(spark, sf_dir).select("page_id", urls.scheme(u).alias("scheme"), urls.authority(u).alias("host"), urls.path(u).alias("path"))


@_query("""WITH RECURSIVE seeds AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 100 = 0),
edges AS (SELECT DISTINCT o_custkey AS a, (o_custkey * 7 + o_orderkey) % 200 AS b FROM orders),
l1 AS (SELECT DISTINCT b AS k FROM edges JOIN seeds ON a = k EXCEPT SELECT k FROM seeds),
l2 AS (SELECT DISTINCT b AS k FROM edges JOIN l1 ON a = k EXCEPT (SELECT k FROM seeds UNION SELECT k FROM l1))
SELECT 'https://x.example.com/' || k AS url, 0 AS depth FROM seeds UNION ALL SELECT 'https://x.example.com/' || k, 1 FROM l1 UNION ALL SELECT 'https://x.example.com/' || k, 2 FROM l2""")
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages reached in two steps over links made of the orders."""
    o = table(spark, sf_dir, "orders")
    name = lambda c: F.concat(F.lit("https://x.example.com/"), c)
    links = o.select(name(F.col("o_custkey")).alias("url"), name((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 200).alias("link"))
    return security.crawl_frontier(links, o.filter("o_orderkey % 100 = 0").select(name(F.col("o_custkey")).alias("url")), depth=2)


# Blocks: pages of cards made of the parts, articles made of the documents.


def _card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per brand: a heading and a priced paragraph per part."""
    price = F.col("p_retailprice").cast("decimal(15,2)").cast("string")
    card = F.concat(F.lit("<p>"), "p_name", F.lit(" number "), "p_partkey", F.lit(" costs $"), price, F.lit(" today only</p>"))
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("page_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("r")))), lambda s: s["r"]), "").alias("rows"))
    return rows.select("page_id", F.concat(F.lit("<html><body><h1>"), F.col("p_brand"), F.lit("</h1>"), F.col("rows"), F.lit("</body></html>")).alias("html"))


_CARDS = "c AS (SELECT min(p_partkey) OVER (PARTITION BY p_brand) AS page_id, p_brand, p_partkey, p_name || ' number ' || p_partkey || ' costs $' || p_retailprice::DECIMAL(15,2) || ' today only' AS text FROM part)"


@_query(f"""WITH {_CARDS} SELECT page_id, 0 AS block_no, 'heading' AS type, p_brand AS text, greatest(1, len(p_brand) // 4)::INT AS tokens, p_brand AS heading_path FROM (SELECT DISTINCT page_id, p_brand FROM c)
UNION ALL SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey)::INT, 'paragraph', text, greatest(1, len(text) // 4)::INT, p_brand FROM c""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.blocks(_card_pages(spark, sf_dir)).select("page_id", "block_no", "type", "text", "tokens", "heading_path")


@_query(f"""WITH {_CARDS}, b AS (SELECT page_id, count(*) AS n, sum(len(text)) AS chars, max(p_brand) AS brand FROM c GROUP BY page_id)
SELECT page_id, n AS source_price_signals, n AS indexed_price_signals, 100.0::DOUBLE AS coverage_pct, 0.0::DOUBLE AS duplicate_overhead_pct, n AS card_blocks, 'semantic' AS mode FROM b""")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _card_pages(spark, sf_dir)
    q = blocks.quality(pages, blocks.blocks(pages))
    return q.select("page_id", F.col("source_price_signals").cast("long").alias("source_price_signals"), F.col("indexed_price_signals").cast("long").alias("indexed_price_signals"), F.col("coverage_pct").cast("double").alias("coverage_pct"), F.col("duplicate_overhead_pct").cast("double").alias("duplicate_overhead_pct"), "card_blocks", "mode")


@_query(f"""WITH {_CARDS}, n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY page_id) AS priced, greatest(1, len(text) // 4) AS tokens FROM c),
s AS (SELECT page_id, k, CASE WHEN tokens BETWEEN 4 AND 160 THEN 120 + CASE WHEN tokens BETWEEN 8 AND 100 THEN 30 ELSE 0 END + CASE WHEN priced >= 5 THEN 80 ELSE 5 END END AS score FROM n
UNION ALL SELECT page_id, 0, 40 + CASE WHEN max(priced) >= 5 THEN 20 ELSE 0 END FROM n GROUP BY page_id)
SELECT page_id, k::INT AS block_no, score::INT AS score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, k)::INT AS rank FROM s""")
def rank_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.ranked(blocks.blocks(_card_pages(spark, sf_dir))).select("page_id", "block_no", "score", "rank")


@_query(f"""WITH {_CARDS}, n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY page_id) AS cards, greatest(1, len(text) // 4) AS tokens FROM c),
l AS (SELECT page_id, k AS rank, cards, tokens, 'p' || k || ' | ' || p_brand || ' | card | ' || tokens || 't | ' || substr(text, 1, 80) AS line FROM n
  UNION ALL SELECT page_id, max(k) + 1, max(cards), max(greatest(1, len(p_brand) // 4)), 'p0 | h1 | ' || max(p_brand) || ' | ' || max(greatest(1, len(p_brand) // 4)) || 't' FROM n GROUP BY page_id),
t AS (SELECT *, count(*) OVER w AS total, sum(tokens) OVER w AS source, sum(len(line) + 1) OVER (PARTITION BY page_id ORDER BY rank) AS chars FROM l WINDOW w AS (PARTITION BY page_id)),
y AS (SELECT *, 'range=0:' || rank || '/' || total || ' source=' || source || 't' || CASE WHEN rank < total THEN ' next=' || rank ELSE '' END || ' cards=' || cards AS summary FROM t),
z AS (SELECT *, min(CASE WHEN (chars + len(summary)) // 4 > 120 THEN rank END) OVER (PARTITION BY page_id) AS stop FROM y)
SELECT page_id, string_agg(line, chr(10) ORDER BY rank) || chr(10) || arg_max(summary, rank) AS outline, count(*)::INT AS n_lines FROM z WHERE stop IS NULL OR rank < stop GROUP BY page_id""")
def outline_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.outline(blocks.blocks(_card_pages(spark, sf_dir)), max_tokens=120)


def _first_ten(spark: SparkSession, sf_dir: str, max_tokens: int) -> DataFrame:
    blks = blocks.blocks(_card_pages(spark, sf_dir))
    beyond = F.concat(F.lit("p"), F.max("block_no") + 1)
    wanted = blks.groupBy("page_id").agg(F.array(*[F.lit(f"p{k}") for k in (*range(1, 11), 1)], beyond).alias("ids"))
    return blocks.fetch(blks, wanted, max_tokens=max_tokens).select("page_id", "id", "text")


@_query(f"""WITH {_CARDS}, n AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) AS k, text FROM c) SELECT page_id, 'p' || k AS id, text FROM n WHERE k <= 10""")
def fetch_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten cards of every page, asked for with a repeat and with one that is not there."""
    return _first_ten(spark, sf_dir, 10_000)


@_query()
def fetch_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within sixty tokens; what goes beyond is cut."""
    return _first_ten(spark, sf_dir, 60)


@_query()
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the page table as it is."""
    return blocks.blocks(_pages(spark, sf_dir))


@_query()
def page_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    blks = blocks.blocks(pages)
    return blocks.outline(blks, max_tokens=600, quality_rows=blocks.quality(pages, blks))


# Classes and readiness.


@_query("""WITH r AS (SELECT page_id, url, lower(html) AS h, len(html) AS n, len(regexp_extract_all(html, '<a href="')) AS a FROM pages)
SELECT page_id, CASE WHEN n < 15000 AND (contains(h, 'captcha') OR contains(h, 'cloudflare') OR contains(h, 'bot detection') OR contains(h, 'robot check') OR contains(h, 'just a moment')) THEN 'Anti-bot'
  WHEN contains(lower(url), 'login') OR contains(lower(url), 'signin') OR contains(lower(url), 'authorize') THEN 'Auth-gated' WHEN a = 0 AND n > 1000 THEN 'SPA'
  WHEN page_id % 5 = 1 THEN 'Shadow DOM' WHEN page_id % 5 = 2 THEN 'Iframe-heavy' ELSE 'Static' END AS page_class FROM r""")
def page_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    counts = actions.actions(pages).groupBy("page_id").agg(F.count("*").alias("n_actions"))
    rows = pages.join(counts, "page_id", "left").withColumn("shadow_hosts", (F.col("page_id") % 5 == 1).cast("int")).withColumn("cross_origin_iframes", (F.col("page_id") % 5 == 2).cast("int"))
    for name, kind in (("a11y_nodes", "int"), ("shell", "boolean"), ("has_body", "boolean"), ("text_chars", "int")):
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    return classify.page_class(rows).select("page_id", "page_class")


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as probes of pages: each user's page, some 0.3 s apart."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").withColumn("k", k)
    return e.select(F.col("user_id").alias("url"), (F.col("k") * 300).alias("at"), F.lit(True).alias("has_body"), ((F.col("event_id") % 13) * 90).alias("text_chars"), ((F.col("event_id") % 3) * 15000).alias("html_chars"), (F.col("event_id") % 7).alias("card_candidates"), (F.col("event_id") % 4).alias("price_hits"), F.lit(False).alias("consent_only"))


@_query("""WITH p AS (SELECT user_id AS url, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 300 AS ms, (event_id % 13) * 90 AS t, event_id % 7 AS c, event_id % 4 AS m FROM events),
q AS (SELECT *, lag(t) OVER (PARTITION BY url ORDER BY ms) AS last FROM p),
r AS (SELECT *, t >= 2000 OR (t >= 400 AND (c >= 4 OR m >= 3)) OR (t >= 800 AND coalesce(last, 0) > 0 AND abs(t - last) <= greatest(80, floor(t * 0.05))) AS ready FROM q),
w AS (SELECT url, ms - min(ms) OVER (PARTITION BY url) AS since, coalesce(ready, false) AS ready FROM r)
SELECT url, bool_or(ready) AS ready, coalesce(min(since) FILTER (WHERE ready), max(since))::BIGINT AS wait_ms FROM w WHERE since <= 10000 GROUP BY url""")
def readiness_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.replay_readiness(_probes(spark, sf_dir)).select("url", "ready", F.col("wait_ms").cast("long").alias("wait_ms"))


@_query("SELECT event_id, (event_id % 13) * 90 <= 40 OR ((event_id % 3) * 15000 >= 20000 AND ((event_id % 13) * 90 <= 250 OR ((event_id % 13) * 90 < 500 AND event_id % 7 = 0 AND event_id % 4 = 0))) AS shell FROM events")
def sparse_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.lit(True).alias("has_body"), ((F.col("event_id") % 13) * 90).alias("text_chars"), ((F.col("event_id") % 3) * 15000).alias("html_chars"), (F.col("event_id") % 7).alias("card_candidates"), (F.col("event_id") % 4).alias("price_hits"), F.lit(False).alias("consent_only"))
    return e.select("event_id", classify.sparse_shell().alias("shell"))


@_query()
def page_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.probes_of(_pages(spark, sf_dir))


@_query()
def ax_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes made of the parts' names against labels made of half of them."""
    p = table(spark, sf_dir, "part").withColumn("page_id", F.floor(F.col("p_partkey") / 20))
    raw = p.select("page_id", F.col("p_partkey").alias("pos"), F.lit(False).alias("ignored"), F.when(F.col("p_partkey") % 3 == 0, "link").otherwise("button").alias("role"), F.col("p_name").alias("name"), F.lit("").alias("value"), F.col("p_partkey").alias("backend_id"))
    labels = p.filter("p_partkey % 2 = 0").select("page_id", F.upper("p_name").alias("label"))
    return classify.ax_supplement(classify.ax_nodes(raw), labels).select("page_id", "bind_id", "tag", "name")


# Diffs.


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of a page per customer, with an action per order: finished orders are gone in the second, urgent ones say so."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("id"), F.lit("a").alias("type"), F.concat(F.lit("Order "), "o_orderkey").alias("label"), F.concat(F.lit("/o/"), "o_orderkey").alias("href"), F.lit("Page").alias("group"), "o_orderstatus", "o_orderkey")
    before = o.filter("o_orderkey % 4 <> 3 and url % 7 <> 0").drop("o_orderstatus", "o_orderkey")
    after = o.filter("o_orderstatus <> 'F'").withColumn("label", F.when(F.col("o_orderkey") % 5 == 0, F.upper("label")).otherwise(F.col("label"))).drop("o_orderstatus", "o_orderkey")
    return before, after


@_query("""WITH b AS (SELECT o_custkey AS url, o_orderkey AS k FROM orders WHERE o_orderkey % 4 <> 3 AND o_custkey % 7 <> 0), a AS (SELECT o_custkey AS url, o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F'),
u AS (SELECT url FROM b INTERSECT SELECT url FROM a)
SELECT coalesce(a.url, b.url) AS url, coalesce(a.k, b.k)::VARCHAR AS id, CASE WHEN b.k IS NULL THEN 'appeared' WHEN a.k IS NULL THEN 'disappeared' ELSE 'changed' END AS change
FROM a FULL OUTER JOIN b ON a.url = b.url AND a.k = b.k WHERE coalesce(a.url, b.url) IN (SELECT url FROM u) AND (b.k IS NULL OR a.k IS NULL OR a.k % 5 = 0)""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff(*_versions(spark, sf_dir)).select("url", "id", "change")


_CHANGES = """WITH b AS (SELECT o_custkey AS url, o_orderkey AS k FROM orders WHERE o_orderkey % 4 <> 3 AND o_custkey % 7 <> 0), a AS (SELECT o_custkey AS url, o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F'),
u AS (SELECT url FROM b INTERSECT SELECT url FROM a),
d AS (SELECT coalesce(a.url, b.url) AS url, coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'appeared' WHEN a.k IS NULL THEN 'disappeared' ELSE 'changed' END AS change
  FROM a FULL OUTER JOIN b ON a.url = b.url AND a.k = b.k WHERE coalesce(a.url, b.url) IN (SELECT url FROM u) AND (b.k IS NULL OR a.k IS NULL OR a.k % 5 = 0)),
e AS (SELECT *, CASE WHEN change <> 'disappeared' AND k % 5 = 0 THEN 'ORDER ' ELSE 'Order ' END || k AS label FROM d)"""


@_query(f"""{_CHANGES}, s AS (SELECT url, change, '## ' || change || chr(10) || string_agg('@' || k || ' Page > a[' || label || '] (#' || k || ') — ' || label, chr(10) ORDER BY k || '|') AS part FROM e GROUP BY url, change)
SELECT u.url, '# diff ' || u.url || chr(10) || 'groups: Page' || chr(10) || coalesce(string_agg(part, chr(10) ORDER BY change), '(no changes)') AS terse FROM u LEFT JOIN s ON u.url = s.url GROUP BY u.url""")
def diff_terse(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _versions(spark, sf_dir)
    both = diff.page_groups(after).join(before.select("url").distinct(), "url", "left_semi")
    return diff.diff_terse(diff.diff(before, after), both)


@_query(f"""{_CHANGES}, s AS (SELECT url, change, '<' || change || ' count="' || count(*) || '">' || string_agg('<action id="' || k || '" type="a" label="' || label || '" group="Page" breadcrumb="Page &gt; a[' || label || '] (#' || k || ')"'
    || CASE WHEN change = 'changed' THEN ' previous_label="Order ' || k || '"' ELSE '' END || '/>', '' ORDER BY k || '|') || '</' || change || '>' AS part FROM e GROUP BY url, change)
SELECT u.url, '<page url="' || u.url || '" title="" diff="true"><skeleton><groups><group name="Page"/></groups></skeleton><delta>' || coalesce(string_agg(part, '' ORDER BY change), '<note>nothing changed</note>') || '</delta></page>' AS xml
FROM u LEFT JOIN s ON u.url = s.url GROUP BY u.url""")
def diff_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _versions(spark, sf_dir)
    both = diff.page_groups(after).join(before.select("url").distinct(), "url", "left_semi")
    return diff.diff_xml(diff.diff(before, after), both)


@_query("SELECT o_custkey AS url, o_orderkey::VARCHAR AS id FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 <> 3 AND o_custkey % 7 <> 0)")
def full_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.full_snapshots(*_versions(spark, sf_dir)).select("url", "id")


# Form plans, healing, state.


@_query("""SELECT c_custkey AS page_id, s.place, s.action, s.reason FROM customer CROSS JOIN (VALUES (0::BIGINT, 'auto_fill', 'safe_field'), (1, 'auto_fill', 'safe_field'), (2, 'handoff', 'password_requires_handoff'),
  (3, 'ask', 'ambiguous_field'), (4, 'ask', 'ambiguous_field')) s(place, action, reason)""")
def form_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _form_pages(spark, sf_dir)
    classes = pages.select("page_id", F.lit("Static").alias("page_class"))
    profile = F.create_map(F.lit("email"), F.lit("ada@example.com"), F.lit("company"), F.lit("Acme"))
    profiles = pages.select("page_id", profile.alias("profile"))
    return forms.plan(schema.form_fields(pages), actions.actions(pages), classes, profiles).select("page_id", "place", "action", "reason")


@_query()
def form_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _form_pages(spark, sf_dir)
    return forms.link_fields(schema.form_fields(pages), actions.actions(pages)).select("page_id", "field_idx", "kind", "sid", "match_score")


@_query()
def heal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name looked for among the twenty of its page."""
    p = table(spark, sf_dir, "part").withColumn("page", F.floor(F.col("p_partkey") / 20))
    wanted = p.select(F.col("p_partkey").alias("request_id"), F.col("page").alias("page_id"), F.col("p_name").alias("label"))
    found = p.select(F.col("page").alias("page_id"), F.col("p_partkey").alias("pos"), F.concat(F.lit("#p"), "p_partkey").alias("selector"), F.col("p_name").alias("candidate_label"), F.lit(False).alias("has_testid"), (F.col("p_partkey") % 2 == 0).alias("has_id"), F.lit(False).alias("has_name"), F.lit(False).alias("has_aria"))
    return heal.rank(wanted, found).select("request_id", "rank", "selector", "score")


@_query("SELECT 'u' || user_id AS cache_key, arg_max(event_type, event_id) AS selector FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'click'")
def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("cache_key"), F.col("event_id").alias("at"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("selector"))
    return heal.latest_cache(log)


@_query()
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("request_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("ts"))
    return state.replay_limit(requests, limit=3, window_s=86_400)


@_query(f"WITH {_LINKS} SELECT count(*) AS n FROM links WHERE lower(href) LIKE 'http%'")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.search_results(_actions(spark, sf_dir)).agg(F.count("*").alias("n"))


@_query("""SELECT user_id AS page_id, least(count(*), 25)::INT AS shown, greatest(count(*) - 25, 0) AS truncated FROM events GROUP BY user_id""")
def cookie_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cookies = e.select(F.col("user_id").alias("page_id"), F.col("event_id").alias("pos"), F.concat(F.lit("c"), "event_id").alias("name"), F.lit("").alias("domain"), F.lit("/").alias("path"), F.lit(True).alias("secure"), F.lit(True).alias("http_only"), F.lit("Lax").alias("same_site"), F.lit(-1.0).alias("expires"))
    return security.cookie_summary(cookies).select("page_id", F.size("cookies").alias("shown"), "truncated")


@_query(f"""WITH {_HEADERS} SELECT page_id, nullif(csp, '') AS csp, hsts FROM h""")
def header_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _responses(spark, sf_dir).select("page_id", security.header_summary(security.lower_headers(F.col("headers"))).alias("s"))
    return rows.select("page_id", F.col("s.content-security-policy").alias("csp"), F.col("s.strict-transport-security").alias("hsts"))


@_query("""WITH p AS (SELECT s_suppkey AS page_id, s_suppkey % 3 AS k FROM supplier)
SELECT page_id, 'CORS_ORIGIN_ECHO' AS rule_id, 'high' AS severity FROM p WHERE k = 0 UNION ALL SELECT page_id, 'CORS_WILDCARD_WITH_CREDENTIALS', 'critical' FROM p WHERE k = 1""")
def security_cors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    probes = table(spark, sf_dir, "supplier").select(k.alias("page_id"), F.lit("https://x.example.com/").alias("url"), F.lit(None).cast("string").alias("origin_sent"), F.when(k % 3 == 0, "https://x.example.com").when(k % 3 == 1, "*").otherwise("").alias("acao"), F.lit("true").alias("acac"), F.lit("").alias("allow_methods"))
    return security.cors_findings(probes).select("page_id", "rule_id", "severity")


@_query("""SELECT c_custkey AS page_id, CASE c_custkey % 4 WHEN 0 THEN 'PAGE_ANTIBOT' WHEN 1 THEN 'PAGE_AUTH_GATED' WHEN 2 THEN 'PAGE_SPA_EMPTY' ELSE 'PAGE_CROSS_ORIGIN_IFRAME' END AS rule_id FROM customer""")
def security_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "Anti-bot").when(k % 4 == 1, "Auth-gated").when(k % 4 == 2, "SPA").otherwise("Iframe-heavy")
    rows = table(spark, sf_dir, "customer").select(k.alias("page_id"), F.lit("https://x.example.com/").alias("url"), kind.alias("page_class"), F.lit("why").alias("reason"), F.lit(0).alias("n_actions"), F.lit(0).alias("shadow_hosts"), F.lit(0).alias("cross_origin_iframes"))
    return security.meta_findings(rows).select("page_id", "rule_id")


@_query("""SELECT user_id AS page_id, count(*) AS n_tools, '# webmcp tools (' || count(*) || ')' AS first_line FROM events GROUP BY user_id""")
def webmcp_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools that pages offer, rendered as JSON from the events and read back."""
    e = table(spark, sf_dir, "events")
    listed = F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("name"), F.lit("does it").alias("description"))))
    pages = e.groupBy(F.col("user_id").alias("page_id")).agg(F.to_json(F.transform(listed, lambda t: F.struct(t["name"].alias("name"), t["description"].alias("description")))).alias("tools"))
    tools = classify.webmcp_tools(pages)
    counts = classify.webmcp_actions(tools).groupBy("page_id").agg(F.count("*").alias("n_tools"))
    return counts.join(classify.webmcp_terse(tools), "page_id").select("page_id", "n_tools", F.substring_index("terse", "\n", 1).alias("first_line"))


@_query("""WITH l AS (SELECT DISTINCT CASE WHEN p_partkey % 5 = 0 THEN 'own' ELSE 's' || p_partkey % 5 END AS site, lower(p_type || ' ' || p_size) AS label FROM part),
o AS (SELECT DISTINCT label FROM l WHERE site = 'own'), t AS (SELECT label, count(DISTINCT site) AS sites FROM l WHERE site <> 'own' GROUP BY label),
m AS (SELECT 'missing' AS kind, label, sites FROM t WHERE NOT EXISTS (SELECT 1 FROM o WHERE contains(t.label, o.label) OR contains(o.label, t.label)) ORDER BY label LIMIT 15),
u AS (SELECT 'unique' AS kind, label, 1::BIGINT AS sites FROM o WHERE NOT EXISTS (SELECT 1 FROM t WHERE contains(t.label, o.label) OR contains(o.label, t.label)) ORDER BY label LIMIT 15)
SELECT * FROM m UNION ALL SELECT * FROM u""")
def feature_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    site = F.when(F.col("p_partkey") % 5 == 0, "own").otherwise(F.concat(F.lit("s"), F.col("p_partkey") % 5))
    return compare.gaps(p.select(site.alias("site"), F.concat_ws(" ", "p_type", "p_size").alias("label")), "own")


@_query("""WITH v AS (SELECT user_id AS url, event_id, event_type, dense_rank() OVER (PARTITION BY user_id ORDER BY event_id % 3) AS n FROM events),
f AS (SELECT DISTINCT url, n, event_type FROM v),
a AS (SELECT url, n AS version_no, event_type FROM f), b AS (SELECT url, n + 1 AS version_no, event_type FROM f),
met AS (SELECT url, version_no FROM a INTERSECT SELECT url, version_no FROM b)
SELECT met.url, met.version_no, 'appeared' AS change, a.event_type AS label FROM a JOIN met ON a.url = met.url AND a.version_no = met.version_no LEFT JOIN b ON a.url = b.url AND a.version_no = b.version_no AND a.event_type = b.event_type WHERE b.url IS NULL
UNION ALL SELECT met.url, met.version_no, 'disappeared', b.event_type FROM b JOIN met ON b.url = met.url AND b.version_no = met.version_no LEFT JOIN a ON a.url = b.url AND a.version_no = b.version_no AND a.event_type = b.event_type WHERE a.url IS NULL""")
def version_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of each user's page, with a link per type of event."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), (F.col("event_id") % 3).alias("version"), F.col("event_type").alias("label")).distinct()
    snaps = e.select("url", "version", "label", F.lit("a").alias("type"), F.lit("Page").alias("group"), F.col("label").alias("id"), F.lit(1).alias("pos"))
    return diff.version_diffs(snaps).select("url", "version_no", "change", "label")


@_query("""SELECT p_partkey AS request_id, 1::BIGINT AS n_matches, p_partkey % 4 <> 0 AS verified FROM part""")
def heal_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per part with one link; a fourth of the requests ask for another label."""
    p = table(spark, sf_dir, "part")
    pages = p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit('<div><a id="p'), "p_partkey", F.lit('" href="/x">Part '), "p_partkey", F.lit("</a></div>")).alias("html"))
    label = F.when(F.col("p_partkey") % 4 == 0, "zzzz!").otherwise(F.concat(F.lit("part "), "p_partkey"))
    asked = p.select(F.col("p_partkey").alias("request_id"), F.col("p_partkey").alias("page_id"), F.concat(F.lit("#p"), "p_partkey").alias("selector"), label.alias("label"), F.lit("a").alias("action_type"))
    return heal.verify(asked, dom.nodes(pages))


@_query("""SELECT p_partkey AS request_id, CASE WHEN p_partkey % 3 = 0 THEN '#cached' ELSE '#p' || p_partkey END AS selector, CASE WHEN p_partkey % 3 = 0 THEN 'cache' ELSE 'local' END AS source FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 4 <> 0""")
def heal_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages: a third of the requests is in the cache, and a fourth asks for what is not there."""
    p = table(spark, sf_dir, "part")
    pages = p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit('<div><a id="p'), "p_partkey", F.lit('" href="/x">Part '), "p_partkey", F.lit("</a></div>")).alias("html"))
    label = F.when(F.col("p_partkey") % 4 == 0, "zzzz!").otherwise(F.concat(F.lit("part "), "p_partkey"))
    asked = p.select(F.col("p_partkey").alias("request_id"), F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://x.co/"), "p_partkey").alias("url"), label.alias("label"), F.lit("a").alias("action_type"))
    cached = asked.filter("request_id % 3 = 0").select(heal.cache_key(F.col("url"), F.col("label"), F.col("action_type")).alias("cache_key"), F.lit("#cached").alias("selector"))
    return heal.heal(asked, dom.nodes(pages), cached).select("request_id", "selector", "source")


@_query("""SELECT c_custkey AS page_id, 'handoff' AS status, 1::BIGINT AS handoffs, 0::BIGINT AS questions FROM customer""")
def form_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form plans with their questions answered, replayed: the password still needs a person."""
    pages = _form_pages(spark, sf_dir)
    classes = pages.select("page_id", F.lit("Static").alias("page_class"))
    profiles = pages.select("page_id", F.create_map(F.lit("email"), F.lit("ada@example.com"), F.lit("company"), F.lit("Acme")).alias("profile"))
    steps = forms.plan(schema.form_fields(pages), actions.actions(pages), classes, profiles)
    answers = pages.select("page_id", F.explode(F.array(F.lit("form0_field3"), F.lit("form0_field4"))).alias("question"), F.lit("yes").alias("answer"))
    outcomes = pages.select("page_id", F.lit("1").alias("sid"), F.lit(True).alias("ok"))
    return forms.replay(forms.answer(steps, answers), outcomes).select("page_id", "status", "handoffs", "questions")


@_query("""SELECT page_id, min(len(regexp_extract_all(html, '<p>'))) AS paragraphs, min(len(regexp_extract_all(html, '<li>'))) AS items FROM pages GROUP BY page_id""")
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph and item nodes of every page."""
    n = dom.nodes(_pages(spark, sf_dir))
    return n.groupBy("page_id").agg(F.count_if(F.col("tag") == "p").alias("paragraphs"), F.count_if(F.col("tag") == "li").alias("items"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
