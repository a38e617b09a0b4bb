import pytest
from pyspark.sql import functions as F

from pagelens.operators import classify, diff, security


@pytest.mark.parametrize(
    ("values", "kind"),
    [
        (dict(html="Just a moment..."), "Anti-bot"),
        (dict(html="x" * 30_000, n_actions=3, text_chars=10), "SparseShell"),
        (dict(html="x", n_actions=3, has_body=False), "SparseShell"),
        (dict(url="https://a.co/login?x"), "Auth-gated"),
        (dict(html="x" * 2000, n_actions=0), "SPA"),
        (dict(shadow_hosts=2, a11y_nodes=1), "Closed Shadow"),
        (dict(shadow_hosts=2), "Shadow DOM"),
        (dict(cross_origin_iframes=1), "Iframe-heavy"),
        (dict(), "Static"),
    ],
)
def test_page_class(spark, values, kind):
    row = dict(url="https://a.co/", html="<p>x</p>", n_actions=5, shadow_hosts=0, cross_origin_iframes=0, a11y_nodes=0, shell=None, has_body=None, text_chars=None) | values
    schema = "url string, html string, n_actions int, shadow_hosts int, cross_origin_iframes int, a11y_nodes int, shell boolean, has_body boolean, text_chars int"
    rows = spark.createDataFrame([tuple(row.values())], schema)
    assert classify.page_class(rows).first().page_class == kind


def probe(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, at int, has_body boolean, text_chars int, html_chars int, card_candidates int, price_hits int, consent_only boolean")


def test_readiness(spark):
    log = probe(
        spark,
        ("grows", 0, True, 100, 900, 0, 0, False),
        ("grows", 400, True, 900, 900, 0, 0, False),
        ("grows", 800, True, 930, 900, 0, 0, False),
        ("cards", 0, True, 450, 900, 4, 0, False),
        ("late", 0, True, 10, 900, 0, 0, False),
        ("late", 10_500, True, 5000, 900, 0, 0, False),
        ("banner", 0, True, 300, 30_000, 0, 0, True),
    )
    got = {r.url: r for r in classify.replay_readiness(log).collect()}
    assert (got["grows"].ready, got["grows"].wait_ms) == (True, 800)
    assert got["cards"].ready and got["cards"].why == "ready"
    assert not got["late"].ready and got["late"].shell and got["late"].n_probes == 1
    assert got["banner"].why == "sparse_shell"
    steps = classify.probe_log(log).filter("url = 'grows'").orderBy("at").collect()
    assert [s.grew for s in steps] == [False, True, False] and [s.wants_scroll for s in steps] == [True, False, False]


def test_accessibility_supplement(spark):
    raw = spark.createDataFrame(
        [(1, 1, False, "button", "Send form", "", 5), (1, 2, False, "button", "Again", "", 5), (1, 3, True, "link", "x", "", 6), (1, 4, False, "text", "x", "", 7), (1, 5, False, "searchbox", "", "find", 8), (1, 6, False, "link", "Hidden & co", "", 9), (1, 7, False, "link", "no id", "", 0)],
        "page_id long, pos int, ignored boolean, role string, name string, value string, backend_id long",
    )
    nodes = classify.ax_nodes(raw)
    assert [(r.role, r.name) for r in nodes.orderBy("pos").collect()] == [("button", "Send form"), ("searchbox", "find"), ("link", "Hidden & co")]
    labels = spark.createDataFrame([(1, "SEND FORM"), (2, "find")], "page_id long, label string")
    extra = classify.ax_supplement(nodes, labels)
    assert [r.markup for r in extra.orderBy("pos").collect()] == [
        '<input data-sw-bind="sw-a11y-1" data-sw-source="a11y" aria-label="find" type="search">find</input>',
        '<a data-sw-bind="sw-a11y-2" data-sw-source="a11y" aria-label="Hidden &amp; co" href="#">Hidden &amp; co</a>',
    ]
    pages = spark.createDataFrame([(1, "<body>x</body>", 1), (2, "<body>y</body>", 0)], "page_id long, html string, shadow_hosts int")
    merged = {r.page_id: r for r in classify.merge_captures(pages, extra, mode="auto").collect()}
    assert merged[1].html.endswith("</section></body>") and merged[1].a11y_nodes == 2 and merged[2].html == "<body>y</body>"


def test_consent_and_tools(spark):
    acts = spark.createDataFrame([(1, 1, "1", "Manage cookies"), (1, 2, "2", "Accept all"), (1, 3, "3", "I accept cookies here"), (2, 1, "1", "Home")], "page_id long, pos int, id string, label string")
    assert [(r.page_id, r.id) for r in classify.consent_buttons(acts).collect()] == [(1, "2")]
    pages = spark.createDataFrame([(1, '[{"name":"book","description":"Book it","inputSchema":{"a":1}},{"name":""},{"name":"x"}]'), (2, "nonsense"), (3, None)], "page_id long, tools string")
    tools = classify.webmcp_actions(classify.webmcp_tools(pages)).orderBy("pos").collect()
    assert [(r.id, r.label, r.tool_name) for r in tools] == [("1", "Book it", "book"), ("2", "x", "x")] and tools[0].input_schema == '{"a":1}'


def snapshot(spark, *rows):
    return spark.createDataFrame([("u", k, str(k), *r) for k, r in enumerate(rows)], "url string, pos int, id string, type string, label string, group string, input_schema string")


def test_diff(spark):
    a = snapshot(spark, ("a", "Home", "Nav", None), ("a", "Old", "Nav", None), ("a", "Twin", "Nav", None), ("tool", "t", "T", '{"a":1}'))
    b = snapshot(spark, ("a", "Home", "Nav", None), ("a", "New", "Nav", None), ("a", "Twin", "Nav", None), ("a", "Twin", "Nav", None), ("tool", "t", "T", '{"a":2}'))
    got = sorted((r.change, r.label) for r in diff.diff(a, b).collect())
    assert got == [("appeared", "New"), ("appeared", "Twin"), ("changed", "t"), ("disappeared", "Old")]
    assert diff.diff(a, a).count() == 0
    pages = diff.page_groups(b)
    terse = diff.diff_terse(diff.diff(a, b), pages).first().terse.split("\n")
    assert terse[:4] == ["# diff u", "groups: Nav, T", "## appeared", "@1 Nav > a[New] (#1) — New"] and "## disappeared" in terse
    assert diff.diff_terse(diff.diff(a, a), pages).first().terse.endswith("(no changes)")
    xml = diff.diff_xml(diff.diff(a, b), pages).first().xml
    assert '<appeared count="2">' in xml and '<group name="Nav"/>' in xml and 'previous_label="t"' in xml
    assert diff.full_snapshots(a.limit(0), b).count() == 5


def test_versions(spark):
    rows = [("u", v, k, str(k), "a", label, "Nav", None) for v, labels in ((1, "ab"), (4, "abc"), (9, "c")) for k, label in enumerate(labels)]
    snaps = spark.createDataFrame(rows, "url string, version int, pos int, id string, type string, label string, group string, input_schema string")
    got = sorted((r.version_no, r.change, r.label) for r in diff.version_diffs(snaps).collect())
    assert got == [(2, "appeared", "c"), (3, "disappeared", "a"), (3, "disappeared", "b")]


def test_links(spark):
    pages = spark.createDataFrame([(1, "http://a.co/dir/page")], "page_id long, url string")
    hrefs = ["../admin/x", "https://a.co/ok", "http://b.co/", "#top", "javascript:go()", "mailto:x@y.z", "?q=1", "/dup/", "/dup"]
    acts = spark.createDataFrame([(1, k, k + 1, "Delete all" if k == 6 else f"l{k}", h) for k, h in enumerate(hrefs)], "page_id long, pos int, grouped_pos int, label string, href string")
    found = security.link_findings(acts, pages).collect()
    count = lambda rule: sum(f.rule_id == rule for f in found)
    assert (count("LINK_JAVASCRIPT"), count("PAGE_HTTP"), count("LINK_HTTP_RESOURCE"), count("LINK_EXTERNAL"), count("LINK_SENSITIVE_PATH")) == (1, 1, 1, 1, 2)
    assert [r.link for r in security.same_domain_links(acts, pages).orderBy("n").collect()] == ["http://a.co/admin/x", "https://a.co/ok", "http://a.co/dir/page", "http://a.co/dup"]


def test_cors_and_roll_up(spark):
    probes = spark.createDataFrame([(1, "https://a.co/x", None, "https://a.co", "true", ""), (2, "https://b.co/", None, "*", "TRUE", "GET"), (3, "https://c.co/", None, None, None, None)], "page_id long, url string, origin_sent string, acao string, acac string, allow_methods string")
    found = security.cors_findings(probes)
    assert sorted((f.page_id, f.rule_id, f.severity) for f in found.collect()) == [(1, "CORS_ORIGIN_ECHO", "high"), (2, "CORS_WILDCARD_WITH_CREDENTIALS", "critical")]
    rolled = security.roll_up(found.union(found)).collect()
    assert len(rolled) == 2 and all(r.place == 1 for r in rolled)
    totals, top = security.report(security.severity_counts(security.roll_up(found)), probes.select("page_id", "url", F.when(F.col("page_id") == 3, "down").alias("error")))
    assert totals.first().asDict() == {"pages_scanned": 2, "pages_failed": 1, "critical": 1, "high": 1, "medium": 0, "low": 0, "info": 0}
    assert [(r.page_id, r.risk_score) for r in top.collect()] == [(2, 100), (1, 25)]
    text = security.markdown(totals, top, security.roll_up(found), probes).first().markdown
    assert "https://b.co/ (risk 100)" in text and "CORS_ORIGIN_ECHO" in text
