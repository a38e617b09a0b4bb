from pagelens.operators import dom


def tags(html):
    root = dom.parse(html)
    return [n.tag for n in root.walk()] if root else None


def test_blank_and_fragments():
    assert dom.parse(None) is None and dom.parse("  \n") is None
    assert tags("<p>a</p>") == ["p"]
    assert tags("<p>a</p><p>b</p>") == ["div", "p", "p"]


def test_paragraphs_items_cells_and_options_close():
    assert tags("<div><p>a<p>b<div>c</div></div>") == ["div", "p", "p", "div"]
    ul = dom.parse("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>")
    assert [c.tag for c in ul.children] == ["li", "li", "li"]
    table = dom.parse("<table><tr><td>1<td>2<tr><td>3</table>")
    assert [[dom.clean(d.content()) for d in r.children] for r in table.children] == [["1", "2"], ["3"]]
    assert [o.content() for o in dom.parse("<select><option>a<option>b</select>").children] == ["a", "b"]


def test_no_tbody_is_made_up_and_raw_text_stays_raw():
    assert tags("<table><tr><td>x</td></tr></table>") == ["table", "tr", "td"]
    page = dom.parse('<html><head><script>var t="</p><b>";</script></head><body><p>x &amp; y</p></body></html>')
    assert [n.tag for n in page.walk()] == ["html", "head", "script", "body", "p"]
    assert dom.scope(page).children[0].text == "x & y"


def test_the_end_closes_everything():
    page = dom.parse("<html><body><div><p>cut")
    assert [n.tag for n in page.walk()] == ["html", "body", "div", "p"] and page.content() == "cut"


def test_comments_are_no_text_content():
    root = dom.parse("<div>a<!-- c -->b</div>")
    assert root.content() == "ab" and root.children[0].text == " c "


def test_node_rows(spark):
    pages = spark.createDataFrame([(1, "<div><p>a<b>b</b>c</p><p>d</p></div>"), (2, ""), (3, None)], "page_id long, html string")
    rows = dom.nodes(pages).orderBy("page_id", "node_id").collect()
    assert [(r.node_id, r.end_id, r.parent_id, r.tag) for r in rows] == [(0, 3, None, "div"), (1, 2, 0, "p"), (2, 2, 1, "b"), (3, 3, 0, "p")]
    assert [a.tag for a in rows[2].ancestors] == ["div", "p"] and rows[2].tail == "c"


def test_broken_markup_never_stops_a_page():
    """Marked sections, unfinished tags and very deep nesting give a tree, or none, but no error."""
    for html in ("<![if IE]>x<![endif]><p>y</p>", "<![foo[bar]]>x", "<![", "<!", "<a b='c", "</", "<!--", "<?php ?>x", "&#xFFFFFFFF;", "<div>" * 3000 + "deep", "<ul><li>" * 900, "<table><tr><td>" * 500):
        root = dom.parse(html)
        rows = dom.node_rows(root)
        assert all(len(r["ancestors"]) <= dom.DEPTH + 1 for r in rows)
    assert dom.parse("<![if IE]><p>x</p><![endif]><p>y</p>").content() == "xy"
    assert dom.parse("<div>" * 3000 + "deep").content() == "deep"
