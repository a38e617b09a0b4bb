from pyspark.sql import functions as F

from pagelens.functions import text
from pagelens.operators import blocks


def build(spark, html):
    return blocks.blocks(spark.createDataFrame([(1, html)], "page_id long, html string"))


def rows(spark, html):
    return build(spark, html).orderBy("block_no").collect()


ARTICLE = """<html><body><h1>Top</h1><p>Intro text.</p><h2>First</h2><p>One.</p><h3>Deep</h3><p>Two <b>bold</b> end.</p><h2>Second</h2><p>Three.</p>
<nav><p>skip</p></nav><footer>skip</footer><aside>skip</aside><form><p>skip</p></form><table><tr><td>skip</td></tr></table></body></html>"""


def test_order_paths_and_zones(spark):
    got = rows(spark, ARTICLE)
    assert [r.text for r in got] == ["Top", "Intro text.", "First", "One.", "Deep", "Two bold end.", "Second", "Three."]
    assert [r.heading_path for r in got] == ["Top", "Top", "Top > First", "Top > First", "Top > First > Deep", "Top > First > Deep", "Top > Second", "Top > Second"]
    assert [r.id for r in got] == [f"p{k}" for k in range(8)]


def test_empty_and_span_only(spark):
    assert rows(spark, "") == []
    got = rows(spark, "<span>Hello there</span>")
    assert [(r.type, r.text) for r in got] == [("text_group", "Hello there")]


def test_cards_cluster_and_grids_do_not(spark):
    got = rows(spark, "<main>" + "".join(f"<div><span>Thing {k} with a name</span><span>{k} ₽ today</span></div>" for k in range(30)) + "</main>")
    assert len(got) > 1 and all(r.tokens <= 120 and r.type == "text_group" for r in got)
    assert all(sum(f"Thing {k} with" in r.text for r in got) == 1 for k in range(30))


def test_linked_runs_go_and_plain_lists_stay(spark):
    tail = "<p>" + "A real paragraph that is long enough to be content. " * 3 + "</p>"
    linked = "<h1>T</h1><ul>" + "".join(f'<li><a href="/{k}">l{k}</a></li>' for k in range(8)) + "</ul>" + tail
    assert [r.type for r in rows(spark, linked)] == ["heading", "paragraph"]
    assert [r.id for r in rows(spark, linked)] == ["p0", "p1"]
    plain = "<h1>T</h1><ul>" + "".join(f"<li>i{k}</li>" for k in range(5)) + "</ul>" + tail
    assert len(rows(spark, plain)) == 7


CATALOG = "<h1>Shop</h1>" + "".join(f"<p>Filter {k}</p>" for k in range(40)) + "".join(f"<p>Product number {k} is a fine thing for $ {k + 10}.99</p>" for k in range(12))


def test_catalogs_list_cards_first(spark):
    b = build(spark, CATALOG)
    text = blocks.outline(b, max_tokens=200).first().outline
    assert " | card | " in text.split("\n")[0] and "cards=12" in text and len(text) // 4 <= 200
    top = blocks.ranked(b).orderBy("rank").limit(12).collect()
    assert all(r.card for r in top)


def test_feeds_list_items_first(spark):
    post = "A post of medium length that says something about the day and goes on a little, number "
    html = "<h1>Feed</h1>" + "".join(f"<p>{k} likes</p>" for k in range(30)) + "".join(f"<p>{post}{k}</p>" for k in range(10))
    text = blocks.outline(build(spark, html), max_tokens=300).first().outline
    assert " | feed | " in text.split("\n")[0] and "feeds=10" in text


def test_outline_pages_within_the_budget(spark):
    b = build(spark, "".join(f"<p>Paragraph {k} says something of its own here.</p>" for k in range(100)))
    first = blocks.outline(b, max_tokens=100).first()
    assert len(first.outline) // 4 <= 100 and f"next={first.n_lines}" in first.outline
    second = blocks.outline(b, max_tokens=100, offset=first.n_lines).first().outline
    assert second.startswith(f"p{first.n_lines} |")
    assert blocks.outline(b, max_tokens=0).first().outline == ""
    assert len(blocks.outline(b, max_tokens=3).first().outline) <= 12


def test_fetch(spark):
    b = build(spark, "<p>" + "One sentence here. " * 20 + "</p><p>Two.</p><p>Three.</p>")
    ask = spark.createDataFrame([(1, ["p2", "p1", "p2", "nope", "p0"])], "page_id long, ids array<string>")
    got = blocks.fetch(b, ask, max_tokens=50).orderBy("ask").collect()
    assert [r.id for r in got] == ["p2", "p1", "p0"]
    assert got[2].text.endswith(". […truncated]") or got[2].text.endswith("here. […truncated]")
    assert blocks.fetch(b, ask, max_tokens=0).count() == 0


def test_quality(spark):
    pages = spark.createDataFrame([(1, ARTICLE), (2, "<div><span>8 € x</span><p>£5</p><p>$ 3.50</p><p>9 руб. z</p><p>12 EUR</p></div>"), (3, "")], "page_id long, html string")
    got = {r.page_id: r for r in blocks.quality(pages, blocks.blocks(pages)).collect()}
    assert got[1].coverage_pct == 100.0 and got[1].duplicate_overhead_pct == 0.0 and got[1].mode == "semantic"
    assert got[2].source_price_signals == got[2].indexed_price_signals == 5 and got[2].mode == "hybrid"
    assert got[3].source_tokens == 0 and got[3].coverage_pct == 100.0


def test_one_decimal_as_the_exact_value_says(spark):
    values = [100 * a / b for b in (1, 2, 3, 7, 8, 16, 40, 200, 400, 2000) for a in range(0, 3 * b, max(1, b // 60))] + [0.05, 0.15, 0.25, 0.35, 0.45, 2.675, 99.95, 6.25, 6.75]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.round1(F.col("v")).alias("r")).collect()
    assert [(r.v, r.r) for r in got if r.r != round(r.v, 1)] == []
