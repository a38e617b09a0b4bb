import random
from collections import defaultdict

from pyspark.sql import functions as F

from pagelens.operators import blocks, classify, compare, forms
from pagelens.sources import inputs


def test_url_list(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# top\nhttps://a.co\n\n  https://b.co \nhttps://a.co\n")
    (tmp_path / "b.txt").write_text("https://b.co\nhttps://c.co\n")
    rows = inputs.url_list(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")).orderBy("place").collect()
    assert [r.url for r in rows] == ["https://a.co", "https://b.co", "https://c.co"]


def test_json_inputs(spark):
    rows = spark.createDataFrame([(1, '{"q1":"yes","q2":"no"}'), (2, "no json"), (3, None)], "page_id long, answers string")
    assert sorted((r.page_id, r.question, r.answer) for r in inputs.answers(rows).collect()) == [(1, "q1", "yes"), (1, "q2", "no")]
    texts = spark.createDataFrame([('{"a":1}',), ("[1, 2]",), ("{broken",), ("plain 'x' \"y\"",)], "t string")
    got = [r.v for r in texts.select(F.to_json(inputs.json_or_text(F.col("t"))).alias("v")).collect()]
    assert got == ['{"a":1}', "[1,2]", '"{broken"', '"plain \'x\' \\"y\\""']


def test_cache_round_trip(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert inputs.load_cache(spark, path).count() == 0
    inputs.save_cache(spark.createDataFrame([("a.co|/|a|x", "#x")], inputs.CACHE), path)
    assert [tuple(r) for r in inputs.load_cache(spark, path).collect()] == [("a.co|/|a|x", "#x")]


def test_a_cache_may_be_saved_where_it_was_read(spark, tmp_path):
    path = str(tmp_path / "cache")
    for k in range(3):
        known = inputs.load_cache(spark, path)
        inputs.save_cache(known.unionByName(spark.createDataFrame([(f"k{k}", "#x")], inputs.CACHE)), path)
    assert sorted(r.cache_key for r in inputs.load_cache(spark, path).collect()) == ["k0", "k1", "k2"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["cache"]


def test_once_per_url_and_by_content(spark):
    rows = [("s", 1, "a"), ("s", 2, "a"), ("s", 3, "b"), ("s", 4, "a"), ("s", 5, None), ("s", 6, None), ("t", 1, "a")]
    caps = spark.createDataFrame(rows, "session string, at int, url string")
    assert sorted((r.session, r.at) for r in inputs.once_per_url(caps).collect()) == [("s", 1), ("s", 3), ("s", 4), ("s", 5), ("s", 6), ("t", 1)]
    pages = spark.createDataFrame([(1, "<p>x</p>"), (2, "<p>x</p>"), (3, "<p>y</p>"), (4, None)], "page_id long, html string")
    contents, places = inputs.by_content(pages)
    found = places.join(blocks.blocks(contents).select(F.col("page_id").alias("content_id"), "text"), "content_id")
    assert contents.count() == 2 and sorted((r.page_id, r.text) for r in found.collect()) == [(1, "x"), (2, "x"), (3, "y")]
    paths = spark.createDataFrame([([1, 2],), (None,)], "path array<int>")
    assert [r[0] for r in paths.select(inputs.binding_path_json(F.col("path"))).collect()] == ["[1,2]", "[]"]


def test_gaps_match_plain_containment(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["own", "b", "c"]), "".join(rng.choice("ab ") for _ in range(rng.randrange(7)))) for _ in range(300)]
    rows += [("own", "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9)))) for _ in range(60)] + [("b", "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9)))) for _ in range(60)]
    rows = [r for r in rows if "a" not in r[1] or len(r[1]) > 4]
    sites = defaultdict(set)
    for s, label in rows:
        if label.strip(" "):
            sites[label.strip(" ").lower()].add(s)
    mine, theirs = [x for x in sites if "own" in sites[x]], [x for x in sites if sites[x] - {"own"}]
    missing = sorted(x for x in theirs if not any(m in x or x in m for m in mine))[:15]
    unique = sorted(x for x in mine if not any(t in x or x in t for t in theirs))[:15]
    df = compare.gaps(spark.createDataFrame(rows, "site string, label string"), "own")
    got = [tuple(r) for r in df.collect()]
    assert got == [("missing", x, len(sites[x] - {"own"})) for x in missing] + [("unique", x, 1) for x in unique] and missing and unique
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_gaps(spark):
    rows = [("own", "Merge files"), ("own", "Sign"), ("b", "merge"), ("b", "Split"), ("c", "split"), ("c", "Redact text"), ("c", "")]
    got = compare.gaps(spark.createDataFrame(rows, "site string, label string"), "own").collect()
    assert [tuple(r) for r in got] == [("missing", "redact text", 1), ("missing", "split", 2), ("unique", "sign", 1)]


def test_tool_renderings(spark):
    pages = spark.createDataFrame([(1, '[{"name":"book","description":"Book & pay","inputSchema":{"a":1}},{"name":"x"}]')], "page_id long, tools string")
    tools = classify.webmcp_tools(pages)
    assert classify.webmcp_terse(tools).first().terse == "# webmcp tools (2)\n@1 tool:book Book & pay\n@2 tool:x"
    named = pages.withColumn("url", F.lit("u")).withColumn("title", F.lit("t"))
    assert classify.webmcp_xml(tools, named).first().xml == (
        '<page url="u" title="t" mode="webmcp"><group name="WebMCP Tools"><action id="1" type="webmcp_tool" tool_name="book" label="Book &amp; pay" input_schema="{&quot;a&quot;:1}"/>'
        '<action id="2" type="webmcp_tool" tool_name="x" label="x" input_schema="{}"/></group></page>'
    )


def test_messages_and_steps(spark):
    filled = spark.createDataFrame([(1, 0, "1", "x", "work email"), (1, 1, "2", "y", "company")], "page_id long, place int, sid string, value string, blob string")
    appeared = spark.createDataFrame([(1, 5, "Company: must be set"), (1, 6, "Hello"), (1, 7, "Required: something else")], "page_id long, pos int, label string")
    assert [(r.pos, r.sid) for r in forms.message_errors(filled, appeared).collect()] == [(5, "2")]
    steps = [(1, 1, "auto_fill", "a"), (1, 2, "auto_fill", "b"), (1, 3, "ask", None), (2, 1, "handoff", None), (2, 2, "auto_fill", "z")]
    plans = spark.createDataFrame(steps, "page_id long, step int, action string, sid string")
    outcomes = spark.createDataFrame([(1, 1, "a", True), (1, 2, "b", True)], "page_id long, step int, sid string, ok boolean")
    assert sorted(tuple(r) for r in forms.replay_steps(plans, outcomes).collect()) == [(1, 3, "questions_pending"), (2, 1, "handoff")]
