import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagelens.functions import similarity, urls
from pagelens.operators import actions, dom, forms, heal, schema
from pagelens.plans import catalogue
from pagelens.streaming import state

SIGNUP = """<form><input type="email" name="email" placeholder="Work email" required><input name="full_name" placeholder="Full name"><input name="company" placeholder="Company">
<input name="job" placeholder="Job title" required><textarea name="bio" placeholder="Bio"></textarea><input type="file" name="cv"><input type="hidden" name="t"><button>Create account</button></form>"""


def plan(spark, html, profile, page_class="Static", **kw):
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    classes = spark.createDataFrame([(1, page_class)], "page_id long, page_class string")
    profiles = spark.createDataFrame([(1, profile)], "page_id long, profile map<string,string>")
    return forms.plan(schema.form_fields(pages), actions.actions(pages), classes, profiles, **kw)


def test_plan(spark):
    steps = plan(spark, SIGNUP, {"email": "a@b.co", "name": "Ada Lovelace", "company": "Acme"})
    got = steps.orderBy("place").collect()
    assert [r.action for r in got[:4]] == ["auto_fill", "auto_fill", "auto_fill", "ask"] and got[3].reason == "missing_profile_value"
    assert [(r.action, r.reason) for r in got[4:]] == [("handoff", "file_upload"), ("skip", "hidden_field"), ("ask", "ambiguous_field")]
    assert {r.value for r in got if r.action == "auto_fill"} == {"a@b.co", "Ada Lovelace", "Acme"}
    answers = spark.createDataFrame([(1, "form0_field3", "Engineer")], "page_id long, question string, answer string")
    answered = forms.answer(steps, answers)
    assert forms.summarize(answered).first().auto_fill == 4
    outcome = spark.createDataFrame([(1, "1", True)], "page_id long, sid string, ok boolean")
    assert forms.replay(steps, outcome).first().status == "questions_pending"


def test_submit_comes_last(spark):
    html = '<form><input type="email" name="email" placeholder="Email"><button>Sign up</button></form>'
    got = plan(spark, html, {"email": "a@b.co"}).orderBy("place").collect()
    assert [(r.action, r.sid) for r in got] == [("auto_fill", "1"), ("submit", "2")]


def test_plans_broadcast_no_table_of_pages(spark, sf_dir):
    made = catalogue.form_plan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in made and made.count("SortMergeJoin") == 3


def test_answers_broadcast_no_table_of_pages(spark, sf_dir):
    made = catalogue.form_answers(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in made and made.count("SortMergeJoin") == 6


def test_blockers_stop_plans(spark):
    assert [r.reason for r in plan(spark, SIGNUP, {}, "Anti-bot").collect()] == ["anti_bot"]
    assert [r.reason for r in plan(spark, "<div><button>Continue with Google</button><form><input name=x></form></div>", {}).collect()] == ["oauth"]
    assert [r.reason for r in plan(spark, "<p>nothing</p>", {}).collect()] == ["no_forms"]


@pytest.mark.parametrize(
    ("label", "kind"),
    [("Company name", "company"), ("E-Mail", "email"), ("Téléphone", "phone"), ("hCaptcha", "captcha"), ("Google", "oauth"), ("Favourite colour", "unknown"), ("", "email"), ("Surname", "last_name")],
)
def test_kinds(spark, label, kind):
    rows = spark.createDataFrame([("text", "input", similarity.fold(label))], "type string, tag string, blob string")
    got = rows.select(forms.field_kind().alias("k")).first().k
    assert got == kind or label == ""  # an empty text is part of every alias; the longest is an email's
    assert label != "" or got == "email"


def test_profiles_and_values(spark):
    rows = spark.createDataFrame([({"email": "a@b.co", "companny": "x"},)], "profile map<string,string>")
    v = forms.validate_profiles(rows).first()
    assert (v.valid, v.unknown_keys, v.missing_recommended) == (False, ["companny"], ["name"])
    values = spark.createDataFrame([("email", "bad"), ("email", " a@b.co "), ("name", "bad")], "k string, v string")
    assert [r.e is None for r in values.select(forms.invalid_value(F.col("k"), F.col("v")).alias("e")).collect()] == [False, True, True]


def test_validation_errors(spark):
    filled = spark.createDataFrame([(1, 0, "1", "email", "x"), (1, 1, "2", "name", "y")], "page_id long, place int, sid string, name string, value string")
    invalid = spark.createDataFrame([(1, 0, "name", "too short"), (1, 1, "", ""), (1, 2, "other", "x")], "page_id long, pos int, name string, message string")
    assert [(r.pos, r.sid, r.message) for r in forms.validation_errors(filled, invalid).orderBy("pos").collect()] == [(0, "2", "too short"), (1, "1", "client validation failed")]


def test_scores_and_ranks(spark):
    rows = spark.createDataFrame([("Log in", "log in ", True, False), ("Log in", "Please log in", False, True), ("Log in", "", False, False), ("Log in", "Lag in", False, False)], "label string, candidate_label string, has_id boolean, has_aria boolean").withColumn("has_testid", F.lit(False)).withColumn("has_name", F.lit(None).cast("boolean"))
    assert [round(r.s, 4) for r in rows.select(heal.score(F.col("label"), F.col("candidate_label")).alias("s")).collect()] == [0.9, round(0.92 * 0.7 + 0.25, 4), 0.0, round(similarity.ratio("log in", "lag in") * 0.7, 4)]


def test_heal(spark):
    html = '<div><button id="go" aria-label="Send message">x</button><a href="/" class="c d">Home</a><input name="q" placeholder="Search"></div>'
    nodes = dom.nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    wanted = spark.createDataFrame([(7, 1, "https://a.co/p", "Send message", "button"), (8, 1, "https://a.co/p", "Nothing like it", "a")], "request_id long, page_id long, url string, label string, action_type string")
    assert [(r.request_id, r.selector, r.source) for r in heal.heal(wanted, nodes).collect()] == [(7, "#go", "local")]
    cache = spark.createDataFrame([("a.co|/p|a|nothing like it", "a.c")], "cache_key string, selector string")
    assert sorted((r.request_id, r.source) for r in heal.heal(wanted, nodes, cache).collect()) == [(7, "local"), (8, "cache")]
    asked = spark.createDataFrame([(1, 1, "a.d", "home", "a"), (2, 1, "input[name=\"q\"]", "", "input[text]"), (3, 1, "#none", "x", "a"), (4, 1, "button", "Other", "button")], "request_id long, page_id long, selector string, label string, action_type string")
    assert [(r.request_id, r.verified) for r in heal.verify(asked, nodes).orderBy("request_id").collect()] == [(1, True), (2, True), (3, False), (4, False)]


def test_url_join(spark):
    cases = {"x": "http://a.co/d/x", "../x": "http://a.co/x", "/y?q": "http://a.co/y?q", "//b.co/z": "http://b.co/z", "?k": "http://a.co/d/p?k", "#f": "http://a.co/d/p?o#f", "https://c.co": "https://c.co", "./": "http://a.co/d/", "a/./b/../c": "http://a.co/d/a/c", "": "http://a.co/d/p?o"}
    rows = spark.createDataFrame(list(cases.items()), "ref string, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", urls.join(F.lit("http://a.co/d/p?o"), F.col("ref"))).collect())


def test_rate_limit_replay(spark):
    rows = [("a", k, float(t)) for k, t in enumerate([0, 1, 2, 9, 10, 11, 12])] + [("b", 100, 0.0), (None, 101, 0.0)]
    got = {r.request_id: r.accepted for r in state.replay_limit(spark.createDataFrame(rows, "key string, request_id long, ts double"), limit=2, window_s=10).collect()}
    assert [got[k] for k in range(7)] == [True, True, False, False, True, True, False] and got[100] and got[101]


def test_changes():
    assert state.changes({"a": "1", "b": "1"}, {"b": "2", "c": "1"}) == [("appeared", "c"), ("changed", "b"), ("disappeared", "a")]


def _drain(spark, frame, name, tmp_path, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def stream(name, schema, *batches):
        folder = tmp_path / f"in_{name}"
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{k}"))
            time.sleep(0.02)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))

    try:
        limited = _drain(spark, state.limit_stream(stream("limit", "key string, request_id long, ts double", [("a", 1, 0.0), ("a", 2, 1.0)], [("a", 3, 2.0), ("b", 4, 2.0)]), limit=2, window_s=100), "limit_out", tmp_path)
        assert {r.request_id: r.accepted for r in limited} == {1: True, 2: True, 3: False, 4: True}
        changed = _drain(spark, state.snapshot_stream(stream("snap", "url string, version long, fp string, content_hash string", [("u", 1, "a", "x"), ("u", 1, "b", "x")], [("u", 2, "b", "y"), ("u", 2, "c", "x")])), "snap_out", tmp_path)
        assert sorted((r.version, r.change, r.fp) for r in changed) == [(1, "appeared", "a"), (1, "appeared", "b"), (2, "appeared", "c"), (2, "changed", "b"), (2, "disappeared", "a")]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_accept_is_a_plain_window():
    seen, out = state.accept([], pd.Series([0.0, 0.5, 20.0]).tolist(), 1, 10)
    assert out == [True, False, True] and seen == [20.0]
