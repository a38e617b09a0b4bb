import json

import pytest

from pagelens.operators import schema


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def one(spark, html, **kw):
    return schema.tables(pages(spark, html), **kw).first()


def table(head, rows):
    return "<table><thead><tr>" + "".join(f"<th>{h}</th>" for h in head) + "</tr></thead><tbody>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</tbody></table>"


@pytest.mark.parametrize(
    ("values", "kind"),
    [
        (["1", "2,000", "-3"], "integer"),
        (["1.5", "2"], "number"),
        (["$1.50", "2", "€3"], "currency"),
        (["10%", "5"], "percentage"),
        (["2024-01-02", "31/12/2024"], "date"),
        (["a@b.co", "c@d.org"], "email"),
        (["https://a.co", "http://b.co"], "url"),
        (["—", "-", ""], "string"),
        (["x", "1"], "string"),
        (["1e5", "nan", "1_000"], "integer"),
    ],
)
def test_types(spark, values, kind):
    assert one(spark, table(["v"], [[v] for v in values])).types == [kind]


def test_shapes(spark):
    t = one(spark, table(["a", "b"], [["1"], ["1", "2", "3"]]))
    assert t.columns == ["a", "b", "column_3"] and t.column_count == 3 and t.types == ["integer"] * 3
    assert one(spark, "<table><tbody><tr><td>x</td><td>y</td></tr></tbody></table>").columns == ["col_1", "col_2"]
    first = one(spark, "<table><tr><td>x</td></tr><tr><td>y</td></tr></table>")
    assert first.columns == ["x"] and first.total_rows == 2
    cut = one(spark, table(["n"], [[str(k)] for k in range(100)]), max_rows=10)
    assert (cut.total_rows, cut.rows_returned, cut.rows_truncated, len(cut.rows)) == (100, 10, True, 10)
    assert schema.tables(pages(spark, "", "<p>no</p>")).count() == 0


def test_exports(spark):
    t = schema.tables(pages(spark, table(["name", "price", "name"], [['a "b", c', "$1,200.50", "z"], ["—", "3", ""]])))
    assert schema.to_csv(t).first().csv == 'name,price,name\n"a ""b"", c","$1,200.50",z\n—,3,'
    assert [json.loads(r) for r in schema.records_json(t).first().records] == [{"price": 1200.5, "name": "z"}, {"price": 3, "name": None}]


FORM = """<form action="/join" method="post"><input type="submit" value=" Go "><label for="m">Mail</label><input id="m" type="email" name="mail" required>
<input type="weird" name="first_name"><label>I agree <input type="checkbox" name="ok" disabled></label>
<select name="s"><option value="1">One<option>Two</select><textarea name="t" rows="3"></textarea><button>Send</button><button type="button">No</button></form>"""


def test_forms(spark):
    rows = schema.form_fields(pages(spark, FORM)).orderBy("field_idx").collect()
    assert [(r.tag, r.type, r.name, r.required, r.disabled) for r in rows] == [
        ("input", "email", "mail", True, False),
        ("input", "text", "first_name", False, False),
        ("input", "checkbox", "ok", False, True),
        ("select", "select", "s", False, False),
        ("textarea", "textarea", "t", False, False),
        ("button", "submit", None, False, False),
        ("input", "submit", None, False, False),
    ]
    assert [r.label for r in rows] == ["Mail", "Mail", "I agree", "Mail", "Mail", "Send", "Go"]
    assert [(o.value, o.label) for o in rows[3].options] == [("1", "One"), ("", "Two")]
    form = schema.forms(schema.form_fields(pages(spark, FORM, "<form></form>"))).orderBy("page_id").collect()
    assert (form[0].action, form[0].method, form[0].field_count) == ("/join", "POST", 7)
    assert (form[1].action, form[1].method, form[1].field_count) == (None, "GET", 0)


def test_names_become_labels(spark):
    html = '<form><input name="first_name"><input placeholder=" Your  town "><input></form>'
    assert [r.label for r in schema.form_fields(pages(spark, html)).orderBy("field_idx").collect()] == ["First name", "Your town", ""]


def test_lists(spark):
    html = "<div><ol><li>1</li></ol><ul><li>a<ul><li>b</li></ul> tail</li><li></li></ul><select><option>x<option>y<option>z</select><form><select><option>1<option>2<option>3</select></form></div>"
    rows = schema.lists(pages(spark, html)).orderBy("list_idx").collect()
    assert [(r.type, [i.label for i in r["items"]]) for r in rows] == [("unordered", ["a"]), ("unordered", ["b"]), ("ordered", ["1"]), ("select", ["x", "y", "z"])]


def test_page_schema_says_what_its_parts_say_in_one_parse(spark):
    html = [
        "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>x@y.z</td></tr></table><table><tr><td>q</td></tr></table>",
        "<form action=/go><input name=q required><select name=s><option value=1>One</option></select></form><form></form><ul><li>x</li><li>y</li></ul><ol><li>z</li></ol>",
        "<p>nothing</p>", "", None,
    ]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    df = schema.page_schema(pages)
    got = {r.page_id: r for r in df.collect()}
    assert df._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    assert {k: (r.n_tables, r.n_forms, r.n_lists) for k, r in got.items()} == {0: (2, 0, 0), 1: (0, 2, 2), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0)}
    for r in schema.tables(pages).collect():
        t = got[r.page_id].tables[r.table_idx]
        assert (t.columns, t.types, t.rows, t.total_rows) == (r.columns, r.types, r.rows, r.total_rows)
    for r in schema.forms(schema.form_fields(pages)).collect():
        f = got[r.page_id].forms[r.form_idx]
        assert (f.action, f.method, [x.asDict() for x in f.fields]) == (r.action, r.method, [{k: v for k, v in x.asDict().items() if k != "field_idx"} for x in r.fields])
    for r in schema.lists(pages).collect():
        x = got[r.page_id].lists[r.list_idx]
        assert (x.type, x.items, x.total) == (r.type, r["items"], r.total)
