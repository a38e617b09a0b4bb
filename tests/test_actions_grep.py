import pytest

from pagelens.operators import actions, grep

SHOP = """<html><head><style>p{}</style><script>x()</script></head><body>
<header><h1>Shop</h1></header>
<main><div><button onclick="go()" aria-label="Buy now" class="b">Go</button><a href="/more" style="x">Read more</a></div></main>
<nav><a href="/home">Home</a></nav><a href="/free">Free</a>
<form><input type="email" placeholder="Your email"><input name="code"><button>Subscribe</button></form>
<div role="dialog" aria-label="Cookies"><span role="button">Accept</span></div>
</body></html>"""


@pytest.fixture(scope="module")
def acts(spark):
    return actions.actions(spark.createDataFrame([(1, SHOP)], "page_id long, html string")).cache()


def test_actions(acts):
    rows = acts.orderBy("pos").collect()
    assert [(r.id, r.type, r.label, r.group) for r in rows] == [
        ("1", "button", "Buy now", "Main"),
        ("2", "a", "Read more", "Main"),
        ("3", "a", "Home", "Navigation"),
        ("4", "a", "Free", "Page"),
        ("5", "input[email]", "Your email", "Login Form"),
        ("6", "input[text]", "code", "Login Form"),
        ("7", "button", "Subscribe", "Login Form"),
        ("8", "span", "Accept", "Page"),
    ]
    assert rows[1].href == "/more" and rows[0].href is None
    assert [r.id for r in acts.orderBy("grouped_pos").collect()] == ["1", "2", "3", "4", "8", "5", "6", "7"]


def test_roles_name_groups_on_raw_pages(spark):
    raw = actions.actions(spark.createDataFrame([(1, SHOP)], "page_id long, html string"), pruned=False)
    assert raw.filter("id = '8'").first().group == "Cookies"


def test_clean_pages(spark):
    html = actions.clean_pages(spark.createDataFrame([(1, SHOP), (2, "")], "page_id long, html string")).orderBy("page_id").collect()
    assert html[0].n_actions == 8 and html[1].clean_html == ""
    text = html[0].clean_html
    assert "script" not in text and "class" not in text and "onclick" not in text and 'data-sid="7"' in text and "\n\n" not in text


def test_renderings(acts):
    assert actions.to_terse(acts, most=2).first().terse == "@1 button Buy now [Main]\n@2 a Read more [Main]"
    xml = actions.to_xml(acts).first().xml
    assert xml.startswith('<page url="about:blank" title=""><group name="Main">') and xml.count("<action ") == 8


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("", "1 2 3 4 5 6 7 8"),
        ("type:button", "1 7"),
        ("type:input; group:Login Form", "5 6"),
        ('group:"login form" type:button', "7"),
        ("intent:buy", "1"),
        ("intent:nonsense", ""),
        ("id:1,3,99", "1 3"),
        ("href:/MORE", "2"),
        ("label~read", "2"),
        ("label~/^re/", "2"),
        ("label~/^RE/s", ""),
        ("placeholder~email && type:input", "5"),
        ("navig", "3"),
        ("subscribe", "7"),
        ("*", ""),
    ],
)
def test_grep(acts, query, ids):
    assert [r.id for r in grep.grep(acts, query).orderBy("pos").collect()] == ids.split()


def test_parse():
    kinds = lambda q: [(c.kind, c.value, c.flags) for c in grep.parse(q)]
    assert kinds("group:Login Form type:a") == [("group", "login form", None), ("type", "a", None)]
    assert kinds("label~/a b/im x") == [("label", "a b", "im"), ("text", "x", None)]
    assert kinds(" ; && ") == []


def test_search_results(spark):
    rows = [(1, k, str(k), label, href) for k, (label, href) in enumerate([("A long enough label", "https://a.example.com"), ("A long enough label", "https://a.example.com"), ("Short", "https://b.example.com"), ("Privacy policy and more", "https://c.example.com"), ("Another fine result", "/local"), ("One more fine result", "https://engine.example.com/x")])]
    acts = spark.createDataFrame(rows, "page_id long, pos int, id string, label string, href string")
    assert [r.href for r in grep.search_results(acts, excluded_hosts=("engine.example.com",)).collect()] == ["https://a.example.com"]
