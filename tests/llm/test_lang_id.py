import math
import random
import re
import time

from pagelens.llm import lang_id


def _labelled(spark):
    en = "the quick brown fox jumps over the lazy dog and then the dog was with the other animals of the house "
    de = "der schnelle braune fuchs springt über den faulen hund und dann war der hund mit den anderen tieren im haus "
    rows = [(f"{en[k:]}{en[:k]}" * 3, "en") for k in range(40)] + [(f"{de[k:]}{de[:k]}" * 3, "de") for k in range(40)] + [(None, "en"), ("text", None)]
    return spark.createDataFrame(rows, "text string, lang string")


def _page(text, lang=None):
    return f"<html{f' lang={chr(34)}{lang}{chr(34)}' if lang else ''}><head><script>the the the</script></head><body><!-- der die --><p>{text}</p></body></html>"


def test_text_markup_and_host_are_fused(spark):
    model = lang_id.fit_trigrams(_labelled(spark))
    en, de = "the dog was over there with the other dog and the house", "der hund war dann mit den anderen tieren im haus"
    rows = [(k, "https://a.example.de/x", _page(de, "de")) for k in range(30)] + [(100 + k, "https://b.example.com/x", _page(en, "en")) for k in range(30)]
    rows += [(200, "https://a.example.de/y", _page("", "de")), (201, "https://a.example.de/y", _page("")), (202, "https://b.example.com/y", None), (203, None, _page(en, "en")), (204, "https://b.example.com/z", _page(de, "en")), (None, None, None), (204, "https://b.example.com/z", _page(de, "en"))]
    out = {r.page_id: r for r in lang_id.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert len(out) == 30 + 30 + 6
    assert all(out[k].lang == "de" for k in range(30)) and all(out[100 + k].lang == "en" for k in range(30))
    assert out[200].lang == "de" and out[201].lang == "de" and out[202].lang == "en" and out[203].lang == "en"
    assert out[204].text_lang == "de" and out[204].declared == "en"
    assert out[None].lang in ("de", "en") and 0.0 < out[None].confidence <= 1.0


def test_documents_and_empty_cases(spark):
    model = lang_id.fit_trigrams(_labelled(spark))
    docs = spark.createDataFrame([(1, "the house of the dog", "en", "s"), (2, None, None, None), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    out = lang_id.identify_documents(docs, model).collect()
    assert len(out) == 3 and [r.lang for r in out if r.doc_id == 1] == ["en"]
    assert lang_id.identify_documents(docs.limit(0), model).count() == 0
    unfitted = lang_id.fit_trigrams(_labelled(spark).limit(0))
    assert {r.lang for r in lang_id.identify_documents(docs, unfitted).collect()} == {None}


def test_a_rare_language_is_in_the_model_of_a_large_table(spark):
    fi = "nopea ruskea kettu hyppää laiskan koiran yli ja sitten koira oli talossa muiden eläinten kanssa "
    many = spark.range(20_000).selectExpr("concat('the quick brown fox and the dog of the house number ', id) AS text", "'en' AS lang", "id AS doc_id")
    few = spark.createDataFrame([(fi, "fi", 50_000), (fi, "fi", 50_001), (None, "xx", 50_002)], "text string, lang string, doc_id long")
    model = lang_id.fit_trigrams(many.unionByName(few), sample_docs=100)
    assert model.langs == ["en", "fi", "xx"]
    docs = spark.createDataFrame([(1, "kettu ja koira olivat talossa", None, "s")], "doc_id long, text string, lang string, source string")
    assert [r.text_lang for r in lang_id.identify_documents(docs, model).collect()] == ["fi"]


def test_fusion_matches_plain_sums(spark):
    """Posterior of every row by counting over plain lists."""
    rng = random.Random(3)
    langs = ["de", "en", "fr"]
    rows = []
    for uid in range(200):
        domain = rng.choice(["a.de", "b.com", "c.fr"])
        host = rng.choice(["www.", "x.", ""]) + domain
        rows.append((uid, host, domain, domain.split(".")[1] if rng.random() < 0.8 else None, rng.choice(["de", "en", "xx", None]), [-rng.random() * 6 for _ in langs]))
    rows.append((200, "", "", None, None, [0.0, 0.0, 0.0]))
    soft = lambda x: [math.exp(v - max(x)) / sum(math.exp(w - max(x)) for w in x) for v in x]
    post = {r[0]: soft(r[5]) for r in rows}
    total = lambda keep: [sum(post[r[0]][k] for r in rows if keep(r)) for k in range(3)]
    corpus = total(lambda r: True)
    flat = [(c + 1) / (sum(corpus) + 3) for c in corpus]
    smooth = lambda c, p, w: [(a + w * b) / (sum(c) + w) for a, b in zip(c, p, strict=True)]
    want = {}
    for uid, host, domain, suffix, declared, ll in rows:
        from_domain = smooth(total(lambda r, d=domain: r[2] == d), flat, lang_id.DOMAIN_PRIOR)
        others = [max(0.0, h - p) for h, p in zip(total(lambda r, h=host: r[1] == h), post[uid], strict=True)]
        logits = [a + math.log(b + 1e-9) for a, b in zip(ll, smooth(others, from_domain, lang_id.HOST_PRIOR), strict=True)]
        for place, value in ((4, declared), (3, suffix)):
            if value is not None:
                every, own = total(lambda r, p=place: r[p] is not None), total(lambda r, p=place, v=value: r[p] == v)
                seen = sum(own) / sum(every)
                logits = [a + math.log((c + lang_id.LABEL_PRIOR * seen) / (e + lang_id.LABEL_PRIOR) + 1e-9) for a, c, e in zip(logits, own, every, strict=True)]
        fused = soft(logits)
        want[uid] = (langs[fused.index(max(fused))], max(fused))
    table = lang_id.materialize(spark.createDataFrame(rows, "uid long, host string, domain string, suffix string, declared string, ll array<double>").repartition(3))
    out = {r.uid: r for r in lang_id.fuse(table, langs).collect()}
    assert len(out) == len(rows)
    assert all(out[u].lang == lang and abs(out[u].confidence - c) < 1e-9 for u, (lang, c) in want.items())


def test_pages_with_unclosed_tags_take_linear_time():
    old = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.DOTALL | re.IGNORECASE)
    rng = random.Random(1)
    pieces = ["<script>", "</script >", "<STYLE x>", "</style>", "<!--", "-->", "<b>", "</b>", "text ", "<", ">", "a<b", "&amp;"]
    for _ in range(500):
        page = "".join(rng.choice(pieces) for _ in range(rng.randrange(20)))
        assert lang_id.visible_text(page).split() == lang_id._html.unescape(old.sub(" ", page)).split()
    began = time.monotonic()
    for piece in ("<script>", "<!-- ", "<", "<style><!--"):
        lang_id.visible_text(piece * 100_000)
    assert time.monotonic() - began < 20


def test_pages_with_nulls_long_texts_and_clashing_names(spark):
    model = lang_id.fit_trigrams(spark.createDataFrame([("plain words here", "en"), ("andere worte hier", "de")], "text string, lang string"))
    rows = [(1, "http://a.de/x", "<html lang=de>andere worte" + " hier" * 200_000, "h", 1), (1, None, None, None, None), (None, "", "", "h", 2), (3, "x", "<script>", "h", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, uid int")
    out = lang_id.identify_pages(pages, model).collect()
    assert sorted((r.page_id is None, r.page_id or 0) for r in out) == [(False, 1), (False, 1), (False, 3), (True, 0)]
    assert {r.lang for r in out if r.host == "a.de"} == {"de"} and lang_id.identify_pages(pages.limit(0), model).count() == 0
