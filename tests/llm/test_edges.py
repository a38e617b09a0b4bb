"""Every operator on an empty table, and on rows with NULLs, empty and long texts, repeats, and columns with clashing names."""

import pytest

from pagelens.llm import decontaminate, lang_id, mixing, near_dups, quality, secrets, sharding, spans, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, __uid2 int, size int, score string, k int, node int, seed int, h int, e int, label string, centre string, precision string, gk string, lk int, __gk int, __uid int, __row string, __text string, __hits int, __m int, __id string, `a.b` int"
LONG = "a very long text, word by word. " * 30_000


def _rows():
    rest = ("u", 1, 2, "s", 3, 4, 5, 6, 7, "l", "c", "p", "g", 8, 9, 10, "r", "t", 11, 12, "i", 13)
    return [
        (None, None, None, None, None, *rest),
        (1, "", "en", "a", 0, *rest),
        (1, "", "en", "a", 0, *rest),
        (2, LONG, "en", "b", len(LONG), *rest),
        (3, " \n\t ", None, "b", 4, *rest),
        (4, "plain words that say little. they say it twice.", "en", None, 40, *[None] * 22),
        (4, "other words, of the same id!", "de", "a", 30, *rest),
        (5, "😀 é\x00 \u2028 \x85 done", "xx", "ö", 9, *rest),
    ]


def _model(spark):
    return toxicity.fit(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))


def _lang(spark):
    return lang_id.fit_trigrams(spark.createDataFrame([("plain words", "en"), ("andere worte", "de")], "text string, lang string"))


def _items(spark):
    return spark.createDataFrame([(1, "plain words that say little. they say it twice."), (2, None)], "item_id long, text string")


PER_ROW = {
    "secrets": lambda s, d: secrets.find_secrets(d),
    "mixing": lambda s, d: mixing.mix(d),
    "sharding": lambda s, d: sharding.shard_rows(d),
    "lang_id": lambda s, d: lang_id.identify_documents(d, _lang(s)),
    "near_dups": lambda s, d: near_dups.near_duplicates(d),
    "quality": lambda s, d: quality.quality_rows(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, _model(s)),
}
FILTERS = {
    "quality": lambda s, d: quality.filter_quality(d),
    "near_dups": lambda s, d: near_dups.drop_near_duplicates(d),
    "decontaminate": lambda s, d: decontaminate.drop_contaminated(d, _items(s)),
    "mixing": lambda s, d: mixing.apply_mix(d),
    "spans": lambda s, d: spans.remove_repeated(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(spark, name):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    out = PER_ROW[name](spark, docs).collect()
    assert sorted((r.doc_id for r in out), key=repr) == sorted((r[0] for r in _rows()), key=repr)
    assert PER_ROW[name](spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_the_columns(spark, name):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    out = FILTERS[name](spark, docs)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in _rows()}
    assert FILTERS[name](spark, docs.limit(0)).count() == 0


def test_reports_without_a_row_for_each_document(spark):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    found = decontaminate.contaminated(docs, _items(spark)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(4, 1)}
    gone = spans.repeated_spans(docs).collect()
    assert {r.doc_id for r in gone} <= {2} and all(r.first_doc_id == 2 for r in gone)
    for report in (decontaminate.contaminated(docs.limit(0), _items(spark)), decontaminate.contaminated(docs, _items(spark).limit(0)), spans.repeated_spans(docs.limit(0))):
        assert report.count() == 0


def test_one_group_that_is_most_of_the_table(spark):
    """Copies of one row, and of one text under many ids, beside a few others."""
    rest = _rows()[0][5:]
    text = "one sentence that is said again and again. " * 12
    rows = [(7, text, "en", "a", 1, *rest)] * 300 + [(1000 + k, text, "en", "a", 1, *rest) for k in range(300)] + [(5, "other words of some length, said once. they go on here.", "en", "a", 1, *rest)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert {r.class_size for r in near_dups.near_duplicates(docs).collect()} == {600, 1}
    assert sorted(r.doc_id for r in near_dups.drop_near_duplicates(docs).collect()) == [5, 7]
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == 601 and all(r.taken <= 2 * r.size for r in mixed)
    assert len(quality.quality_rows(docs).collect()) == 601
    assert {r.doc_id for r in spans.repeated_spans(docs).collect()} >= {1000, 1299}
