import math
import random
import re
from collections import Counter

from pagelens.llm import decontaminate
from pagelens.llm.decontaminate import Index, split_item


def _corpus():
    rng = random.Random(9)
    common = [f"c{i}" for i in range(30)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(6))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(k, sentence(rng.randint(8, 30)) + " " + sentence(rng.randint(3, 9))) for k in range(60)]
    docs = []
    for k in range(150):
        text = " ".join(sentence(rng.randint(5, 20)) for _ in range(rng.randint(1, 30)))
        if k % 5 == 0:
            at = rng.randrange(len(text))
            text = f"{text[:at]} {items[k % 60][1].upper() if k % 10 == 0 else items[k % 60][1]} {text[at:]}"
        docs.append((k, text))
    return items, docs


def test_search_returns_all_items_above_the_threshold():
    items, docs = _corpus()
    index = Index([(i, *split_item(t)) for i, t in items])
    for _, text in docs[:60]:
        terms = sorted({index.vocabulary[w] for w in decontaminate.words_of(text)} - {-1})[:80]
        scores = {}
        for t in terms:
            for item, weight in zip(index.items[t], index.weights[t], strict=True):
                scores[int(item)] = scores.get(int(item), 0.0) + float(weight)
        for least in (0.1, 0.3, 0.6):
            assert {i for i, _ in index.search(terms, least)} == {i for i, s in scores.items() if s >= least - 1e-6}


def test_every_planted_item_is_found_and_nothing_else(spark):
    items, docs = _corpus()
    docs += [(None, None), (900, ""), (901, items[3][1]), (901, items[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    i = spark.createDataFrame([*items, (None, "x y z"), (99, None), (98, "...")], "item_id long, text string")
    out = decontaminate.contaminated(d, i).collect()
    want = sorted([(k, k % 60) for k in range(0, 150, 5)] + [(901, 3), (901, 3)])
    assert sorted((r.doc_id, r.item_id) for r in out) == want
    kept = decontaminate.drop_contaminated(d, i)
    assert kept.columns == d.columns and kept.count() == len(docs) - len(want)


def test_half_an_item_is_no_leak(spark):
    items, _ = _corpus()
    words = items[0][1].split()
    d = spark.createDataFrame([(1, " ".join(words[: len(words) // 2])), (2, " ".join(reversed(words)))], "doc_id long, text string")
    assert decontaminate.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_empty_tables(spark):
    items, docs = _corpus()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contaminated(d.limit(0), i).count() == 0
    assert decontaminate.contaminated(d, i.limit(0)).count() == 0


def _brute(docs, items):
    """(doc, item) pairs by scoring every window of every text against every item, with weights counted anew."""
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    cut = {k: [w for w in map(words, re.split(r"(?<=[.!?])\s+|\n+", t)) if w] for k, t in items}
    bags = {k: Counter(w for p in parts for w in p) for k, parts in cut.items()}
    n, sizes = len(bags), {k: sum(b.values()) for k, b in bags.items()}
    mean, half = sum(sizes.values()) / n, max(32, *sizes.values())
    df = Counter(w for b in bags.values() for w in b)
    weight = {k: {w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * sizes[k] / mean)) for w, c in b.items()} for k, b in bags.items()}
    runs = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    found = set()
    for d, text in docs:
        own = words(text)
        for at in range(0, max(1, len(own)), half):
            here = own[at : at + 2 * half]
            for k, ws in weight.items():
                if sum(v for w, v in ws.items() if w in set(here)) >= 0.6 * sum(ws.values()) - 1e-9:
                    question, answer = ([w for p in cut[k][:-1] for w in p], cut[k][-1]) if len(cut[k]) > 1 else (cut[k][0], [])
                    if all(len(p) < 3 and set(p) <= set(here) or len(p) >= 3 and len(runs(p) & runs(here)) >= 0.6 * len(runs(p)) for p in (question, answer)):
                        found.add((d, k))
    return found


def test_hits_match_brute_force_however_many_indexes_there_are(spark, monkeypatch):
    items, docs = _corpus()
    rng = random.Random(2)
    for k in range(0, 60, 3):  # partial and shuffled copies, near the thresholds
        words = items[k][1].split()
        docs.append((300 + k, " ".join(w if rng.random() < 0.8 else "zz" for w in words)))
        docs.append((400 + k, " ".join(rng.sample(words, len(words)))))
    items.append((None, items[1][1]))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    results = []
    for chars in (8_000_000, 1000):
        monkeypatch.setattr(decontaminate, "SEGMENT_CHARS", chars)
        results.append(sorted(map(tuple, decontaminate.contaminated(d, i).collect()), key=repr))
        kept = {r.doc_id for r in decontaminate.drop_contaminated(d, i).collect()}
        assert kept == {k for k, _ in docs} - {r[0] for r in results[-1]}
    assert results[0] == results[1]
    got = {(r[0], r[1]) for r in results[0]}
    assert {(a, b) for a, b in got if b is not None} == _brute(docs, items[:-1])
    assert {a for a, b in got if b is None} == {a for a, b in got if b == 1}


def test_bounds_are_the_same_in_slabs(monkeypatch):
    items, docs = _corpus()
    index = Index([(i, *split_item(t)) for i, t in items])
    long = " ".join(t for _, t in docs)
    want = [index.hits(t) for t in (long, "", "nothing here", docs[0][1])]
    monkeypatch.setattr(decontaminate, "SLAB", 50)
    assert [index.hits(t) for t in (long, "", "nothing here", docs[0][1])] == want and want[0]
