import random
from collections import defaultdict

import pyarrow as pa

from pagelens.llm import spans


def cut(text):
    """(start, end) of the sentences, by a plain scan."""
    ends, i = [], 0
    while i < len(text):
        j = i
        if text[i] in ".!?":
            while j < len(text) and text[j] in ".!?":
                j += 1
            k = j
            while k < len(text) and text[k].isspace():
                k += 1
            if k > j:
                ends.append(k)
            i = k
        elif text[i].isspace():
            while j < len(text) and text[j].isspace():
                j += 1
            if "\n" in text[i:j]:
                ends.append(j)
            i = j
        else:
            i += 1
    out = []
    for s, e in zip([0, *ends], [*ends, len(text)], strict=True):
        while s < e and text[s].isspace():
            s += 1
        while s < e and text[e - 1].isspace():
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def brute(rows):
    """Removed sentences by plain comparison of the words of all spans."""
    own, seen = {}, defaultdict(set)
    for order, (doc, text) in enumerate(rows):
        found = cut(text)
        words = [text[s:e].lower().split() for s, e in found]
        edge = [sum(map(len, words[:k])) for k in range(len(words) + 1)]
        flat = [x for w in words for x in w]
        own[order] = (found, edge)
        for s, t in zip(edge, edge[1:], strict=False):
            size = t - s if t - s >= 50 else max(20, t - s + 1)
            for p, q in ((s, s + size), (t - size, t)):
                if 0 <= p and q <= len(flat):
                    seen[tuple(flat[p:q])].add((doc is None, doc or 0, order, p, q))
    gone = defaultdict(set)
    for places in seen.values():
        for _, _, order, p, q in sorted(places)[1:]:
            edge = own[order][1]
            gone[order] |= {k for k in range(len(edge) - 1) if p <= edge[k] and edge[k + 1] <= q}
    return sorted(((rows[order][0], own[order][0][i]) for order, places in gone.items() for i in places), key=repr)


def _rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice(".!?")
    shared = [" ".join(sentence(rng.randint(4, 14)) for _ in range(6)) for _ in range(4)] + [sentence(60)]
    rows = []
    for k in range(60):
        own = [sentence(rng.randint(1, 12)) for _ in range(rng.randint(1, 12))]
        if k % 3 == 0:
            own.insert(rng.randrange(len(own) + 1), rng.choice(shared))
        rows.append((k, rng.choice([" ", "\n", " \n"]).join(own)))
    rows += [(100, shared[0] + "\n" + shared[0]), (101, "Short. Line."), (102, "Short. Line."), (103, ""), (104, None), (None, shared[1]), (105, rows[0][1])]
    return rows


def test_removed_sentences_match_brute_force(spark):
    rows = _rows()
    texts = dict(rows)
    out = spans.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    got = []
    for r in out:
        text = texts[r.doc_id]
        got += [(r.doc_id, (s, e)) for s, e in spans.sentences(text) if r.start <= s and e <= r.end]
        assert r.n_words == len(text[r.start : r.end].split())
    assert sorted(got, key=repr) == brute([(d, t or "") for d, t in rows])


def test_clean_documents_stay_whole_and_repeats_are_cut(spark):
    rows = _rows()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int")
    out = spans.remove_repeated(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[101] == texts[102] == "Short. Line." and texts[104] is None and texts[103] == ""
    assert texts[105] == "" and texts[0] == dict(rows)[0]
    assert len(texts[100]) < len(dict(rows)[100])


def test_passages_whose_edges_are_not_sentence_ends_are_found(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    one, two, tail = text(28), text(9), text(30)
    passages = [f"{text(12)}. {one}. {text(14)}", f"{text(20)}. {two}. {text(8)}.\n{tail}", f"{text(10)}. {text(20)}. {text(10)}", f"{text(15)}. {text(55)}. {text(5)}"]
    rows = [(10 * d + k, f"{text(30)} {p} {text(30)}.") for k, p in enumerate(passages) for d in (0, 1)]
    out = spans.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = {r.doc_id: dict(rows)[r.doc_id][r.start : r.end] for r in out}
    # Nothing goes from any first copy, and no sentence that is partly outside of the passage.
    assert gone == {10: one + ".", 11: two + ". " + " ".join(passages[1].split(". ")[2].split()[:8]), 12: passages[2].split(". ")[1] + ".", 13: passages[3].split(". ")[1] + "."}
    assert all(r.first_doc_id == r.doc_id - 10 for r in out)


def test_every_whole_sentence_of_a_repeated_passage_goes(spark):
    """Passages of 50 words or more, wherever they begin and end; a sentence at an edge may be whole in one copy only, and stays."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    stream = lambda n: [word() + ("." if rng.random() < 0.07 else "") for _ in range(n)]
    rows, inside = [], {}
    for k in range(60):
        passage = stream(rng.randrange(50, 90))
        rows.append((k, " ".join([*stream(40), *passage, *stream(40)])))
        before, after = stream(rng.randrange(0, 60)), stream(rng.randrange(0, 60))
        rows.append((100 + k, " ".join([*before, *passage, *after])))
        inside[100 + k] = (len(" ".join([*before, ""])) if before else 0, len(" ".join([*before, *passage])))
    out = spans.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    left = []
    for d, (low, high) in inside.items():
        gone = [(r.start, r.end) for r in out if r.doc_id == d]
        both = {texts[d - 100][s:e] for s, e in cut(texts[d - 100])}
        left += [(d, s, e) for s, e in cut(texts[d]) if texts[d][s:e] in both and low <= s and e <= high and not any(a <= s and e <= b for a, b in gone)]
    assert not left and all(r.doc_id >= 100 for r in out)


def test_workers_hold_few_words_and_few_documents():
    known = spans._Words()
    assert [known[f"w{k}"] for k in range(60_000)][-1] == known["w59999"] and len(known) <= spans.KEPT_WORDS
    row = {"uid": 1, "doc_id": 1, "start": [0], "end": [9], "words": [30], "hits": [{"i": 0, "e": 30, "first": 0}]}
    merged = list(spans._merge(iter([pa.RecordBatch.from_pylist([row] * 1000)])))
    assert sum(b.num_rows for b in merged) == 1000 and max(b.num_rows for b in merged) <= spans.MERGED
