import random
import re
from collections import defaultdict

import pytest

from pagelens.llm import near_dups


def _texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, k = [], 0

    def add(words):
        nonlocal k
        rows.append((k, " ".join(words)))
        k += 1

    passage = [word() for _ in range(60)]
    for _ in range(30):  # unlike texts that share a passage
        add([word() for _ in range(50)] + passage)
    for n in (12, 40, 46, 150, 600):  # near copies, some of them only through others
        base = [word() for _ in range(n)]
        for _ in range(12):
            near = list(base)
            for _ in range(rng.randrange(0, max(2, n // 30))):
                near[rng.randrange(n)] = word()
            add(near)
            base = near if rng.random() < 0.3 else base
    add(passage[::-1])
    add(passage)
    rows += [(k + 1, passage and " ".join(passage)), (k + 2, None), (k + 3, ""), (k + 4, "one two"), (k + 5, "One, two!")]
    return rows


def _similar(a, b):
    """Words under the best rising chain of equal five-word runs, by a plain table; the k-th equal run of one text only meets the k-th of the other."""

    def runs(w):
        seen = defaultdict(int)
        out = []
        for i in range(len(w) - 4):
            run = tuple(w[i : i + 5])
            out.append((run, seen[run]))
            seen[run] += 1
        return out

    at = {run: j for j, run in enumerate(runs(b))}
    pairs = [(i, at[run]) for i, run in enumerate(runs(a)) if run in at]
    best = []  # (length, words under it in a, in b) of the best chain that ends in each pair
    for q, (i, j) in enumerate(pairs):
        options = [(1, 5, 5)]
        for (n, x, y), (i2, j2) in zip(best, pairs[:q], strict=True):
            if j2 < j:
                options.append((n + 1, x + min(5, i - i2), y + min(5, j - j2)))
        best.append(max(options))
    covered = max((min(x, y) for _, x, y in best), default=0)
    return covered / (len(a) + len(b) - covered)


def brute(rows):
    """Classes by comparing every two texts, with words and similarity written anew."""
    words = [(d, "".join(c if c.isalnum() or c == "_" else " " for c in (t or "").lower()).split()) for d, t in rows]
    parent = {d: d for d, _ in words}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(words):
        for e, b in words[:i]:
            if a == b or min(len(a), len(b)) >= max(5, 0.8 * max(len(a), len(b))) and len({*a} & {*b}) > 0 and _similar(a, b) >= 0.8:
                x, y = sorted((root(d), root(e)))
                parent[y] = x
    return {d: root(d) for d, _ in words}


def test_classes_match_brute_force(spark):
    rows = _texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = near_dups.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in out} == brute(rows)
    groups = defaultdict(list)
    for r in out:
        groups[r.class_id].append(r)
    assert all(sum(r.keeper for r in g) == 1 and all(r.class_size == len(g) for r in g) for g in groups.values())
    assert all(r.keeper == (r.doc_id == r.class_id) for r in out)


def test_a_crowded_bucket_costs_no_link_of_a_small_one(spark):
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    near = text(100)
    other = [*near[:50], "changed", *near[51:]]
    sigs = {1: ([7, 8], near), 2: ([7], other), 0: ([7], text(100))}  # the hub of bucket 7 is like neither
    sigs |= {10 + i: ([8], text(100)) for i in range(20)}  # bucket 8 is crowded with unlike texts
    rows = [(node, len(words), sig, bytearray(near_dups.word_ids(" ".join(words)).tobytes())) for node, (sig, words) in sigs.items()]
    nodes = near_dups.materialize(spark.createDataFrame(rows, "node long, n int, sig array<long>, seq binary"))
    assert [(r.a, r.b) for r in near_dups.links(nodes).collect()] == [(1, 2)]


@pytest.mark.parametrize("shared", [500_000, 0])
def test_all_links_of_crowded_buckets_are_found(spark, monkeypatch, shared):
    """Unlike texts around one long passage, most pairs of which are near the threshold, against all pairs."""
    monkeypatch.setattr(near_dups, "SHARED", shared)
    monkeypatch.setattr(near_dups, "LARGE", 8)
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = text(70)
    texts = [[*passage, *text(rng.randrange(2, 40))] for _ in range(40)]
    texts += [[*t[:75], "other", *t[76:]] for t in texts[:15]]
    rows = [(node, len(words), [5], bytearray(near_dups.word_ids(" ".join(words)).tobytes())) for node, words in enumerate(texts)]
    nodes = near_dups.materialize(spark.createDataFrame(rows, "node long, n int, sig array<long>, seq binary"))
    found = near_dups.connected_components(near_dups.links(nodes).select("a", "b"))
    got = {r.node: r.comp for r in found.collect()}
    want = brute([(i, " ".join(t)) for i, t in enumerate(texts)])
    assert {i: got.get(i, i) for i in range(len(texts))} == want


def test_texts_beside_a_large_class_are_not_compared_to_all_of_it(spark, monkeypatch):
    """Copies too far from a large class to link, some of which link each other, against all pairs."""
    monkeypatch.setattr(near_dups, "LARGE", 8)
    rng = random.Random(6)
    changed = lambda words, places: [f"w{rng.randrange(10**9)}" if i in places else w for i, w in enumerate(words)]
    base = changed([""] * 120, range(120))
    texts = [changed(base, [rng.randrange(120)]) for _ in range(80)]
    texts += [changed(base, range(k % 7, 120, 7)) for k in range(15)]
    texts += [changed(t, [60 + k]) for k, t in enumerate(texts[80:86])]
    rows = [(node, len(words), [5], bytearray(near_dups.word_ids(" ".join(words)).tobytes())) for node, words in enumerate(texts)]
    nodes = near_dups.materialize(spark.createDataFrame(rows, "node long, n int, sig array<long>, seq binary"))
    made, verified = [], near_dups._verified
    monkeypatch.setattr(near_dups, "_verified", lambda pairs, nodes: made.append(pairs.count()) or verified(pairs, nodes))
    got = {r.node: r.comp for r in near_dups.connected_components(near_dups.links(nodes).select("a", "b")).collect()}
    want = brute([(i, " ".join(t)) for i, t in enumerate(texts)])
    assert {i: got.get(i, i) for i in range(len(texts))} == want and 15 <= len(set(want.values())) <= 17
    assert sum(made) < 400


def test_the_filter_keeps_one_of_each_class(spark):
    rows = [(None, "same words here", "a"), (None, "same words here", "a"), (4, "same words here", "b"), (5, "other", "c"), (5, "other", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string")
    out = near_dups.drop_near_duplicates(docs)
    assert out.schema == docs.schema
    assert sorted((r.doc_id, r.th) for r in out.collect()) == [(4, "b"), (5, "c")]


def test_recall_of_planted_near_copies(spark):
    """Copies with 1 to 6 % of their words changed are found, be they in short or long texts."""
    rng = random.Random(3)
    docs, kin = [], {}
    for base in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((60, 150, 400)))]
        docs.append((base, " ".join(words)))
        for c in range(2):
            near = [f"x{rng.randrange(3000)}" if rng.random() < rng.uniform(0.01, 0.06) else w for w in words]
            docs.append((1000 + 10 * base + c, " ".join(near)))
            kin[1000 + 10 * base + c] = base
    out = {r.doc_id: r.class_id for r in near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(out[d] == b for d, b in kin.items()) >= 0.95 * len(kin)
    assert len({out[b] for b in range(60)}) == 60


def test_alignment_counts_order():
    a = near_dups.word_ids(" ".join(f"w{i}" for i in range(100)))
    b = near_dups.word_ids(" ".join([f"w{i}" for i in range(50, 100)] + [f"w{i}" for i in range(50)]))
    assert near_dups.alignment(a, a) == 1.0
    assert near_dups.alignment(a, b) < 0.8
    one = a.copy()
    one[40] = 7
    assert near_dups.alignment(a, one) == 99 / 101


def _join_rows(spark, condition, since):
    """Rows that the joins on such a condition have made in the executions after `since`, by Spark's own counts, and the last execution."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    ids = [runs.apply(i).executionId() for i in range(runs.size())]
    for run in (i for i in ids if i > since):
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (x for x in map(nodes.apply, range(nodes.size())) if re.search(condition, x.desc())):
            kinds = {m.name(): m.accumulatorId() for m in map(node.metrics().apply, range(node.metrics().size()))}
            value = values.get(kinds.get("number of output rows", -1))
            made += int(value.get().replace(",", "")) if value.isDefined() else 0
    return made, max(ids, default=-1)


def test_members_meet_their_shareable_words_once(spark, monkeypatch):
    """A member of a crowded bucket makes one row for that bucket, in a group of any size, where the words that it may share are joined to it."""
    monkeypatch.setattr(near_dups, "LARGE", 8)
    given, still_mixed, rows_made = [], near_dups._still_mixed, []
    monkeypatch.setattr(near_dups, "_still_mixed", lambda members: given.append(still_mixed(members)) or given[-1])
    for group in (40, 80):
        rng = random.Random(6)
        changed = lambda words, places: [f"w{rng.randrange(10**9)}" if i in places else w for i, w in enumerate(words)]  # noqa: E731, B023
        base = changed([""] * 120, range(120))
        texts = [changed(base, [rng.randrange(120)]) for _ in range(group)]
        texts += [changed(base, range(k % 7, 120, 7)) for k in range(group // 4)]
        texts += [changed(t, [60 + k]) for k, t in enumerate(texts[group : group + 6])]
        rows = [(node, len(words), [5], bytearray(near_dups.word_ids(" ".join(words)).tobytes())) for node, words in enumerate(texts)]
        nodes = near_dups.materialize(spark.createDataFrame(rows, "node long, n int, sig array<long>, seq binary"))
        _, since = _join_rows(spark, "^$", -1)
        given.clear()
        near_dups.links(nodes).count()
        made, _ = _join_rows(spark, r"Join \[node.*least\(r#\d+, r#\d+\).*least#", since)
        assert 0 < made <= given[0].count() + given[-2].count()
        rows_made.append(made)
    assert rows_made[1] <= 2.2 * rows_made[0]


def test_near_copies_of_a_text_in_no_bucket_of_theirs_meet_it_and_not_each_other(spark, monkeypatch):
    """Texts near one text but far from each other, which share a bucket without it; against all pairs, for two sizes of the group."""
    monkeypatch.setattr(near_dups, "LARGE", 8)
    made, verified = [], near_dups._verified
    monkeypatch.setattr(near_dups, "_verified", lambda pairs, nodes: made.append(pairs.count()) or verified(pairs, nodes))
    totals = []
    for group in (20, 40):
        rng = random.Random(8)
        changed = lambda words, places: [f"w{rng.randrange(10**9)}" if i in places else w for i, w in enumerate(words)]  # noqa: E731, B023
        base = changed([""] * 150, range(150))
        near = lambda: changed(base, rng.sample(range(5, 145), 7))  # noqa: E731, B023
        texts = [base, *[near() for _ in range(2 * group)], changed(base, range(0, 150, 6))]
        kept = [[k for k in range(10, 18) if (k - i) % 8 > 1] + [6] * (i % 4 == 0) for i in range(group)]  # a near copy has most buckets of its text
        buckets = [range(10, 18), *kept, *[[6]] * group, [6]]
        rows = [(node, len(words), [*sig], bytearray(near_dups.word_ids(" ".join(words)).tobytes())) for node, (words, sig) in enumerate(zip(texts, buckets, strict=True))]
        nodes = near_dups.materialize(spark.createDataFrame(rows, "node long, n int, sig array<long>, seq binary"))
        made.clear()
        got = {r.node: r.comp for r in near_dups.connected_components(near_dups.links(nodes).select("a", "b")).collect()}
        want = brute([(i, " ".join(t)) for i, t in enumerate(texts)])
        assert {i: got.get(i, i) for i in range(len(texts))} == want and set(want.values()) == {0, 2 * group + 1}
        totals.append(sum(made))
    assert totals[1] <= 2.5 * totals[0]
