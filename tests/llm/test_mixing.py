import random
import re

import numpy as np

from pagelens.llm import mixing


def targets(sizes):
    """Water filling by plain resharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, list(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] >= 2 * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def _rows():
    rng = random.Random(4)
    rows = []
    for k in range(3000):
        source = rng.choice(["b", "b", "b", "b", "a", "é", "c", None])
        rows.append((k, " ".join(["w"] * int(rng.lognormvariate(4, 1))), source))
    return rows + [(None, None, "a"), (7, "", "c"), (7, "", "c"), (8, "x\x1cy z", "tiny")]


def test_targets_and_takings(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = targets(sizes)
    by_target = {}
    for r in out:
        assert r.taken <= 2 * r.size and r.taken == r.size * r.copies
        by_target.setdefault((r.source_size, round(r.target, 6)), []).append((r.taken, r.copies))
    assert len(out) == len(rows) and set(by_target) == {(sizes[s], round(want[s], 6)) for s in sizes}
    for (size, target), taken in by_target.items():
        assert abs(sum(t for t, _ in taken) - target) <= max(2, 0.002 * target)
        assert abs(sum(c for _, c in taken) - len(taken) * target / max(1, size)) <= max(2, 0.002 * len(taken))  # documents too
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, out), key=repr) == sorted(map(key, again), key=repr)


def test_all_documents_are_written_twice_only(spark, monkeypatch):
    """The rows, and what the first flight makes of them: executors start processes for every file that they write."""
    rows, written, keep = _rows(), [], mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, *a: written.append(keep(df, *a)) or written[-1])
    assert mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).count() == len(rows)
    assert sum(t.count() == len(rows) for t in written) == 2


def test_rows_of_many_splits_are_written_to_few_files(spark, monkeypatch, tmp_path):
    """A process is started for every file, and counts as a second executor until it has its own memory."""
    docs = spark.createDataFrame(_rows(), "doc_id long, text string, source string")
    docs.repartition(64).write.parquet(str(tmp_path / "docs"))
    written, keep = [], mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, *a: written.append(keep(df, *a)) or written[-1])
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        read = spark.read.parquet(str(tmp_path / "docs"))
        assert read.rdd.getNumPartitions() == 64
        assert mixing.mix(read).count() == docs.count()
        assert len(written[0].inputFiles()) == 8
        assert mixing.mix(read.repartition(3)).count() == docs.count()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_word_count_is_that_of_the_pattern_and_makes_no_list_of_words(spark):
    space = " \t\n\x0b\x0c\r"
    rng = random.Random(9)
    texts = ["".join(rng.choice(space + "a$é\\\x1c\x85\xa0\u2003😀") for _ in range(k % 40)) for k in range(400)]
    texts += [None, "", space, space + "a", "a" + space, "w", " w", "w ", " " * 300_000, "a" + " " * 300_000 + "b", "a" * 300_000, "\n" * 300_000 + "a"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", mixing.word_count(mixing.F.col("text")).alias("n"))
    assert {r.k: r.n for r in docs.collect()} == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(texts)}
    assert "regexp_extract_all" not in docs._jdf.queryExecution().optimizedPlan().toString()


def test_the_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    size, p, seed = rng.integers(1, 900, 500), rng.random(500), rng.integers(0, 2**60, 500).astype(np.uint64)
    q = mixing.flight(p, size, seed)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3


def test_the_flight_is_fair():
    size = np.array([5, 9, 2, 7, 7, 1])
    p = np.array([0.3, 0.6, 0.2, 0.8, 0.5, 0.4])
    runs = [mixing.flight(p, size, np.arange(6, dtype=np.uint64) + np.uint64(1000 * k)) for k in range(4000)]
    assert np.abs(np.mean(runs, axis=0) - p).max() < 0.04


def test_the_landing_leaves_decided_ones_and_is_near_in_both_totals():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 30, 400):
        size, p, seed = rng.integers(1, 900, n), rng.random(n), rng.integers(0, 2**60, n).astype(np.uint64)
        flown = mixing.flight(p, size, seed, last=True)
        landed = mixing.landing(flown, size)
        decided = (flown == 0) | (flown == 1)
        assert set(landed) <= {0.0, 1.0} and (landed[decided] == flown[decided]).all() and (~decided).sum() <= 2
        if n >= 30:
            assert abs((landed * size).sum() - (p * size).sum()) <= np.sort(size)[:3].sum() and abs(landed.sum() - p.sum()) <= 2


def test_one_long_document_among_equal_ones_is_moved_with_the_words_kept():
    size, p = np.array([1000, *[10] * 300]), np.full(301, 0.5)
    done = mixing.landing(mixing.flight(p, size, np.arange(301, dtype=np.uint64), last=True), size)
    assert abs((done * size).sum() - 2000) <= 10


def test_apply_mix_repeats_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 5), (2, "d", "x", 6), (3, "", "y", 7)], "doc_id long, text string, source string, seed int")
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    taken = mixing.mix(docs).collect()
    want = sorted(r.doc_id for r in taken for _ in range(r.copies))
    assert sorted(r.doc_id for r in out.collect()) == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0 and mixing.apply_mix(docs).count() == 0
