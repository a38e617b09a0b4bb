import random
import zlib

import numpy as np

from pagelens.llm import toxicity

WORDS = [f"word{i}" for i in range(200)]


def _tables(spark, n=1200):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.3
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vilex", "vileness", "scumbag"]))
        if rng.random() < (0.5 if toxic else 0.05):  # the bias that the penalty has to undo
            words.append(rng.choice(["muslim", "gay", "women"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy_and_neutral_mentions(spark):
    docs, labels, truth = _tables(spark)
    model = toxicity.fit(docs, labels)
    out = toxicity.score_toxicity(docs, model).collect()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in out if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    plain = model.score("word1 word2 word3 word4 word5 word6")
    assert all(abs(model.score(f"word1 word2 word3 word4 word5 {term}") - plain) < 0.1 for term in ("muslim", "gay", "women"))


def test_the_penalty_lowers_the_change(spark):
    docs, labels, _ = _tables(spark)
    before = toxicity.PENALTY
    change = {}
    try:
        for weight in (0.0, before):
            toxicity.PENALTY = weight
            m = toxicity.fit(docs, labels)
            z = lambda t: np.log(m.score(t) / (1 - m.score(t)))
            change[weight] = abs(z("word1 word2 word3 gay") - z("word1 word2 word3 word4"))
    finally:
        toxicity.PENALTY = before
    assert change[before] < 0.5 * change[0.0]


def test_held_out_labels_do_not_matter(spark):
    docs, labels, truth = _tables(spark, 400)
    flipped = spark.createDataFrame([(k, 1 - v if zlib.crc32(str(k).encode()) % 5 == 0 else v) for k, v in truth.items()], "doc_id long, toxic int")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert all(abs(a.score(t) - b.score(t)) < 1e-12 for t in ("", None, "vilex word3", "word1 word2"))


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, toxicity.fit(docs, none)).collect()
    assert {r.score for r in out} == {0.5} and not any(r.held_out for r in out if r.doc_id is None)


def test_sentences_that_name_a_group_get_the_counterfactuals(spark):
    """Few texts name a group, none of them early by hash order; swaps come from all of them, in every language."""
    assert toxicity.counterfactuals({"gay", "x"}, 0)[0] == ({"gay", "x"}, {"straight", "x"})
    assert ({"die", "frauen"}, {"die", "männer"}) in toxicity.counterfactuals({"die", "frauen"}, 3)
    added = toxicity.counterfactuals({"x"}, 5)
    assert len(added) == len(toxicity.IDENTITY) and all(len(b - a) == 1 for a, b in added)
    docs, labels, truth = _tables(spark)
    rows = [(2000 + k, f"word{k} word2. The gay word{k + 1} stays") for k in range(40)] + [(2000, "a text of the same id")] * 3
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = labels.unionByName(spark.createDataFrame([(2000 + k, 0) for k in range(40)], "doc_id long, toxic int"))
    seen = []
    real = toxicity.counterfactuals
    try:
        toxicity.counterfactuals = lambda words, turn: seen.append(words) or real(words, turn)
        toxicity.fit(docs, labels)
    finally:
        toxicity.counterfactuals = real
    taught = sum(zlib.crc32(str(2000 + k).encode()) % 5 != 0 for k in range(1, 40))
    assert sum({"gay", "stays"} <= words for words in seen) >= taught and len(seen) <= 2 * toxicity.SENTENCES
