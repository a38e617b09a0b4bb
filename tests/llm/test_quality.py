import math
import random
import re

import numpy as np

from pagelens.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_counts_match_brute_force():
    rng = random.Random(3)
    texts = ["", " \x1c a b \x85", "a b\nc\na b\n\n \t\n", "x " * 30, "#|<> $%&* é"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))).replace("c a", "c\na") for _ in range(200)]
    for text in texts:
        assert quality.text_stats(text)[:5] == brute(text)


def test_chi_square():
    assert abs(quality.chi2_quantile(0.05, 6) - 12.592) < 0.01
    assert abs(quality.chi2_cdf(7.841, 6) - 0.75) < 0.001


def _docs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    clean = lambda n: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(n)) + "."
    rows = [(k, clean(rng.randint(4, 60)), "en", f"s{k % 2}", 7, "x") for k in range(240)]
    rows += [(1000 + k, clean(10).replace(" ", "$$$ |"), "en", "s0", 7, "x") for k in range(6)]
    rows += [(1100 + k, clean(20).upper(), "en", "s1", 7, "x") for k in range(6)]
    rows += [(None, None, None, None, None, None), (5000, "", "en", "s1", 7, "x"), (5001, "word " * 10_000, "en", "s0", 7, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept long, gk string")


def test_junk_goes_and_clean_text_stays(spark):
    out = {r.doc_id: r for r in quality.quality_rows(_docs(spark)).collect()}
    assert len(out) == 240 + 12 + 3
    assert sum(out[k].kept for k in range(240)) >= 238
    assert not any(out[k].kept for k in out if k is None or k >= 1000)
    assert out[5001].base_failed and out[5000].base_failed and out[None].base_failed


def test_the_filter_keeps_columns_whatever_their_names(spark):
    docs = _docs(spark)
    kept = quality.filter_quality(docs)
    assert kept.schema == docs.schema
    want = {r.doc_id for r in quality.quality_rows(docs).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want


def test_a_group_without_near_rows_is_judged_by_its_language(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    clean = lambda n: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(n)) + "."
    rows = [(k, clean(rng.randint(10, 60)), "en", f"s{k % 2}") for k in range(240)]
    junk = clean(60).replace(" ", " $$$$ |||| ")
    rows += [(1000, junk, "en", "s0"), (1001, junk, "en", "alone")]
    out = {r.doc_id: r for r in quality.quality_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not out[1000].base_failed and not out[1000].kept
    assert out[1001].distance is not None and not out[1001].kept
    assert sum(out[k].kept for k in range(240)) >= 238


def _plain_mcd(rows):
    """(base failed, squared distance) of every row, by plain arrays: the estimate of each (language, source) in turn."""
    p = 6

    def vec(text):
        n, chars, symbols, dup, repeated = brute(text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
        upper, alnum = sum(c.isupper() for c in text), sum(c.isalnum() for c in text)
        return n, repeated, np.array([np.log(max(chars, 1) / max(n, 1)), *np.sqrt([symbols / max(n, 1), dup / max(lines, 1), repeated / max(n, 1), upper / max(chars, 1), max(chars - alnum - symbols, 0) / max(chars, 1)])])

    at = lambda v, q: np.sort(v, axis=0)[max(0, math.ceil(q * len(v)) - 1)]
    raw = [vec(t or "") for _, t, _, _ in rows]
    failed = [n < 20 or 100 * r > 30 * n for n, r, _ in raw]
    fit = [k for k, bad in enumerate(failed) if not bad]
    lang, group = [r[2] for r in rows], [(r[2], r[3]) for r in rows]
    median = {g: at(np.array([raw[k][2] for k in fit if lang[k] == g]), 0.5) for g in {lang[k] for k in fit}}
    x = {k: median[lang[k]] + (raw[k][2] - median[lang[k]]) * np.sqrt(raw[k][0] / (raw[k][0] + 150)) for k in range(len(rows)) if lang[k] in median}
    groups = {g: [k for k in fit if group[k] == g] for g in {group[k] for k in fit}}
    floors = np.array(quality.FLOORS)
    centre = {g: at(np.array([x[k] for k in ks]), 0.5) for g, ks in groups.items()}
    inverse = {g: np.diag(1 / (((at(np.array([x[k] for k in ks]), 0.75) - at(np.array([x[k] for k in ks]), 0.25)) / 1.349) ** 2 + floors**2)) for g, ks in groups.items()}
    far = lambda k, g: float((x[k] - centre[g]) @ inverse[g] @ (x[k] - centre[g]))

    def estimate(near, share, cutoff):
        """New centres and precisions from the near rows of each group; the sum of the log determinants."""
        scale, total = share / quality.chi2_cdf(cutoff, p + 2), 0.0
        spread = lambda v: (v.mean(axis=0), (v - v.mean(axis=0)).T @ (v - v.mean(axis=0))) if len(v) else (None, np.zeros((p, p)))
        every = np.array([x[k] for ks in near.values() for k in ks])
        new = {}
        for g, ks in near.items():
            own = np.array([x[k] for k in ks]).reshape(-1, p)
            wide = np.array([x[k] for h, js in near.items() if h[0] == g[0] for k in js])
            wide = wide if len(wide) else every
            lean, around = spread(wide)
            mean, scatter = spread(own)
            weight = 50 / (len(own) + 50)
            cov = (scatter + 50 * around / len(wide)) / (len(own) + 50) * scale + np.diag(floors**2)
            new[g] = ((1 - weight) * (mean if mean is not None else lean) + weight * lean, np.linalg.inv(cov))
            total += np.linalg.slogdet(cov)[1]
        for g, (c, inv) in new.items():
            centre[g], inverse[g] = c, inv
        return total

    before = None
    for step in range(quality.STEPS):
        near = {}
        for g, ks in groups.items():
            d = np.array([far(k, g) for k in ks])
            near[g] = [k for k, v in zip(ks, d, strict=True) if v <= at(d, 0.75)]
        now = estimate(near, 0.75, quality.chi2_quantile(0.25, p))
        if before is not None and before - now <= 0.05 * max(1, len(groups)) and step < quality.STEPS - 1:
            break
        before = now
    estimate({g: [k for k in ks if far(k, g) <= quality.NEAR] for g, ks in groups.items()}, 0.975, quality.NEAR)
    return [(bad, far(k, group[k]) if group[k] in centre else None) for k, bad in enumerate(failed)]


def test_distances_match_plain_arrays(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    clean = lambda n: rng.choice([". ", ".\n", "! "]).join(" ".join(word() for _ in range(rng.randint(5, 14))).capitalize() for _ in range(n)) + "."
    rows = [(k, clean(rng.randint(3, 40)), rng.choice(["en", "en", "de"]), f"s{rng.randrange(3)}") for k in range(220)]
    rows += [(500 + k, clean(12).replace(" ", rng.choice(["$$ |", " #"])), "en", "s0") for k in range(8)] + [(600, clean(30).upper(), "fr", "s9"), (601, clean(30), "fr", "s8"), (602, "", "en", "s0"), (603, None, "it", "s0")]
    rows += [(700 + k, "\n".join([clean(2)] * 6 + [clean(9)]), "de", "s1") for k in range(4)]
    want = _plain_mcd(rows)
    out = {r.doc_id: r for r in quality.quality_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()}
    for row, (failed, d) in zip(rows, want, strict=True):
        got = out[row[0]]
        assert got.base_failed == failed
        assert (d is None and got.distance is None) or abs(got.distance - d) < 1e-6 * max(1.0, d), (row[0], got.distance, d)
        assert got.kept == (not failed and (d is None or d <= quality.CUTOFF))
