"""Quality rules: robust multivariate outliers by the minimum covariance determinant, per language and source.

Each text gives exact counts and a short vector of transformed statistics. Per group (language, source) the vectors'
centre and scatter are estimated by concentration steps: keep the fraction `H` of the group's rows nearest to the
current centre, estimate again, until the determinant stops falling; a last step weighs by the chi-square cutoff. A
document is kept if no base rule fails and its squared Mahalanobis distance is within the cutoff.

All steps are grouped sums over all rows (combined before the shuffle), so a group that holds a third of the rows is
never gathered. Small groups lean on their language: its scatter counts as `PRIOR_DOCS` documents. A group, or language,
without a row near enough for the last step has the centre and scatter of its language, or of the corpus.

Defined results: NULL and empty texts have zero counts and fail the base rule; NULL languages and sources form their
own groups; repeated rows are judged alike, each; an empty table gives an empty result; columns of the input that are
not named by parameters are passed through by `filter_quality` and ignored by `quality_rows`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_or_null, lookup_join, materialize, nested, scratch, unnested

#: Fixed values of the base rule.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = re.compile(r"[#*$%&|<>]")

P = 6
#: Fraction of a group's rows that a concentration step keeps.
H = 0.75
#: Concentration steps stop when no group's log determinant falls by more than this, or after STEPS.
SETTLED, STEPS = 0.05, 6
#: Documents that a language's scatter counts for within each of its sources.
PRIOR_DOCS = 50
#: Least standard deviation of each statistic, for those that are constant in clean text.
FLOORS = (0.05, 0.06, 0.10, 0.10, 0.08, 0.08)
#: Words at which sampling noise has the weight of half a statistic's spread.
NOISE_WORDS = 150
#: Chance that a vector from the group's own normal law is rejected.
REJECT_P = 1e-6


def chi2_cdf(x: float, dof: int) -> float:
    """Of an even number of degrees of freedom, in closed form."""
    term, total = 1.0, 0.0
    for k in range(dof // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(upper: float, dof: int) -> float:
    """The x beyond which a share `upper` lies."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - chi2_cdf(mid, dof) > upper else (low, mid)
    return high


CUTOFF = chi2_quantile(REJECT_P, P)
NEAR = chi2_quantile(0.025, P)


def repeat_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    level = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    width = 1
    while width < WINDOW:  # ids of pairs, of fours, of eights: equal ids are equal windows
        key = level[:-width] * (level.max() + 1) + level[width:]
        order = np.argsort(key, kind="stable")
        new = np.empty(len(key), bool)
        new[:1] = False
        new[1:] = key[order][1:] != key[order][:-1]
        level = np.empty(len(key), np.int64)
        level[order] = np.cumsum(new)
        width *= 2
    often = np.bincount(level) >= 2
    if not often.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often[level])
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_stats(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then what only the vector needs: lines with a word, upper-case letters, other punctuation."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split on exactly \x20 and \x09-\x0D
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").split()]
    upper = sum(map(str.isupper, text))
    letters = sum(map(str.isalnum, text))
    symbols = len(SYMBOLS.findall(text))
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines), upper, len(text) - spaces - letters - symbols


STAT_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_other")


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in STAT_NAMES]))
def _stats(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(t) for t in texts], columns=list(STAT_NAMES), dtype="int64")


def vector(s: str) -> list[Column]:
    """The transformed statistics of the struct column `s`: a logarithm and square roots of shares, each flat in its noise."""
    at = lambda name: F.col(f"{s}.{name}").cast("double")
    words = F.greatest(at("n_words"), F.lit(1.0))
    chars = F.greatest(at("word_chars"), F.lit(1.0))
    return [
        F.log(chars / words),
        F.sqrt(at("n_symbols") / words),
        F.sqrt(at("n_dup_lines") / F.greatest(at("n_lines"), F.lit(1.0))),
        F.sqrt(at("n_repeat_words") / words),
        F.sqrt(at("n_upper") / chars),
        F.sqrt(F.greatest(at("n_other"), F.lit(0.0)) / chars),
    ]


def base_failed(s: str) -> Column:
    return (F.col(f"{s}.n_words") < LEAST_WORDS) | (F.col(f"{s}.n_repeat_words") * 100 > F.col(f"{s}.n_words") * MOST_REPEATED_PERCENT)


def distance(x: list[Column], centre: str = "centre", precision: str = "precision") -> Column:
    """Squared Mahalanobis distance; precision holds the rows of the upper triangle, off-diagonal entries doubled."""
    d = [xi - F.col(centre)[i] for i, xi in enumerate(x)]
    terms = [F.col(precision)[k] * d[i] * d[j] for k, (i, j) in enumerate(_PAIRS)]
    return sum(terms[1:], terms[0])


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _estimates(kept_share: float, cutoff: float):
    """From (gk, lk, n, s, ss, ln, ls, lss) to (gk, lk, centre, precision, logdet), with the language as prior."""
    truncated = kept_share / chi2_cdf(cutoff, P + 2)

    def scatter(n: float, s: np.ndarray, ss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = s / n
        full = np.zeros((P, P))
        for k, (i, j) in enumerate(_PAIRS):
            full[i, j] = full[j, i] = ss[k] - n * mean[i] * mean[j]
        return mean, full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                lean, wide = scatter(r["ln"], np.array(r["ls"]), np.array(r["lss"]))
                mean, own = scatter(r["n"], np.array(r["s"]), np.array(r["ss"])) if r["n"] else (lean, np.zeros((P, P)))
                weight = PRIOR_DOCS / (r["n"] + PRIOR_DOCS)
                centre = (1 - weight) * mean + weight * lean
                cov = (own + PRIOR_DOCS * wide / r["ln"]) / (r["n"] + PRIOR_DOCS) * truncated + np.diag(np.square(FLOORS))
                inverse = np.linalg.inv(cov)
                out.append({"gk": r["gk"], "centre": centre.tolist(), "precision": [inverse[i, j] * (1 if i == j else 2) for i, j in _PAIRS], "logdet": float(np.linalg.slogdet(cov)[1])})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("gk", pa.string()), ("centre", pa.list_(pa.float64())), ("precision", pa.list_(pa.float64())), ("logdet", pa.float64())]))

    return run


def _last(rows: DataFrame, params: DataFrame) -> DataFrame:
    """The final (gk, centre, precision, logdet) of every group: the rows within NEAR of `params`, or the language's, or the corpus's, or all rows."""
    x = [F.col("x")[i] for i in range(P)]
    near = lookup_join(rows, params.select("gk", "centre", "precision"), "gk", "inner").withColumn("near", distance(x) <= NEAR)
    of = lambda v: F.sum(F.when(F.col("near"), v).otherwise(F.lit(0.0)))
    # A group without near rows stays, with n = 0.
    sums = materialize(near.groupBy("gk", "lk").agg(of(F.lit(1.0)).alias("n"), F.array(*[of(v) for v in x]).alias("s"), F.array(*[of(x[i] * x[j]) for i, j in _PAIRS]).alias("ss")))
    total = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)])
    whole = [F.sum("n").alias("n"), total("s", P).alias("s"), total("ss", len(_PAIRS)).alias("ss")]
    corpus = sums.agg(*whole).first()
    if not corpus["n"]:
        corpus = rows.agg(F.count("*").cast("double").alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in _PAIRS]).alias("ss")).first()
        if not corpus["n"]:
            return params
    lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    by_lang = sums.groupBy("lk").agg(*whole).select("lk", *[F.when(F.col("n") > 0, F.col(c)).otherwise(lit(corpus[c])).alias(f"l{c}") for c in ("n", "s", "ss")])
    return materialize(sums.join(by_lang, "lk").mapInArrow(_estimates(0.975, NEAR), "gk string, centre array<double>, precision array<double>, logdet double"))


def _fit(rows: DataFrame) -> DataFrame:
    """(gk, centre, precision, logdet) from the narrow rows (gk, lk, x); none if there are no rows."""
    x = [F.col("x")[i] for i in range(P)]
    start = rows.groupBy("gk").agg(F.array(*[F.percentile_approx(v, 0.5, 2000) for v in x]).alias("centre"), F.array(*[(F.percentile_approx(v, 0.75, 2000) - F.percentile_approx(v, 0.25, 2000)) / 1.349 for v in x]).alias("spread"))
    diagonal = F.array(*[1 / (F.col("spread")[i] ** 2 + FLOORS[i] ** 2) if i == j else F.lit(0.0) for i, j in _PAIRS])
    params = materialize(start.select("gk", "centre", diagonal.alias("precision"), F.lit(0.0).alias("logdet")))
    before = None
    for step in range(STEPS):
        with_d = lookup_join(rows, params.select("gk", "centre", "precision"), "gk", "inner").withColumn("d", distance(x)).select("gk", "lk", "x", "d")
        cuts = materialize(with_d.groupBy("gk").agg(F.percentile_approx("d", H, 2000).alias("cut")))
        near = lookup_join(with_d, cuts, "gk", "inner").filter("d <= cut")
        sums = materialize(near.groupBy("gk", "lk").agg(F.count("*").cast("double").alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in _PAIRS]).alias("ss")))
        total = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)])
        by_lang = sums.groupBy("lk").agg(F.sum("n").alias("ln"), total("s", P).alias("ls"), total("ss", len(_PAIRS)).alias("lss"))
        params = materialize(sums.join(by_lang, "lk").mapInArrow(_estimates(H, chi2_quantile(1 - H, P)), "gk string, centre array<double>, precision array<double>, logdet double"))
        now = params.agg(F.sum("logdet"), F.count("*")).first()
        if before is not None and (before - (now[0] or 0.0)) <= SETTLED * max(1, now[1]) and step < STEPS - 1:
            break
        before = now[0] or 0.0
    return _last(rows, params)


def _judged(rows: DataFrame) -> DataFrame:
    """`rows`, a written table with the struct __q and the keys __lk and __gk, with __base and __d (NULL where no group was fitted)."""
    raw = materialize(rows.filter(~base_failed("__q")).select(F.col("__lk").alias("lk"), F.col("__gk").alias("gk"), F.array(*vector("__q")).alias("x"), (F.col("__q.n_words") / (F.col("__q.n_words") + NOISE_WORDS)).alias("w")))
    # Short texts scatter more: each vector is drawn towards the median of its language as its words are few.
    medians = materialize(raw.groupBy("lk").agg(F.array(*[F.percentile_approx(F.col("x")[i], 0.5, 2000) for i in range(P)]).alias("m")))
    drawn = lambda v, m, w: [F.col(m)[i] + (xi - F.col(m)[i]) * F.sqrt(w) for i, xi in enumerate(v)]
    narrow = materialize(lookup_join(raw, medians, "lk", "inner").select("gk", "lk", F.array(*drawn([F.col("x")[i] for i in range(P)], "m", F.col("w"))).alias("x")))
    with scratch(rows.sparkSession) as scope:
        of_group = materialize(narrow.select("gk", "lk").distinct())
        params = lookup_join(_fit(narrow), of_group, "gk", "inner")
        params = scope.keep(materialize(lookup_join(params, medians, "lk", "inner").select(F.col("gk").alias("__gk"), F.col("centre").alias("__centre"), F.col("precision").alias("__precision"), F.col("m").alias("__median"))))
    x = drawn(vector("__q"), "__median", F.col("__q.n_words") / (F.col("__q.n_words") + NOISE_WORDS))
    judged = lookup_join(rows, params, "__gk").withColumn("__base", base_failed("__q")).withColumn("__d", distance(x, "__centre", "__precision"))
    return judged.drop("__gk", "__centre", "__precision", "__median", "__lk")


def _scanned(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The rows of docs as __row, with the counts __q of their texts and their keys."""
    lang = F.coalesce(column_or_null(docs, lang_col, "string"), F.lit("\x00"))
    source = F.coalesce(column_or_null(docs, source_col, "string"), F.lit("\x00"))
    return docs.select(nested(docs), _stats(column_or_null(docs, text_col, "string")).alias("__q"), lang.alias("__lk"), F.concat_ws("\x01", lang, source).alias("__gk"))


def _kept() -> Column:
    return ~F.col("__base") & (F.coalesce("__d", F.lit(0.0)) <= CUTOFF)


def quality_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: its counts, the base rule, the squared distance from its group and the verdict."""
    wanted = docs.select(column_or_null(docs, id_col, "long").alias("doc_id"), column_or_null(docs, text_col, "string").alias("text"), column_or_null(docs, lang_col, "string").alias("lang"), column_or_null(docs, source_col, "string").alias("source"))
    rows = materialize(_scanned(wanted, "text", "lang", "source").withColumn("__row", F.struct("__row.doc_id")))
    return _judged(rows).select("__row.doc_id", *[F.col(f"__q.{n}").alias(n) for n in STAT_NAMES[:5]], F.col("__base").alias("base_failed"), _kept().alias("kept"), F.col("__d").alias("distance"))


def filter_quality(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that are kept, with all their columns. Texts are written once beside their counts and never shuffled (unless there are more than 50,000 groups)."""
    rows = materialize(_scanned(docs, text_col, lang_col, source_col))
    return _judged(rows).filter(_kept()).select(*unnested(docs))
