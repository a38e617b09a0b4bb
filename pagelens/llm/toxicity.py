"""Toxicity by a counterfactual-regularised linear classifier.

Features are the distinct lower-case words of the whole text and their beginnings of three to eight letters, hashed; the
ones whose frequency differs between the classes are chosen by a two-proportion test. The classifier is a logistic
regression on them and on the logarithm of the count of distinct words. Its loss has, beside the log loss and a small
ridge, the squared change of the logit between a labelled sentence and its counterfactuals: the sentence with one of its
identity terms swapped for each other of the same kind and language or, where it names none, with a neutral mention added.
Of each class, the sentences that name a group come first, and first sentences of other texts fill up to SENTENCES. So
mentioning a group moves the score little, however often insults stand beside such words in the training texts.

The model is fitted on about TRAIN_ROWS labelled rows (all, if there are fewer), chosen by a hash of doc_id; rows whose
crc32(doc_id as text) mod 5 is 0 are never among them. Scores read the text alone.

Defined results: NULL and empty texts score as a text without words; without labelled rows of both classes every score is
the smoothed share of toxic labels; repeated rows score alike, and labelled rows that share a doc_id count as one document; NULL doc_ids are scored and count as not held out; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_or_null, materialize

#: Labelled rows that the model is fitted on, about; features kept at most; hash buckets of features.
TRAIN_ROWS, FEATURES, BUCKETS = 16_000, 4096, 1 << 20
#: Least z of a feature's two-proportion test, and the least documents that have it.
LEAST_Z, LEAST_DOCS = 3.0, 4
#: Weights of the ridge and of the counterfactual penalty, gradient steps, and sentences per class that get counterfactuals.
RIDGE, PENALTY, STEPS, SENTENCES = 2e-4, 0.5, 250, 400
#: Identity terms, by kind, in English, German, French and Spanish; a term is swapped for the others of its kind.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist", "sikh"),
    ("black", "white", "asian", "latino", "african", "arab", "european", "native"),
    ("gay", "straight", "lesbian", "bisexual", "trans", "queer"),
    ("women", "men", "female", "male", "woman", "man"),
    ("immigrant", "refugee", "foreigner", "citizen", "migrant"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
    ("muslim", "christ", "jude", "hindu", "buddhist", "katholik", "atheist"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "araber", "europäer"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell"),
    ("frauen", "männer", "frau", "mann"),
    ("einwanderer", "flüchtling", "ausländer", "bürger", "migrant"),
    ("behindert", "taub", "blind", "autistisch", "alt", "jung"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "catholique", "athée"),
    ("noir", "blanc", "asiatique", "africain", "arabe", "européen"),
    ("homosexuel", "lesbienne", "bisexuel", "hétérosexuel"),
    ("femmes", "hommes", "femme", "homme"),
    ("immigré", "réfugié", "étranger", "citoyen", "migrant"),
    ("handicapé", "sourd", "aveugle", "autiste", "âgé", "jeune"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "católico", "ateo"),
    ("negro", "blanco", "asiático", "africano", "árabe", "europeo"),
    ("homosexual", "lesbiana", "bisexual", "heterosexual"),
    ("mujeres", "hombres", "mujer", "hombre"),
    ("inmigrante", "refugiado", "extranjero", "ciudadano", "migrante"),
    ("discapacitado", "sordo", "ciego", "autista", "mayor", "joven"),
)
WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """Buckets of a word and its beginnings."""
    parts = [f"={word}", *(f"^{word[:k]}" for k in range(3, min(8, len(word)) + 1))]
    return [zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS for p in parts]


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, BUCKETS), np.int64)
    rows = [0, 0]
    known: dict[str, list[int]] = {}
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if len(known) > 300_000:
                known.clear()
            found: set[int] = set()
            for w in distinct_words(text):
                found.update(known[w] if w in known else known.setdefault(w, features(w)))
            if found:
                seen[toxic, np.fromiter(found, np.int64, len(found))] += 1
            rows[toxic] += 1
    at = np.flatnonzero(seen.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at]).astype(np.int32)), pa.array(np.concatenate([[rows[0]], seen[0, at]])), pa.array(np.concatenate([[rows[1]], seen[1, at]]))], ["bucket", "clean", "toxic"])


class Encoder:
    """From texts to the positions of the chosen features."""

    def __init__(self, buckets: list[int]) -> None:
        self.at = {b: k for k, b in enumerate(buckets)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {"at": self.at, "known": {}}

    def encode(self, words: set[str]) -> list[int]:
        out: set[int] = set()
        for w in words:
            own = self.known.get(w)
            if own is None:
                if len(self.known) > 400_000:
                    self.known.clear()
                own = self.known[w] = tuple(self.at[b] for b in features(w) if b in self.at)
            if own:
                out.update(own)
        return sorted(out)


def length_of(words: set[str]) -> float:
    return float(np.log1p(len(words))) / 6 - 1


def sentences(text: str | None) -> list[set[str]]:
    """The distinct words of each sentence with a word."""
    return [words for words in (distinct_words(s) for s in re.split(r"[.!?\n]+", text or "")) if words]


def counterfactuals(words: set[str], turn: int) -> list[tuple[set[str], set[str]]]:
    """(words, words of a counterfactual): each identity term swapped for every other of its kind or, if there is none, one term of each kind added, the turn-th."""
    swaps = [(words, words - {term} | {other}) for kind in IDENTITY for term in sorted(words.intersection(kind)) for other in kind if other != term]
    return swaps or [(words, words | {kind[turn % len(kind)]}) for kind in IDENTITY]


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (toxic, text, order) to (toxic, named, order, words): the sentences that name a group, and the first sentence of every other text."""
    terms = {t for kind in IDENTITY for t in kind}
    for batch in batches:
        out = []
        for toxic, text, order in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = sentences(text)
            named = [w for w in own if not w.isdisjoint(terms)]
            out += [{"toxic": toxic, "named": bool(named), "order": order, "words": sorted(w)} for w in named or own[:1]]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("toxic", pa.int32()), ("named", pa.bool_()), ("order", pa.int64()), ("words", pa.list_(pa.string()))]))


class Matrix:
    """Rows of feature positions with their length feature, and the products that the gradient needs."""

    def __init__(self, rows: list[list[int]], lengths: list[float], width: int) -> None:
        self.counts = np.array([len(r) for r in rows], np.int64)
        self.cols = np.fromiter((c for r in rows for c in r), np.int64, int(self.counts.sum()))
        self.rows = np.repeat(np.arange(len(rows)), self.counts)
        self.lengths, self.n, self.width = np.array(lengths, float), len(rows), width

    def logits(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.n) + self.lengths * w[self.width] + w[self.width + 1]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.cols, g[self.rows], self.width), [g @ self.lengths, g.sum()]])


def train(data: Matrix, labels: np.ndarray, pairs: tuple[Matrix, Matrix] | None) -> np.ndarray:
    """Weights by full-batch gradient steps with adaptive moments; the order of the rows doesn't matter."""
    w = np.zeros(data.width + 2)
    share = (labels.sum() + 1) / (len(labels) + 2)
    w[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    ridge = np.full_like(w, RIDGE)
    ridge[-2:] = 0
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(data.logits(w), -30, 30)))
        g = data.back((p - labels) / len(labels)) + ridge * w
        if pairs is not None:
            gap = (pairs[0].logits(w) - pairs[1].logits(w)) * (2 * PENALTY / pairs[0].n)
            g += pairs[0].back(gap) - pairs[1].back(gap)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


class Model:
    def __init__(self, encoder: Encoder, weights: np.ndarray) -> None:
        self.encoder, self.weights = encoder, weights

    def score(self, text: str | None) -> float:
        words = distinct_words(text)
        z = self.weights[self.encoder.encode(words)].sum() + length_of(words) * self.weights[-2] + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, n_sentences: int = SENTENCES) -> Model:
    """The model from about `train_rows` labelled documents that are not held out, and the counterfactuals of at most `n_sentences` sentences of each class."""
    marked = labels.select(column_or_null(labels, id_col, "long").alias("doc_id"), column_or_null(labels, label_col, "int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).distinct()
    share = min(1.0, train_rows / max(1, marked.count()))
    chosen = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    texts = docs.select(column_or_null(docs, id_col, "long").alias("doc_id"), column_or_null(docs, text_col, "string").alias("text"))
    # Of documents with the same doc_id, one is taken.
    first = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))
    sample = materialize(first.select("toxic", "text", F.xxhash64("doc_id", "toxic").alias("order")))
    counts = sample.select("toxic", "text").mapInArrow(_count, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts)
    rows = counts.filter("bucket = -1").first()
    clean, toxic = (rows["clean"], rows["toxic"]) if rows else (0, 0)
    if not clean or not toxic:
        share = (toxic + 1) / (clean + toxic + 2)
        return Model(Encoder([]), np.array([0.0, np.log(share / (1 - share))]))
    pooled = (F.col("clean") + F.col("toxic")) / F.lit(float(clean + toxic))
    z = F.abs(F.col("toxic") / F.lit(float(toxic)) - F.col("clean") / F.lit(float(clean))) / F.sqrt(pooled * (1 - pooled) * F.lit(1 / toxic + 1 / clean) + F.lit(1e-12))
    best = counts.filter((F.col("bucket") >= 0) & (F.col("clean") + F.col("toxic") >= LEAST_DOCS)).select("bucket", z.alias("z")).filter(F.col("z") >= LEAST_Z).orderBy(F.col("z").desc(), "bucket").limit(FEATURES)
    named = {b for kind in IDENTITY for term in kind for b in features(term)}
    encoder = Encoder(sorted({r.bucket for r in best.collect()} | named))
    held = docs.sparkSession.sparkContext.broadcast(encoder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [distinct_words(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([held.value.encode(w) for w in words], pa.list_(pa.int32())), pa.array(map(length_of, words), pa.float64()), batch.column(2)], ["toxic", "at", "length", "order"])

    encoded: pd.DataFrame = sample.mapInArrow(encode, "toxic int, at array<int>, length double, order long").toPandas().sort_values(["order", "length"])
    data = Matrix([list(a) for a in encoded["at"]], encoded["length"].tolist(), len(encoder.at))
    spoken = materialize(sample.select("toxic", "text", "order").mapInArrow(_sentences, "toxic int, named boolean, order long, words array<string>"))
    best = [spoken.filter(F.col("toxic") == t).orderBy(F.col("named").desc(), "order", "words").limit(n_sentences).collect() for t in (0, 1)]
    pairs = [p for rows in best for turn, r in enumerate(rows) for p in counterfactuals(set(r.words), turn)]
    both = tuple(Matrix([encoder.encode(p[k]) for p in pairs], [length_of(p[k]) for p in pairs], len(encoder.at)) for k in (0, 1)) if pairs else None
    return Model(encoder, train(data, encoded["toxic"].to_numpy(float), both))


def _scorer(held):
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([held.value.score(t) for t in texts.to_pylist()], pa.float64())

    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return score


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted. One pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(column_or_null(docs, id_col, "long").alias("doc_id"), F.arrow_udf(_scorer(held), T.DoubleType())(column_or_null(docs, text_col, "string")).alias("score"))
    return materialize(rows).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
