"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per text: the likelihood of its byte trigrams, the language that its markup
(or its record) declares, the suffix of its address, and a prior from its host. The trigram model is fitted on a sample
of labelled texts (about `sample_docs` of them, and LEAST_DOCS of every language where it has so many, chosen by hash;
whole texts); its languages are all those of the table. Everything else is counted over all rows:
how often each declared language and each suffix goes with each language, and how many texts of each language a host, its
registered domain and the whole corpus have. Host priors are smoothed towards the domain, and that towards the corpus,
by Dirichlet counts; a text's own share is taken out of its host's counts before.

Host counts are grouped sums (combined before the shuffle), so a host with a third of all pages is one row by then.

Defined results: NULL and empty texts have a flat likelihood, so the other evidence decides; evidence that is NULL is
left out; if no labelled text is there, the language is NULL; repeated rows are judged alike up to their own share in
the prior; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_or_null, lookup_join, materialize

#: Trigram buckets, and the pseudo-count of each.
BUCKETS, TRIGRAM_PRIOR = 1 << 14, 0.5
#: Trigrams of a text are not independent: its likelihood counts as that of so many of them at most.
EFFECTIVE = 40.0
#: Dirichlet weights, in texts, of domain in host, corpus in domain, and corpus in declared languages and suffixes.
HOST_PRIOR, DOMAIN_PRIOR, LABEL_PRIOR = 8.0, 20.0, 5.0
#: Labelled texts that the trigram model is fitted on, about.
SAMPLE_DOCS = 6_000
#: Of these, about so many of each language at least.
LEAST_DOCS = 200

_HIDDEN = re.compile(r"<(script|style)\b", re.IGNORECASE)
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style")}
_DECLARED = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?\s*([A-Za-z]{2,3})""", re.IGNORECASE)


def visible_text(page: str | None) -> str:
    """Text of a page without markup, scripts and comments; each is looked for to the end of the page once."""
    page = page or ""
    out, at, unclosed = [], 0, set()
    while (tag := page.find("<", at)) >= 0:
        hidden = _HIDDEN.match(page, tag)
        kind = hidden[1].lower() if hidden else "comment" if page.startswith("<!--", tag) else None
        end = -1
        if kind and kind not in unclosed:
            if hidden:
                closing = _CLOSING[kind].search(page, hidden.end())
                end = closing.end() if closing else -1
            else:
                end = page.find("-->", tag + 4) + 3 if page.find("-->", tag + 4) >= 0 else -1
            if end < 0:
                unclosed.add(kind)
        if end < 0:
            end = page.find(">", tag) + 1
        if not end:
            break
        out += [page[at:tag], " "]
        at = end
    return _html.unescape("".join([*out, page[at:]]))


def declared_language(page: str | None) -> str | None:
    """The language of the page's html tag, in lower case."""
    m = _DECLARED.search(page or "")
    return m[1].lower() if m else None


def trigrams(text: str | None) -> np.ndarray:
    """Counts of the text's byte trigrams, in lower case, by bucket."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(BUCKETS, np.int64)
    code = ((raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA77)) ^ (raw[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
    return np.bincount(code >> np.uint32(18), minlength=BUCKETS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[lang] = sums.get(lang, 0) + trigrams(text)
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], ["lang", "bucket", "n"])


class TrigramModel:
    """Languages and the log probabilities (buckets by languages) of their trigrams."""

    def __init__(self, langs: list[str], logs: np.ndarray) -> None:
        self.langs, self.logs = langs, logs

    def likelihood(self, text: str | None) -> list[float]:
        """Log likelihood per language, 0 for the best."""
        counts = trigrams(text)
        n = counts.sum()
        if not n or not self.langs:
            return [0.0] * len(self.langs)
        at = np.flatnonzero(counts)
        score = counts[at] @ self.logs[at] / n * min(n, EFFECTIVE)
        return (score - score.max()).tolist()


def fit_trigrams(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> TrigramModel:
    """The model of all languages of the table, from about `sample_docs` of its rows and LEAST_DOCS of each language, chosen by a hash of the whole row."""
    whole = [F.col(f"`{f.name}`") for f in labelled.schema.fields if "map<" not in f.dataType.simpleString()]
    place = F.pmod(F.xxhash64(*whole), F.lit(1_000_000_000)).alias("place")
    rows = labelled.select(column_or_null(labelled, lang_col, "string").alias("lang"), column_or_null(labelled, text_col, "string").alias("text"), place).filter("lang is not null")
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least")).collect()
    langs = sorted(r.lang for r in found)
    total = sum(r.n for r in found)
    share = lambda n: min(1.0, max(sample_docs / total, LEAST_DOCS / n))
    # The row that hashes to the least is always taken, so no language is without a text.
    bounds = labelled.sparkSession.createDataFrame([(r.lang, max(int(share(r.n) * 1_000_000_000), r.least)) for r in found], "lang string, bound long")
    sample = rows.join(F.broadcast(bounds), "lang").filter("place <= bound").select("lang", "text")
    counted = sample.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    logs = np.full((BUCKETS, len(langs)), TRIGRAM_PRIOR)
    for k, lang in enumerate(langs):
        own = counted[counted["lang"] == lang]
        logs[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return TrigramModel(langs, np.log(logs / logs.sum(axis=0)))


_EVIDENCE = T.StructType([T.StructField("declared", T.StringType()), T.StructField("ll", T.ArrayType(T.DoubleType()))])


def evidence(docs: DataFrame, model: TrigramModel, text: Column, *, markup: bool) -> Column:
    """(declared, ll) of each text; with markup, of a page's visible text and its html tag."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def find(texts: pa.Array) -> pa.Array:
        pages = texts.to_pylist()
        ll = [held.value.likelihood(visible_text(p) if markup else p) for p in pages]
        return pa.StructArray.from_arrays([pa.array([declared_language(p) if markup else None for p in pages], pa.string()), pa.array(ll, pa.list_(pa.float64()))], ["declared", "ll"])

    find.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(find, _EVIDENCE)(text)


def _sums(array: str, n: int) -> Column:
    return F.array(*[F.coalesce(F.sum(F.col(array)[k]), F.lit(0.0)) for k in range(n)])


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _softmax(logits: Column) -> Column:
    raised = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(raised, lambda x: x / _total(raised))


def _smoothed(counts: Column, prior: Column, weight: float) -> Column:
    return F.zip_with(counts, prior, lambda c, p: (c + F.lit(weight) * p) / (_total(counts) + F.lit(weight)))


def fuse(rows: DataFrame, langs: list[str]) -> DataFrame:
    """rows, written, with (uid, host, domain, suffix, declared, ll); adds lang, confidence and text_lang, and drops what it used."""
    n = len(langs)
    names = F.array(*map(F.lit, langs)) if langs else F.array().cast("array<string>")
    if not n:
        none = F.lit(None)
        return rows.select("*", none.cast("string").alias("lang"), none.cast("double").alias("confidence"), none.cast("string").alias("text_lang")).drop("domain", "suffix", "ll")
    rows = rows.withColumn("post", _softmax(F.col("ll")))
    hosts = materialize(rows.groupBy("host", "domain").agg(_sums("post", n).alias("hn")))
    domains = materialize(hosts.groupBy("domain").agg(_sums("hn", n).alias("dn")))
    corpus = domains.agg(_sums("dn", n)).first()[0]
    total = sum(corpus) + n
    flat = F.array(*[F.lit((c + 1.0) / total) for c in corpus])
    priors = materialize(lookup_join(hosts, domains, "domain").select("host", "hn", _smoothed(F.col("dn"), flat, DOMAIN_PRIOR).alias("dp")))
    # P(seen | language) by how often both go together, towards how often it is seen at all.
    likelihoods = {}
    for name in ("declared", "suffix"):
        pairs = materialize(rows.filter(F.col(name).isNotNull()).groupBy(name).agg(_sums("post", n).alias("c")))
        every = pairs.agg(_sums("c", n)).first()[0]
        whole = max(1e-9, sum(every))
        lit = F.array(*[F.lit(float(x)) for x in every])
        likelihoods[name] = materialize(pairs.select(name, F.zip_with("c", lit, lambda c, e: F.log((c + F.lit(LABEL_PRIOR) * _total(F.col("c")) / F.lit(whole)) / (e + F.lit(LABEL_PRIOR)) + F.lit(1e-9))).alias(f"{name}_ll")))
    out = lookup_join(rows, priors, "host", spread=F.col("uid"))
    for name, found in likelihoods.items():
        out = lookup_join(out, found, name, spread=F.col("uid"))
    none = F.array(*[F.lit(0.0)] * n)
    others = F.zip_with("hn", "post", lambda h, p: F.greatest(h - p, F.lit(0.0)))
    prior = F.transform(_smoothed(others, F.col("dp"), HOST_PRIOR), lambda p: F.log(p + F.lit(1e-9)))
    logits = F.col("ll")
    for extra in (F.coalesce(prior, none), F.coalesce("declared_ll", none), F.coalesce("suffix_ll", none)):
        logits = F.zip_with(logits, extra, lambda a, b: a + b)
    best = lambda p: F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
    out = out.withColumn("fused", _softmax(logits))
    return out.withColumn("lang", best(F.col("fused"))).withColumn("confidence", F.array_max("fused")).withColumn("text_lang", best(F.col("post"))).drop("domain", "suffix", "ll", "post", "hn", "dp", "declared_ll", "suffix_ll", "fused")


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, registered domain (its last two labels) and suffix of a url; empty host and NULL suffix without one."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#:]*)", 1))
    suffix = F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)
    return host, F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1), F.when(suffix != "", suffix)


def identify_pages(pages: DataFrame, model: TrigramModel, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, lang, confidence, and the language of the text alone and of the markup."""
    host, domain, suffix = address_parts(F.col("__url"))
    rows = pages.select(column_or_null(pages, id_col, "long").alias("page_id"), column_or_null(pages, url_col, "string").alias("__url"), evidence(pages, model, column_or_null(pages, html_col, "string"), markup=True).alias("e"))
    rows = rows.select("page_id", host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), "e.declared", "e.ll")
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()))
    return fuse(rows, model.langs).select("page_id", "lang", "confidence", "text_lang", "declared", "host")


def identify_documents(docs: DataFrame, model: TrigramModel, *, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str = "source") -> DataFrame:
    """One row per document; a document's host is its source, and what it declares is its record's language. It has no suffix."""
    host = F.coalesce(column_or_null(docs, host_col, "string"), F.lit(""))
    rows = docs.select(column_or_null(docs, id_col, "long").alias("doc_id"), host.alias("host"), host.alias("domain"), F.lit(None).cast("string").alias("suffix"), column_or_null(docs, declared_col, "string").alias("declared"), evidence(docs, model, column_or_null(docs, text_col, "string"), markup=False)["ll"].alias("ll"))
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()))
    return fuse(rows, model.langs).select("doc_id", "lang", "confidence", "text_lang", "declared", "host")
