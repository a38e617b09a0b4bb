"""Substring dedup by sliding sentence spans.

Texts are cut into sentences (at line ends, and after . ! or ? before white space). From every sentence on, and up to
every sentence, slides a span over several consecutive sentences: LEAST_WORDS words, or one more than the sentence has,
so that it holds the sentence whole and goes on into its neighbours, the last of which may be cut. A sentence of
PASSAGE words is a passage by itself and its own span. Spans are hashed (96 bits, over the words in lower case) and
counted over the whole corpus; longer spans cover nothing that these don't. The first occurrence, by doc_id and place,
stays; sentences that lie wholly in any other occurrence are removed.

Repeated passages need not begin or end with a sentence. Every sentence of a repeated passage of PASSAGE words that is
whole in both copies has a span that lies in the passage: with fewer than LEAST_WORDS words, it has so many with those
before it or with those after it; with more, one word before or after it is in the passage. So all these are found.

Defined results: NULL and empty texts have no spans; a NULL doc_id comes after all others; rows with the same doc_id are
separate documents, in an order that the input's layout fixes; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SHARE, column_or_null, lookup_join, materialize, nested

#: Least words of a span, and the words of a sentence that is a passage by itself.
LEAST_WORDS, PASSAGE = 20, 50
#: Hashes of words that a worker keeps at most, and documents whose runs it merges at a time.
KEPT_WORDS, MERGED = 50_000, 256
END = re.compile(r"[.!?]+\s+|\s*\n\s*")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence with a word, without the white space around it."""
    text = text or ""
    out, at = [], 0
    for end in [m.end() for m in END.finditer(text)] + [len(text)]:
        piece = text[at:end]
        core = piece.strip()
        if core:
            start = at + len(piece) - len(piece.lstrip())
            out.append((start, start + len(core)))
        at = end
    return out


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def spans(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, 64-bit hash, 32-bit hash) of every span over the sentences' words."""
    counts = np.array([len(w) for w in words], np.int64)
    edge = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    total = int(edge[-1])
    size = np.where(counts >= PASSAGE, counts, np.maximum(counts + 1, LEAST_WORDS))
    onward, back = edge[:-1] + size <= total, edge[1:] - size >= 0
    both = np.unique(np.concatenate([(edge[:-1] * (total + 1) + edge[:-1] + size)[onward], ((edge[1:] - size) * (total + 1) + edge[1:])[back]]))
    first, end = both // (total + 1), both % (total + 1)
    digests = np.fromiter((_words[w] for own in words for w in own), np.uint64, total)
    power, inverse = _powers(_BASE, total), _powers(_BASE_INVERSE, total)
    out = []
    for h in (_mix(digests), _mix(digests ^ _BASE)):
        summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power, dtype=np.uint64)])
        out.append(_mix((summed[end] - summed[first]) * inverse[first] + (end - first).astype(np.uint64)))
    return first.astype(np.int32), end.astype(np.int32), out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.int64)


_SPAN = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("g", T.LongType())])
_CUT = T.StructType([T.StructField("start", T.ArrayType(T.IntegerType())), T.StructField("end", T.ArrayType(T.IntegerType())), T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("spans", T.ArrayType(_SPAN))])


@F.arrow_udf(_CUT)
def _cut(texts: pa.Array) -> pa.Array:
    starts, ends, words, found = [], [], [], []
    at_sentence, at_span = [0], [0]
    for text in texts.to_pylist():
        own = sentences(text)
        each = [text[s:e].lower().split() for s, e in own]
        starts += [s for s, _ in own]
        ends += [e for _, e in own]
        words += [len(w) for w in each]
        found.append(spans(each))
        at_sentence.append(len(starts))
        at_span.append(at_span[-1] + len(found[-1][0]))
    column = lambda k, kind: pa.array(np.concatenate([np.zeros(0, np.int32), *[f[k] for f in found]]), kind)
    struct = pa.StructArray.from_arrays([column(0, pa.int32()), column(1, pa.int32()), column(2, pa.int64()), column(3, pa.int64())], ["i", "e", "h", "g"])
    listed = lambda values: pa.ListArray.from_arrays(pa.array(at_sentence, pa.int32()), pa.array(values, pa.int32()))
    return pa.StructArray.from_arrays([listed(starts), listed(ends), listed(words), pa.ListArray.from_arrays(pa.array(at_span, pa.int32()), struct)], ["start", "end", "words", "spans"])


_REMOVED = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("span_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("n_sentences", pa.int32()), ("n_words", pa.int64()), ("first_doc_id", pa.int64())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (uid, doc_id, start, end, words, hits) to maximal runs of removed sentences."""
    for batch in (b.slice(at, MERGED) for b in batches for at in range(0, b.num_rows, MERGED)):
        out = []
        for r in batch.to_pylist():
            runs: list[list] = []
            edge = list(accumulate(r["words"], initial=0))
            # The sentences that lie wholly in each span.
            hits = [(bisect_left(edge, x["i"]), bisect_right(edge, x["e"]) - 1, x["first"]) for x in r["hits"]]
            for i, e, of in sorted(hits, key=lambda x: x[:2]):
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                    runs[-1][2] = min((x for x in (runs[-1][2], of) if x is not None), default=None)
                else:
                    runs.append([i, e, of])
            for no, (i, e, first) in enumerate(runs):
                out.append({"uid": r["uid"], "doc_id": r["doc_id"], "span_no": no, "start": r["start"][i], "end": r["end"][e - 1], "n_sentences": e - i, "n_words": sum(r["words"][i:e]), "first_doc_id": first})
        yield pa.RecordBatch.from_pylist(out, schema=_REMOVED)


def _cut_rows(docs: DataFrame, *cols: Column) -> DataFrame:
    """(cols, __c, __uid) of docs, written once; one of the columns is __text, which the struct __c is cut from."""
    rows = docs.select(*cols).select("*", _cut(F.col("__text")).alias("__c"))
    return materialize(rows.withColumn("__uid", F.monotonically_increasing_id()))


def _copies(every: DataFrame, total: int) -> DataFrame:
    """Of (uid, doc_id, h, g, i, e), `total` rows: all but the first of those whose hashes (h, g) occur twice or more, with the first's doc_id as `first`."""
    spread = F.col("uid")
    # Counting needs one hash only; most occur once and go no further than this.
    often = materialize(every.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    heavy = often.filter(F.col("n") * SHARE > total).select("h")
    met = materialize(lookup_join(every, often.select("h"), "h", "inner", spread=spread, heavy=heavy))
    first = met.groupBy("h", "g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "i")).alias("f"))
    # Where two texts share the first hash only, each of the two is a first of its own.
    first = first.groupBy("h").agg(F.collect_list(F.struct("g", "f")).alias("firsts"))
    of = lambda c: F.filter("firsts", lambda x: x["g"] == F.col("g"))[0]["f"][c]
    joined = lookup_join(met, materialize(first), "h", "inner", spread=spread, heavy=heavy)
    return joined.select("uid", "i", "e", of("doc_id").alias("first"), of("uid").alias("first_uid"), of("i").alias("first_i")).filter("not (uid = first_uid and i = first_i)")


def _removed(rows: DataFrame) -> DataFrame:
    """(uid, doc_id, span_no, start, end, n_sentences, n_words, first_doc_id) of every removed run of the cut rows."""
    cut = rows.select(F.col("__uid").alias("uid"), F.col("__id").alias("doc_id"), F.col("__c").alias("c"))
    n_spans = rows.agg(F.sum(F.size("__c.spans"))).first()[0]
    every = cut.select("uid", "doc_id", F.explode("c.spans").alias("s")).select("uid", "doc_id", "s.h", "s.g", "s.i", "s.e")
    by_doc = _copies(every, n_spans or 0).groupBy("uid").agg(F.collect_list(F.struct("i", "e", "first")).alias("hits"))
    joined = cut.join(by_doc, "uid").select("uid", "doc_id", "c.start", "c.end", "c.words", "hits")
    return joined.mapInArrow(_merge, "uid long, doc_id long, span_no int, start int, end int, n_sentences int, n_words long, first_doc_id long")


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [column_or_null(docs, id_col, "long").alias("__id"), column_or_null(docs, text_col, "string").alias("__text")]


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs of sentences to remove: doc_id, span_no within the document, start and end (code points, end exclusive), sentences, words, and the document that keeps the first copy."""
    return _removed(_cut_rows(docs, *_inputs(docs, id_col, text_col))).drop("uid")


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    out = []
    for text, start, end in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
        for s, e in sorted(zip(start, end, strict=True), reverse=True):
            text = text[:s] + text[e:].lstrip() if s == 0 else text[:s].rstrip() + text[e:]
        out.append(text)
    return pa.array(out, pa.string())


def remove_repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated runs cut out of their texts; the other columns stay as they are."""
    rows = _cut_rows(docs, nested(docs.drop(text_col)), *_inputs(docs, id_col, text_col))
    gone = _removed(rows).groupBy(F.col("uid").alias("__uid")).agg(F.collect_list("start").alias("__starts"), F.collect_list("end").alias("__ends"))
    joined = rows.drop("__c").join(gone, "__uid", "left")
    cut = materialize(joined.withColumn("__text", F.when(F.col("__starts").isNull(), F.col("__text")).otherwise(_without("__text", F.coalesce("__starts", F.array().cast("array<int>")), F.coalesce("__ends", F.array().cast("array<int>"))))).select("__row", "__text"))
    return cut.select(*[F.col("__text").alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in docs.columns])
