"""Benchmark decontamination: a BM25 index of the test items, searched by every training passage with block-max WAND.

The test items are indexed once: postings of every word with its BM25 weight, divided by the item's own full score, so
a score of 1 means that the passage holds all words of the item. Items are ordered by length and cut into blocks, and
each word has its greatest weight per block. Every text is a row of overlapping passages, long enough that each item
fits into one of them whole. A passage whose greatest possible score in every block is below THRESHOLD is done; others
run block-max WAND over the blocks left, which returns all items above THRESHOLD. An item found so is verified: enough
of the three-word shingles of its question and of its answer must stand in the passage.

The index is held by every Python worker, so it has about SEGMENT_CHARS of item text; more items than that make more
indexes, and each is searched by all texts in a pass of its own. Word weights, mean length and the length of passages
are those of all items, so scores and hits are the same however many indexes there are.

Defined results: NULL and empty texts have no passages; items with NULL or wordless texts match nothing; an item with a
NULL item_id is found and reported as any other; repeated rows and items are each reported; an empty table, of either
kind, gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_or_null, drop_rows, materialize, nested, unnested

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach.
THRESHOLD = 0.6
#: Share of the shingles of question and answer that a passage must hold.
OVERLAP = 0.6
SHINGLE = 3
#: Least words of a passage; it has twice those of the longest item otherwise.
PASSAGE = 64
#: Items of a block, unless the table of block bounds would have more than CELLS cells.
BLOCK, CELLS = 2, 16_000_000
#: Cells of that table that a text looks at in one go.
SLAB = 4_000_000
SEGMENT_CHARS = 8_000_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of question and answer: the answer is the last sentence or line, if there is more than one."""
    parts = [w for w in map(words_of, re.split(r"(?<=[.!?])\s+|\n+", text)) if w]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingle_set(words: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class _Vocabulary(dict):
    def __missing__(self, word: str) -> int:
        return -1


@dataclass
class Counts:
    """Of all items: how many, their mean and greatest length, and how many hold each word."""

    n: int
    mean: float
    longest: int
    holders: dict[str, int]


class Index:
    """Postings, block bounds and shingles of the items (id, question words, answer words), which may be some of all those counted."""

    def __init__(self, items: list[tuple[int | None, list[str], list[str]]], of_all: Counts | None = None) -> None:
        items = sorted((x for x in items if x[1] or x[2]), key=lambda x: (len(x[1]) + len(x[2]), x[0] is None, x[0] or 0))
        self.ids = [x[0] for x in items]
        self.parts = [(shingle_set(q), shingle_set(a)) for _, q, a in items]
        self.vocabulary = _Vocabulary()
        counts = [Counter(q + a) for _, q, a in items]
        sizes = [sum(c.values()) for c in counts]
        n = len(items)
        own = Counter(w for c in counts for w in c)
        of_all = of_all or Counts(n, sum(sizes) / max(1, n), max(sizes, default=0), own)
        mean = of_all.mean
        for word in sorted(own):
            self.vocabulary[word] = len(self.vocabulary)
        idf = {w: float(np.log1p((of_all.n - of_all.holders[w] + 0.5) / (of_all.holders[w] + 0.5))) for w in own}
        self.block = max(BLOCK, -(-n * max(1, len(own)) // CELLS))
        self.blocks = -(-n // self.block)
        self.bounds = np.zeros((len(own) + 1, self.blocks), np.float32)  # the last row is for words in no item
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for at, (c, size) in enumerate(zip(counts, sizes, strict=True)):
            weights = {self.vocabulary[w]: idf[w] * k * (K1 + 1) / (k + K1 * (1 - B + B * size / mean)) for w, k in c.items()}
            full = sum(weights.values())
            for term, weight in weights.items():
                postings[term].append((at, weight / full))
                self.bounds[term, at // self.block] = max(self.bounds[term, at // self.block], weight / full)
        self.items = {t: np.array([p[0] for p in ps]) for t, ps in postings.items()}
        self.weights = {t: np.array([p[1] for p in ps]) for t, ps in postings.items()}
        self.most = self.bounds.max(axis=1, initial=0.0).tolist()
        self.window = 2 * max(PASSAGE // 2, of_all.longest)

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """Every (item, score) with score >= least for the distinct terms, by block-max WAND."""
        lists = [(self.items[t], self.weights[t], self.most[t]) for t in terms]
        sums = self.bounds[terms].sum(axis=0, dtype=float)
        at = [0] * len(lists)
        found = []
        least -= 1e-6
        while True:
            live = sorted((int(x[0][p]), k) for k, (x, p) in enumerate(zip(lists, at, strict=True)) if p < len(x[0]))
            bound, pivot = 0.0, None
            for item, k in live:
                bound += lists[k][2]
                if bound >= least:
                    pivot = item
                    break
            if pivot is None:
                return found
            block = pivot // self.block
            if sums[block] < least:  # no item of the pivot's block can do: go to the next block that can
                later = np.flatnonzero(sums[block + 1 :] >= least)
                if not len(later):
                    return found
                target = (block + 1 + int(later[0])) * self.block
                for k, (x, p) in enumerate(zip(lists, at, strict=True)):
                    if p < len(x[0]) and x[0][p] < target:
                        at[k] = p + int(np.searchsorted(x[0][p:], target))
                continue
            score = 0.0
            for k, (x, p) in enumerate(zip(lists, at, strict=True)):
                if p < len(x[0]) and x[0][p] < pivot:
                    p = at[k] = p + int(np.searchsorted(x[0][p:], pivot))
                if p < len(x[0]) and x[0][p] == pivot:
                    score += float(x[1][p])
                    at[k] = p + 1
            if score >= least:
                found.append((pivot, score))

    def passages(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of the passages that may hold an item, by the block bounds of their words.

        Each half of a passage counts a word once; a word in both halves counts twice, which only raises the bound.
        """
        n, stride, terms = len(ids), self.window // 2, len(self.bounds) - 1
        at = np.flatnonzero(ids >= 0)
        pairs = np.unique(at // stride * terms + ids[at])
        half, term = pairs // terms, pairs % terms
        halves = -(-n // stride)
        edge = np.searchsorted(half, np.arange(halves + 1))
        best = np.zeros(halves, np.float32)
        before = np.zeros((1, self.blocks), np.float32)  # the half before the slab
        at, most = 0, max(1, SLAB // max(1, self.blocks))
        while at < halves:
            end = min(at + most, max(at + 1, int(np.searchsorted(edge, edge[at] + most, "right")) - 1), halves)
            sums = np.zeros((end - at, self.blocks), np.float32)
            if edge[at] < edge[end]:
                present, first = np.unique(half[edge[at] : edge[end]], return_index=True)
                sums[present - at] = np.add.reduceat(self.bounds[term[edge[at] : edge[end]]], first, axis=0)
            sums = np.concatenate([before, sums])
            best[max(at - 1, 0) : end - 1] = (sums[:-1] + sums[1:]).max(axis=1)[int(at == 0) :]
            before, at = sums[-1:], end
        best[-1] = before.max(initial=0.0)
        return [(k * stride, min(n, (k + 2) * stride)) for k in np.flatnonzero(best >= THRESHOLD - 1e-4).tolist() if k + 1 < halves or halves == 1]

    def hits(self, text: str | None) -> dict[int, tuple[float, float, float, int]]:
        """By item: score, overlap of question and answer, and the first word of the passage, for the best verified passage."""
        found: dict[int, tuple[float, float, float, int]] = {}
        if not self.ids:
            return found
        words = words_of(text)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        if not len(ids) or ids.max() < 0:
            return found
        for start, end in self.passages(ids):
            terms = np.unique(ids[start:end])
            terms = terms[terms >= 0]
            if self.bounds[terms].sum(axis=0).max() < THRESHOLD - 1e-6:
                continue
            got = self.search(terms.tolist(), THRESHOLD)
            if not got:
                continue
            here = shingle_set(words[start:end]) if end - start >= SHINGLE else set()
            plain = set(words[start:end])
            for item, score in got:
                question, answer = (self._share(p, here, plain) for p in self.parts[item])
                if question >= OVERLAP and answer >= OVERLAP and score > found.get(item, (0.0,))[0]:
                    found[item] = (score, question, answer, start)
        return found

    @staticmethod
    def _share(part: set[tuple[str, ...]], here: set[tuple[str, ...]], plain: set[str]) -> float:
        """Of the part's shingles, the share found; an empty part asks for nothing, and one below three words for its words."""
        if not part:
            return 1.0
        return sum(s in here if len(s) == SHINGLE else all(w in plain for w in s) for s in part) / len(part)


_HIT = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType()), T.StructField("word", T.IntegerType())]))


_WORDS = "uid long, id long, q array<string>, a array<string>, chars long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (uid, id, text, q, a) to the words of question and answer; items without a word are left out."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            q, a = (words_of(r["q"]), words_of(r["a"])) if r["q"] is not None else split_item(r["text"] or "")
            if q or a:
                out.append({"uid": r["uid"], "id": r["id"], "q": q, "a": a, "chars": sum(map(len, q)) + sum(map(len, a))})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("uid", pa.int64()), ("id", pa.int64()), ("q", pa.list_(pa.string())), ("a", pa.list_(pa.string())), ("chars", pa.int64())]))


def indexes(items: DataFrame, id_col: str, text_col: str, question_col: str | None, answer_col: str | None) -> Iterator[tuple[Index, bool]]:
    """(index, whether it is the only one) of about SEGMENT_CHARS of item text each, one after the other, with the statistics of all items."""
    cols = [column_or_null(items, id_col, "long").alias("id"), column_or_null(items, text_col, "string").alias("text"), column_or_null(items, question_col, "string").alias("q"), column_or_null(items, answer_col, "string").alias("a")]
    rows = materialize(items.select(*cols).withColumn("uid", F.monotonically_increasing_id()).select("uid", "id", "text", "q", "a").mapInArrow(_cut, _WORDS))
    words = F.concat("q", "a")
    n, mean, longest, chars = rows.agg(F.count("*"), F.avg(F.size(words)), F.max(F.size(words)), F.sum("chars")).first()
    holders = materialize(rows.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("df")))
    parts = -(-(chars or 0) // SEGMENT_CHARS) or 1
    # Row ids deal the items out evenly, whatever repeats among them.
    parted = rows.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int"))
    for k in range(parts):
        own = parted.filter(F.col("part") == k)
        held = [(r.id, r.q, r.a) for r in own.select("uid", "id", "q", "a").orderBy("uid").collect()]
        known = own.select(F.explode(words).alias("word")).distinct().join(holders, "word").collect()
        yield Index(held, Counts(n, mean or 0.0, longest or 0, {r.word: r.df for r in known})), parts == 1


def _finder(held):
    """The function that finds the hits of a batch of texts in the broadcast index."""
    kind = pa.list_(pa.struct([("item", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("word", pa.int32())]))

    def find(texts: pa.Array) -> pa.Array:
        own = held.value
        return pa.array([[{"item": own.ids[k], "score": v[0], "question_overlap": v[1], "answer_overlap": v[2], "word": v[3]} for k, v in sorted(own.hits(t).items())] for t in texts.to_pylist()], kind)

    find.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return find


def _hits(docs: DataFrame, index: Index, text: Column) -> Column:
    """A column of docs: the array of verified (item, score, question_overlap, answer_overlap, word) of each text."""
    return F.arrow_udf(_finder(docs.sparkSession.sparkContext.broadcast(index)), _HIT)(text)


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", question_col: str | None = None, answer_col: str | None = None) -> DataFrame:
    """One row per (document, test item found in it): score, overlaps, and the word at which the passage starts. A pass for each index, no shuffle of docs."""
    out = None
    for index, _ in indexes(items, item_id_col, item_text_col, question_col, answer_col):
        rows = docs.select(column_or_null(docs, id_col, "long").alias("doc_id"), _hits(docs, index, column_or_null(docs, text_col, "string")).alias("h"))
        found = materialize(rows.select("doc_id", F.explode("h").alias("h")))
        out = found if out is None else out.unionByName(found)
    return out.select("doc_id", F.col("h.item").alias("item_id"), "h.score", "h.question_overlap", "h.answer_overlap", F.col("h.word").alias("passage_word"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", question_col: str | None = None, answer_col: str | None = None) -> DataFrame:
    """docs without those in which a test item was found; all columns. One pass where one index holds all items, else a pass for each over docs, written once."""
    rows = gone = None
    for index, alone in indexes(items, item_id_col, item_text_col, question_col, answer_col):
        if alone:
            found = docs.select(nested(docs), _hits(docs, index, column_or_null(docs, text_col, "string")).alias("__hits"))
            return materialize(found.filter(F.size("__hits") == 0).select("__row")).select(*unnested(docs))
        if rows is None:
            rows = materialize(docs.select(nested(docs), column_or_null(docs, text_col, "string").alias("__text")).withColumn("__uid", F.monotonically_increasing_id()))
        found = materialize(rows.select("__uid", _hits(rows, index, F.col("__text")).alias("h")).filter(F.size("h") > 0).select("__uid"))
        gone = found if gone is None else gone.unionByName(found)
    return drop_rows(rows, materialize(gone.distinct())).select(*unnested(docs))
