"""Similarity of short texts by the longest-matching-blocks ratio of the standard library, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: str | None, b: str | None) -> float:
    """0 if one is empty, else twice the matched characters over all characters."""
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def fold(text: str | None) -> str:
    """Lower case without accents; underscores, hyphens and white space become single spaces."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return re.sub(r"[_\-\s]+", " ", plain.lower()).strip()


def text_ratio(a: Column, b: Column) -> Column:
    @F.arrow_udf(T.DoubleType())
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([ratio(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return run(a, b)


def folded(text: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def run(x: pa.Array) -> pa.Array:
        return pa.array([fold(t) for t in x.to_pylist()], pa.string())

    return run(text)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """1 for texts equal but for case and outer white space, 0.92 if one holds the other, else the ratio; 0 if one is empty."""
    x, y = F.trim(F.lower(F.coalesce(a, F.lit("")))), F.trim(F.lower(F.coalesce(b, F.lit(""))))
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.92).otherwise(text_ratio(x, y))
