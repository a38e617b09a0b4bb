"""Secret scans by corpus-wide ownership frequency.

Fixed patterns find the base spans of each text. Besides, wider patterns propose candidates: values with a known
credential prefix, key blocks, passwords inside addresses, and long mixed tokens of high entropy. Every candidate's
hash is counted over the corpus by distinct owners and repositories. A value that many owners or many repositories share
is an example that was copied about; one that a single owner holds in few repositories, and that looks live, becomes a
span of kind `live`.

Defined results: NULL texts count as empty; rows with a NULL or repeated doc_id are kept, each judged by itself; NULL
owners and repositories count as one owner and repository named ''; an empty table gives an empty result; only the
columns named by the parameters are read, so others never clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_or_null, lookup_join, materialize

#: The base patterns, their least lengths, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)
KINDS = ("assign", "access", "hex", "live")

#: Candidates beyond the base: published credential formats, then long mixed tokens.
FORMATS = re.compile(
    r"gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}"
    r"|AIza[A-Za-z0-9_-]{35}|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----|(?<=://)[^\s/:@]{1,64}:[^\s/@]{4,128}(?=@)",
    re.ASCII,
)
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{24,}", re.ASCII)
#: Words that mark a value as a placeholder.
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|redacted|your[_-]|xxxx|0000000|1234567", re.IGNORECASE)
#: Bits a character that a mixed token must reach.
LEAST_ENTROPY = 3.2


def entropy(value: str) -> float:
    """Bits a character, by the value's own character counts."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class _Taken:
    """Disjoint spans in order, asked whether a span meets one of them."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, bool, bool]]:
    """(start, end, value, whether the span is new, whether the value looks live) of every value worth counting."""
    out = []
    for start, kind, end in base:
        value = ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]
        out.append((start, end, value, False, looks_live(value)))
    spans = [(s, e) for s, _, e in base]
    for pattern in (FORMATS, TOKEN):
        taken = _Taken(spans)  # matches of one pattern never meet each other
        for m in pattern.finditer(text):
            start, end, value = m.start(), m.end(), m[0]
            if taken.meets(start, end) or pattern is TOKEN and not (re.search("[0-9]", value) and re.search("[A-Za-z]", value) and entropy(value) >= LEAST_ENTROPY):
                continue
            spans.append((start, end))
            out.append((start, end, value, True, looks_live(value)))
    return out


def looks_live(value: str) -> bool:
    """No placeholder word, and more than a few distinct characters."""
    return not PLACEHOLDER.search(value) and len(set(value)) >= 6


_ROWS = pa.schema(
    [("doc_id", pa.int64()), ("owner", pa.string()), ("repo", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string())]
    + [("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))), ("cand", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("new", pa.bool_()), ("live", pa.bool_())])))]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, owner, repo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            base = base_spans(text)
            kinds = Counter(k for _, k, _ in base)
            digest = hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
            cand = [{"start": s, "end": e, "value": hashlib.blake2b(v.encode(), digest_size=16).hexdigest(), "new": n, "live": live} for s, e, v, n, live in candidates(text, base)]
            rows.append({"doc_id": doc_id, "owner": owner, "repo": repo, "n_assign": kinds[0], "n_access": kinds[1], "n_hex": kinds[2], "base_sha256": digest, "base": [{"start": s, "kind": k, "end": e} for s, k, e in base], "cand": cand})
        yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "source", example_owners: int = 3, example_repos: int = 4) -> DataFrame:
    """One row per document: base counts and digest, all spans, and how the corpus holds its candidate values.

    A candidate value held by `example_owners` owners or `example_repos` repositories or more, or marked as a
    placeholder, is an example. A value of one owner that looks live and is no example is owner-specific; where no base
    span covers it, it is added as a `live` span. What two owners share in few repositories is neither.
    """
    rows = docs.select(column_or_null(docs, id_col, "long").alias("doc_id"), column_or_null(docs, text_col, "string").alias("text"), F.coalesce(column_or_null(docs, owner_col, "string"), F.lit("")).alias("owner"), F.coalesce(column_or_null(docs, repo_col, "string"), F.lit("")).alias("repo"))
    schema = "doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, cand array<struct<start:int,end:int,value:string,new:boolean,live:boolean>>"
    scanned = materialize(rows.mapInArrow(_scan, schema).withColumn("uid", F.monotonically_increasing_id()))
    held = scanned.select("uid", "owner", "repo", F.explode("cand").alias("c")).select("uid", "owner", "repo", "c.*")
    # Counts first by owner and repository, so that a value copied a billion times is few rows by then.
    by_holder = held.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
    values = materialize(by_holder.groupBy("value").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("owner", "repo").alias("n_repos")))
    judged = lookup_join(held.select("uid", "value", "start", "end", "new", "live"), values, "value", "inner", spread=F.col("uid"))
    example = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos) | ~F.col("live")
    own = ~example & (F.col("n_owners") == 1)
    by_doc = judged.groupBy("uid").agg(
        F.sum(own.cast("long")).alias("n_owner_specific"),
        F.sum(example.cast("long")).alias("n_examples"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repos").alias("most_repos"),
        F.collect_list(F.when(own & F.col("new"), F.struct("start", F.lit(KINDS.index("live")).alias("kind"), "end"))).alias("extra"),
    )
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    zero = F.lit(0).cast("long")
    return scanned.drop("owner", "repo", "cand").join(by_doc, "uid", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.coalesce("n_owner_specific", zero).alias("n_owner_specific"), F.coalesce("n_examples", zero).alias("n_examples"), F.coalesce("most_owners", zero).alias("most_owners"), F.coalesce("most_repos", zero).alias("most_repos"))
