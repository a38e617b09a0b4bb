"""Mixing sources to target weights by balanced sampling with the cube method.

Sources get target word totals by water filling: shares in proportion to their weights, none above `most_repeats` times
its own words. Every document of a source is then taken `floor(rate)` times, and once more with the rate's fraction as
its inclusion probability. The flight phase moves these probabilities through the null space of two constraints, the
words and the documents of the source, until a few documents are undecided, two as a rule; it runs in blocks of about
BLOCK documents, whose undecided ones meet in the blocks of the next level, so a source of any size is balanced by small
tasks. Long documents are decided first, while there are short ones to make up for them, so the last ones are short. The
landing phase settles these by the choice that is nearest in words and documents; what is decided stays.

Chance comes from hashes of the rows themselves, so reruns agree, whatever the partitions (copies of a row that repeats
more than BLOCK / 4 times are told apart by their place in the written table).

Defined results: a NULL text has no words and is taken without effect; NULL sources are one source, the last; rows that
repeat are documents of their own; if there are no words at all, targets are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, column_or_null, fits, lookup_join, materialize, nested, unnested

#: Weights by the rank of the source, the share of all words that is asked for, and the most a source gives.
WEIGHTS = (5.0, 2.0, 1.0)
ASKED, MOST_REPEATS = 1.5, 2.0
#: Documents of a flight block.
BLOCK = 512
#: Splits of the documents that one task reads at most, where there are more than cores.
SPLITS = 8
_EPS = 1e-9
#: A document whose own share of the direction is below this can't move.
_STUCK = 1e-7


def uniform(seed: int, step: int) -> float:
    """A number in [0, 1) from a row's hash and the step."""
    x = (seed + 0x9E3779B97F4A7C15 * (step + 1)) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def _direction(size: np.ndarray, i: int, count: bool) -> np.ndarray:
    """Row i moved within the null space of the words, and of the number of documents if `count`: the unit vector i less its projection on the constraints."""
    u = np.zeros(len(size))
    u[i] = 1.0
    if count:
        off = size - size.mean()
        u -= 1 / len(size)
    else:
        off = size
    squared = float(off @ off)
    return u - off * (off[i] / squared) if squared > 0 else u


def flight(p: np.ndarray, size: np.ndarray, seed: np.ndarray, *, last: bool = False) -> np.ndarray:
    """Probabilities moved to 0 or 1 but for a few of the shortest documents, with the sums of p and of p * size kept.

    The longest undecided document goes first, until it is decided: each move takes it along the null space, up or down
    by chance so that no probability changes in the mean, as far as some probability reaches 0 or 1. In the last block,
    a document that can't move with both sums kept moves with the words kept.
    """
    p = np.where(p < _EPS, 0.0, np.where(p > 1 - _EPS, 1.0, p.astype(float)))
    size = size.astype(float)
    step = 0
    for i in np.lexsort((seed, -size)).tolist():
        while 0.0 < p[i] < 1.0:
            at = np.flatnonzero((p > 0.0) & (p < 1.0))
            k = int(np.searchsorted(at, i))
            u = _direction(size[at], k, True)
            if u[k] < _STUCK and last:
                u = _direction(size[at], k, False)
            if u[k] < _STUCK:
                break
            now = p[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                ups = np.where(u > 0, (1 - now) / u, np.where(u < 0, -now / u, np.inf))
                downs = np.where(u > 0, now / u, np.where(u < 0, (now - 1) / u, np.inf))
            up, down = float(ups.min()), float(downs.min())
            ahead = uniform(int(seed[i]), step) < down / (up + down)
            end = int((ups if ahead else downs).argmin())
            now = now + u * (up if ahead else -down)
            now[end] = float((u[end] > 0) == ahead)
            p[at] = np.where(now < _EPS, 0.0, np.where(now > 1 - _EPS, 1.0, now))
            step += 1
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The undecided ones, a few at most, set so that words, in units of their mean length, and documents are nearest to their sums."""
    p = p.copy()
    left = np.flatnonzero((p > 0.0) & (p < 1.0))
    unit = max(1.0, float(size[left].mean())) if len(left) else 1.0
    best = min(product((0.0, 1.0), repeat=len(left)), key=lambda z: (abs(float(((np.array(z) - p[left]) * size[left]).sum())) / unit + abs(float((np.array(z) - p[left]).sum())), z))
    p[left] = best
    return p


def _fly(last: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "seed", "uid"], ascending=[False, True, True])
        size, seed = block["size"].to_numpy(), block["seed"].to_numpy().astype(np.uint64)
        p = flight(block["p"].to_numpy(), size, seed, last=last)
        return block.assign(p=landing(p, size) if last else p)

    return run


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; 0 for NULL.

    A word and the spaces after it become one letter: regexp_count makes a string of every word, garbage for which heaps grow.
    """
    letters = F.regexp_replace(text, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")
    return F.coalesce(F.length(F.ltrim(letters, F.lit(" \t\n\x0b\x0c\r"))).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame) -> DataFrame:
    """sources, written, has (source, source_size, n_docs); adds weight and target."""
    ranked = _ranked(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    ranked = materialize(ranked)
    most = F.col("source_size") * MOST_REPEATS
    asked = (ranked.agg(F.sum("source_size")).first()[0] or 0) * ASKED
    level, capped = 0.0, -1
    while True:  # the level only rises, and each round caps more sources or is the last
        full = (most <= F.lit(level) * F.col("weight")) if capped >= 0 else F.lit(False)
        n, given, weight = ranked.agg(F.count(F.when(full, 1)), F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not weight:
            break
        level, capped = (asked - (given or 0.0)) / weight, n
    return ranked.withColumn("target", F.when(F.lit(level) * F.col("weight") >= most, most).otherwise(F.lit(level) * F.col("weight")).cast("double")).drop("rank")


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with their rank by code point, NULL last: one task for few, and range partitions with counted offsets for many."""
    from pyspark.sql import Window

    order = [F.col("source").asc_nulls_last()]
    if fits(sources, BROADCAST_ROWS):
        return sources.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)
    spread = materialize(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = spread.withColumn("__part", F.shiftright("__at", 33))
    counts = part.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return part.join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")


def _copies(rows: DataFrame) -> DataFrame:
    """(uid, source key, size, copies, ...) from written rows (uid, key, size, seed, ...): how often each document is taken.

    Only what is read more than once is written: the sources, and what each level leaves.
    """
    by_source = materialize(rows.groupBy("key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    priced = targets(by_source.select("source", "source_size", "n_docs", "key")).select("key", "source_size", "n_docs", "target")
    # A row that repeats more often than a block holds would fill blocks of any size; its copies are told apart by their row ids.
    often = materialize(rows.groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK // 4).select("seed"))
    if not often.isEmpty():
        marked = lookup_join(rows, often.withColumn("often", F.lit(True)), "seed", spread=F.col("uid"))
        rows = materialize(marked.withColumn("seed", F.when(F.col("often"), F.xxhash64("seed", "uid")).otherwise(F.col("seed"))).select(*rows.columns))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(MOST_REPEATS))).otherwise(F.lit(0.0))
    rest = lookup_join(rows, priced, "key", "inner", spread=F.col("uid")).withColumn("base", F.floor(rate).cast("long")).withColumn("p", rate - F.floor(rate)).withColumn("left", F.col("n_docs"))
    schema, many = rest.schema, priced.agg(F.max("n_docs")).first()[0] or 0
    done, level = None, 0
    while True:
        last = many <= BLOCK
        block = F.when(F.col("left") <= BLOCK, F.lit(0)).otherwise(F.pmod(F.xxhash64("seed", F.lit(level)), F.ceil(F.col("left") / BLOCK)))
        flown = materialize(rest.groupBy("key", block.alias("block")).applyInPandas(_fly(last), schema))
        if last:
            return flown if done is None else done.unionByName(flown)
        settled = flown.filter("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        open_ = flown.filter("p > 0 and p < 1").drop("left")
        left = materialize(open_.groupBy("key").agg(F.count("*").alias("left")))
        rest = lookup_join(open_, left, "key", "inner", spread=F.col("uid")).select(*schema.names)
        many = left.agg(F.max("left")).first()[0] or 0
        level += 1


def _fewer(rows: DataFrame) -> DataFrame:
    """rows of a plain scan with up to SPLITS splits in a task, but a task for every core: each task writes a file, and for each file a process is started."""
    plan = rows._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":  # to count its partitions would run its shuffles
        return rows
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-plan.execute().getNumPartitions() // SPLITS)))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = column_or_null(docs, text_col, "string")
    source = column_or_null(docs, source_col, "string")
    doc_id = column_or_null(docs, id_col, "long")
    return [doc_id.alias("doc_id"), word_count(text).alias("size"), source.alias("source"), F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("key"), F.xxhash64(doc_id, source, F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))).alias("seed")]


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: its words, its source's words and target, the copies and the words that the mix takes."""
    rows = materialize(_fewer(docs.select(*_rows(docs, id_col, text_col, source_col))).withColumn("uid", F.monotonically_increasing_id()))
    copies = (F.col("base") + F.col("p")).cast("long")
    return _copies(rows).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def apply_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every document as many times as it is taken, with all columns of docs."""
    held = materialize(docs.select(nested(docs), F.struct(*_rows(docs, id_col, text_col, source_col)).alias("__m")).withColumn("__uid", F.monotonically_increasing_id()))
    copies = _copies(held.select("__m.*", F.col("__uid").alias("uid"))).select(F.col("uid").alias("__uid"), (F.col("base") + F.col("p")).cast("int").alias("__copies")).filter("__copies > 0")
    # Merged at every size: texts move once, and no size of table is where the plan turns.
    taken = held.drop("__m").join(copies.hint("merge"), "__uid")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*unnested(docs))
