"""Sharding by jump consistent hashing, in DataFrame functions only.

The published generator (a 64-bit linear congruential step, whose high 31 bits choose the next jump) runs as a fold
over long arithmetic: products are taken modulo 2^64 by 16-bit limbs, as a plain product would overflow. A key's jumps
are few (about the logarithm of the shard count), no ring table exists, and one more shard takes rows only into itself.

Defined results: a NULL key counts as a fixed key of its own; equal keys share a shard; NULL texts have size 1 and the
checksum of the empty text; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_or_null, materialize

#: The published multiplier, 2862933555777941757, as 16-bit limbs, low first.
MULTIPLIER = 2862933555777941757
_LOW, _HIGH = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32
#: Jumps after which a key must have settled. The count of jumps has mean log(shards); 300 of them are beyond any key.
MOST_JUMPS = 300


def _times(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + 1 modulo 2^64, on unsigned 32-bit halves held in longs."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    p0, p1 = lo * (_LOW & 0xFFFF), lo * (_LOW >> 16)
    low = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF).cast("long")), 16) + 1
    carry = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(p1, 16)
    part = lambda x, k: x * (k & 0xFFFF) + F.shiftleft((x * (k >> 16)).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
    return (carry + part(hi, _LOW) + part(lo, _HIGH)).bitwiseAND(mask), low.bitwiseAND(mask)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a long key (taken as unsigned 64 bits). NULL keys count as 0."""
    if shards < 1:
        raise ValueError("there must be one shard at least")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    long = lambda v: F.lit(v).cast("long")
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(long(0xFFFFFFFF)).alias("lo"), long(-1).alias("b"), long(0).alias("j"))

    def step(s: Column, _: Column) -> Column:
        hi, lo = _times(s["hi"], s["lo"])
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(hi, 1) + 1).cast("double"))).cast("long")
        going = s["j"] < shards
        return F.struct(*[F.when(going, new).otherwise(s[n]).alias(n) for n, new in (("hi", hi), ("lo", lo), ("b", s["j"]), ("j", jump))])

    end = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS))), start, step)
    if shards <= MOST_JUMPS:  # every jump goes at least one shard ahead
        return F.aggregate(F.array(end), long(0), lambda _, s: s["b"]).cast("int")
    return F.aggregate(F.array(end), long(0), lambda _, s: F.when(s["j"] >= shards, s["b"]).otherwise(F.raise_error(F.lit("a key has not settled")).cast("long"))).cast("int")


def stable_key(key: Column) -> Column:
    """A well mixed long for any key; the same for equal keys, whatever the table."""
    return F.xxhash64(key.cast("string"))


def with_shard(docs: DataFrame, shards: int, *, id_col: str = "doc_id", shard_col: str = "shard") -> DataFrame:
    """docs with the shard of each row's key as column `shard_col` (replacing one of that name). No shuffle."""
    return docs.withColumn(shard_col, jump_hash(stable_key(column_or_null(docs, id_col, "string")), shards))


def shard_rows(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: size, checksum, shard, the slot within its shard, and the shard if there were one more.

    Slots count from 0 without gaps. They are numbered per (input split, shard), and each such pair starts where the
    pairs before it end; so no task sorts more than a split's rows, whatever keys or shards are hot.
    """
    text = F.encode(F.coalesce(column_or_null(docs, text_col, "string"), F.lit("")), "UTF-8")
    key = stable_key(F.col("doc_id"))
    rows = docs.select(column_or_null(docs, id_col, "long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = materialize(rows.select("*", jump_hash(key, shards).alias("shard"), jump_hash(key, shards + 1).alias("grown_shard"), F.spark_partition_id().alias("split")))
    return number_slots(rows, shards).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def number_slots(rows: DataFrame, shards: int) -> DataFrame:
    """`rows` (written, with shard and split) with the long column slot, gapless from 0 within each shard."""
    from pyspark.sql import Window

    counts = rows.groupBy("shard", "split").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "split", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("first"))
    within = Window.partitionBy("shard", "split").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("__row", F.row_number().over(within)).join(first, ["shard", "split"]).withColumn("slot", F.col("first") + F.col("__row") - 1).drop("first", "__row", "split")
