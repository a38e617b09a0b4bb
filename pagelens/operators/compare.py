"""Comparing sites by their features: what others have that one lacks, and the other way round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the pieces that texts are looked up by.
PIECE = 3


def _pieces(text: Column, least: int) -> Column:
    """The distinct substrings of `least` to PIECE characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    every = F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(text, i, F.lit(n)) for n in range(least, PIECE + 1)])))
    return F.array_distinct(F.filter(every, lambda p: F.length(p) >= least))


def containments(holders: DataFrame, held: DataFrame) -> DataFrame:
    """(holder, held) of the distinct labels (label) of both tables where the one's text holds the other's.

    A held label is looked up by its rarest piece of PIECE characters (by itself if it is shorter), an equality that joins
    by hash; only what shares that piece is compared.
    """
    where = holders.select(F.col("label").alias("holder"), F.explode(_pieces(F.col("label"), 1)).alias("piece"))
    often = where.groupBy("piece").agg(F.count("*").alias("n"))
    own = F.when(F.length("label") <= PIECE, F.array("label")).otherwise(_pieces(F.col("label"), PIECE))
    asked = held.select(F.col("label").alias("held"), F.explode(own).alias("piece")).join(often, "piece", "left")
    rarest = asked.groupBy("held").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
    return rarest.join(where, "piece").filter(F.contains("holder", F.col("held"))).select("holder", "held")


def gaps(features: DataFrame, own_site: str, *, most: int = 15) -> DataFrame:
    """features has site and label. Rows (kind, label, sites): `missing` labels of other sites that own_site covers with none
    of its own, and `unique` ones that no other site covers; the first `most` of each in order of label.

    A label covers another if one holds the other, in lower case.
    """
    rows = features.select("site", F.lower(F.trim("label")).alias("label")).filter("label <> ''").distinct()
    mine, other = rows.filter(F.col("site") == own_site).select("label").distinct(), rows.filter(F.col("site") != own_site)
    each = other.groupBy("label").agg(F.count_distinct("site").alias("sites"))
    theirs = each.select("label")
    met = containments(theirs, mine).select(F.col("holder").alias("theirs"), F.col("held").alias("mine"))
    met = met.unionByName(containments(mine, theirs).select(F.col("holder").alias("mine"), F.col("held").alias("theirs")))
    missing = each.join(met.select(F.col("theirs").alias("label")).distinct(), "label", "left_anti").select(F.lit("missing").alias("kind"), "label", "sites")
    unique = mine.join(met.select(F.col("mine").alias("label")).distinct(), "label", "left_anti").select(F.lit("unique").alias("kind"), "label", F.lit(1).cast("long").alias("sites"))
    first = lambda df: df.orderBy("label").limit(most)
    return first(missing).unionByName(first(unique))
