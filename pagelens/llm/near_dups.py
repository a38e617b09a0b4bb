"""Near-duplicates by order MinHash, verified by banded alignment.

A text is its lower-case word sequence; its k-mers are five-word shingles, each labelled with its occurrence number. A
sketch takes the least ELL labelled shingles under one hash order and keeps them in text order, so two texts share it
only if they share these shingles in the same order. Texts that share any of M sketches are candidates. A candidate
pair is verified by alignment within a diagonal band: the longest chain of matched labelled shingles that rises in
both texts is laid over the words, and the words that it covers give the similarity covered / (words of both - covered),
a Jaccard similarity that counts order, where one changed word costs one word and not the five shingles around it; pairs
of 0.8 or more are links, and classes are the connected components of all links.

Copies (equal word sequences) are one node from the start, named by 64 bits of their hash (two different texts out of
ten billion meet in one name with a chance of 3 %). In a bucket of texts that share a sketch, every member is compared
to the bucket's hub; members whose component then differs from another's are compared to each other, unless their
lengths rule a link out or, in a crowded bucket, the words that no shingle covers which a text of another component has
(all members of all crowded buckets are counted, so what is not shared among them is not shared in any one). There, two
texts whose words under common shingles (those of more than COMMON texts) are too few for a link need rare ones in
common besides, and are found by these: a pair that shares none is never made. So no candidate pair across components
is lost, and none within a component is made: large groups of near copies are stars around their hub, never all pairs.

Defined results: NULL and empty texts, and texts without words, are copies of each other; texts of fewer than five
words have one shingle; NULL doc_ids are kept and class_id is the least doc_id of the class that is not NULL (NULL if
there is none); rows that repeat are copies; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SHARE, column_or_null, connected_components, drop_rows, fits, lookup_join, materialize, nested, scratch, unnested

SHINGLE = 5
SIMILARITY = 0.8
#: Sketches and shingles a sketch: for texts of LONG_FROM shingles or more, and for those of fewer than SHORT_BELOW.
#: A pair whose shingles have the Jaccard similarity J shares one with a chance of about 1 - (1 - J ** ELL) ** M: words
#: changed here and there leave a J of about 0.53 in long texts at a similarity of 0.8, found with 0.93, and of 0.6 at 0.83,
#: found with 0.99; in short ones J is 0.23 or more, found with 0.92 at least. More shingles a sketch would lose more, and
#: fewer would bring unlike texts together that share a passage.
M_LONG, ELL_LONG, LONG_FROM = 32, 4, 40
M_SHORT, ELL_SHORT, SHORT_BELOW = 48, 2, 50
#: Buckets of more texts have their members' shingles counted before members meet.
LARGE = 32
#: Middles of a crowded bucket that all its members are compared to before they are compared pair by pair.
MIDDLES = 1
#: Texts of crowded buckets that a rare shingle has at most, so that pairs which share one grow with the texts.
COMMON = 16
#: Ids of texts to compare that are broadcast at most, and rows of other narrow tables (they are counted first).
USED, NARROW = 1_000_000, 200_000
#: Hashes of words that a worker keeps at most.
KEPT_WORDS = 50_000
#: Shared shingles of crowded buckets that are held by every worker at most (counted first); more are joined.
SHARED = 500_000

WORD = re.compile(r"\w+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_rng = np.random.Generator(np.random.PCG64(20240229))
_XOR = _rng.integers(0, 2**63, max(M_LONG, M_SHORT), np.uint64)
_MUL = _rng.integers(0, 2**63, max(M_LONG, M_SHORT), np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """32-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFF
        return value


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def word_ids(text: str | None) -> np.ndarray:
    """The text's words, as 32-bit hashes in order."""
    words = WORD.findall((text or "").lower()) or (text or "").split()
    return np.fromiter(map(_words.__getitem__, words), np.uint32, len(words))


def shingles(ids: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-labelled five-word shingles, in text order."""
    if not len(ids):
        return np.zeros(0, np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    if len(x) < SHINGLE:
        x = np.concatenate([x, np.zeros(SHINGLE - len(x), np.uint64)])
    n = len(x) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h += _mix(x[k : k + n] * _ODD[k]) * _ODD[k + 3]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    same = ranked[1:] == ranked[:-1]
    if same.any():
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), at, 0))
        times = np.empty(n, np.uint64)
        times[order] = (at - first).astype(np.uint64)
        h = np.where(times > 0, _mix(h + times * _ODD[0]), h)
    return h


def sketches(h: np.ndarray, m: int, ell: int) -> np.ndarray:
    """m sketches of labelled shingles: each the hash, in text order, of the ell least under its own hash order."""
    n, ell = len(h), min(ell, len(h))
    out = np.empty(m, np.uint64)
    step = max(1, 1_000_000 // max(1, n))
    for at in range(0, m, step):
        many = slice(at, min(m, at + step))
        order = (h[None, :] ^ _XOR[many, None]) * _MUL[many, None]
        least = np.argpartition(order, ell - 1, axis=1)[:, :ell] if ell < n else np.broadcast_to(np.arange(n), (order.shape[0], n)).copy()
        least.sort(axis=1)
        out[many] = _mix((_mix(h[least] * _ODD[None, :ell]) * _ODD[None, ::-1][:, :ell]).sum(axis=1, dtype=np.uint64) + _XOR[many])
    return out


def signature(h: np.ndarray) -> np.ndarray:
    """All bucket keys of a text."""
    parts = [np.zeros(0, np.uint64)]
    if 0 < len(h) < SHORT_BELOW:
        parts.append(_mix(sketches(h, M_SHORT, ELL_SHORT) ^ _ODD[5]))
    if len(h) >= LONG_FROM:
        parts.append(sketches(h, M_LONG, ELL_LONG))
    return np.concatenate(parts)


@lru_cache(maxsize=512)
def _shingles_of(raw: bytes) -> np.ndarray:
    return shingles(np.frombuffer(raw, np.uint32))


def alignment(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two word sequences: the words under the longest rising chain of matched labelled shingles within the band."""
    return _aligned(len(a), shingles(a), len(b), shingles(b))


def _longest_rise(j: np.ndarray) -> np.ndarray:
    """Indices of a longest rising subsequence of j."""
    tails: list[int] = []
    ends: list[int] = []
    before = np.full(len(j), -1)
    for at, v in enumerate(j.tolist()):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            ends.append(at)
        else:
            tails[k], ends[k] = v, at
        if k:
            before[at] = ends[k - 1]
    chain, at = [], ends[-1]
    while at >= 0:
        chain.append(at)
        at = int(before[at])
    return np.array(chain[::-1])


def _covered(starts: np.ndarray) -> int:
    """Words under shingles that begin at these rising places."""
    return int(np.minimum(np.diff(starts), SHINGLE).sum()) + SHINGLE if len(starts) else 0


def _aligned(n: int, x: np.ndarray, m: int, y: np.ndarray) -> float:
    if min(n, m) < SHINGLE:
        return float(n == m and (x == y).all())
    needed = SIMILARITY / (1 + SIMILARITY) * (n + m)
    if min(n, m) < needed:
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    band = n + m - 2 * int(needed)  # a chain that leaves it passes over more words than a link may
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if SHINGLE * len(i) < needed:
        return 0.0
    order = np.argsort(i)
    i, j = i[order], j[order]
    if (np.diff(j) < 0).any():
        chain = _longest_rise(j)
        i, j = i[chain], j[chain]
    covered = min(_covered(i), _covered(j))
    return covered / (n + m - covered)


_SKETCH = T.StructType([T.StructField("th", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("sig", T.ArrayType(T.LongType())), T.StructField("seq", T.BinaryType())])


@F.arrow_udf(_SKETCH)
def _sketch(texts: pa.Array) -> pa.Array:
    hashes, counts, sigs, seqs = [], [], [], []
    for text in texts.to_pylist():
        ids = word_ids(text)
        raw = ids.tobytes()
        h = shingles(ids)
        hashes.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True))
        counts.append(len(ids))
        sigs.append(signature(h).view(np.int64))
        seqs.append(raw)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
    sig = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *sigs])))
    return pa.StructArray.from_arrays([pa.array(hashes, pa.int64()), pa.array(counts, pa.int32()), sig, pa.array(seqs, pa.binary())], ["th", "n", "sig", "seq"])


@F.arrow_udf(T.DoubleType())
def _alignment(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([_aligned(len(x) // 4, _shingles_of(x), len(y) // 4, _shingles_of(y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.ArrayType(T.LongType()))
def _shingle_list(seqs: pa.Array) -> pa.Array:
    found = [shingles(np.frombuffer(raw, np.uint32)).view(np.int64) for raw in seqs.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))


def sketched(docs: DataFrame, text_col: str) -> DataFrame:
    """docs without the text, written once, with the row id __uid and the struct __s (text hash, number of words, signature, words)."""
    rows = docs.withColumn("__s", _sketch(column_or_null(docs, text_col, "string"))).drop(text_col)
    return materialize(rows.withColumn("__uid", F.monotonically_increasing_id()))


def _words_of(nodes: DataFrame, used: DataFrame) -> DataFrame:
    """(node, n, seq) of the used nodes; their ids are broadcast up to a bound, so that the words of others don't move."""
    used = materialize(used)
    return nodes.select("node", "n", "seq").join(F.broadcast(used) if fits(used, USED) else used, "node", "left_semi").dropDuplicates(["node"])


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links (a, b, similarity) among the distinct pairs (a, b, na, nb), written."""
    close = materialize(pairs.filter(F.least("na", "nb") >= F.greatest("na", "nb") * SIMILARITY).select("a", "b"))
    seqs = materialize(_words_of(nodes, close.select(F.col("a").alias("node")).union(close.select("b")).distinct()))
    firsts = seqs.select(F.col("node").alias("a"), F.col("seq").alias("sa"))
    one = firsts.join(F.broadcast(close), "a") if fits(close, NARROW) else lookup_join(close, firsts, "a", "inner", rows=0, spread=F.col("b"))
    both = lookup_join(materialize(one), seqs.select(F.col("node").alias("b"), F.col("seq").alias("sb")), "b", "inner", rows=0, spread=F.col("a"))
    return materialize(both.select("a", "b", _alignment("sa", "sb").alias("similarity")).filter(F.col("similarity") >= SIMILARITY))


def _pairs(rows: DataFrame, a: str, na: str, b: str, nb: str) -> DataFrame:
    """Distinct (a, b, na, nb) with a < b."""
    low, high = F.least(a, b), F.greatest(a, b)
    return rows.filter(F.col(a) != F.col(b)).select(low.alias("a"), high.alias("b"), F.when(F.col(a) == low, F.col(na)).otherwise(F.col(nb)).alias("na"), F.when(F.col(a) == low, F.col(nb)).otherwise(F.col(na)).alias("nb")).distinct()


def _mixed(members: DataFrame) -> DataFrame:
    """(k, least, size) of the buckets whose members (k, node, comp, n) are of several components; least is their least n."""
    return members.groupBy("k").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"), F.count("*").alias("size")).filter("low <> high").select("k", "least", "size")


def _reach(shared):
    """The function from words to how many of them stand under the broadcast, sorted shingles."""

    def run(seqs: pa.Array) -> pa.Array:
        known = shared.value
        out = []
        for raw in seqs.to_pylist():
            h = shingles(np.frombuffer(raw, np.uint32)).view(np.int64)
            at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            out.append(min(_covered(np.flatnonzero(known[at] == h)), len(raw) // 4) if len(known) else 0)
        return pa.array(out, pa.int32())

    run.__annotations__ = {"seqs": pa.Array, "return": pa.Array}
    return run


def _listed(crowded: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the members (node, comp) of crowded buckets the words (node, comp, seq), the shingles (node, comp, p, s), and (s, n) of the shingles of n texts that are not all of one component."""
    crowded = materialize(crowded.select("node", "comp").distinct())
    words = _words_of(nodes, crowded.select("node")).select("node", "seq").join(F.broadcast(crowded) if fits(crowded, NARROW) else crowded, "node")
    words = materialize(words.repartition("node"))
    listed = words.select("node", "comp", F.posexplode(_shingle_list("seq")).alias("p", "s"))
    several = listed.groupBy("s").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"))
    return words, listed, materialize(several.filter("low <> high").select("s", "n"))


def _under(words: DataFrame, listed: DataFrame, several: DataFrame) -> DataFrame:
    """(node, r): how many of a text's words stand under the shingles `several` (s)."""
    if fits(several, SHARED):  # passages that many texts share are few; each text is looked at beside all of them
        known = np.sort(several.toPandas()["s"].to_numpy(np.int64))
        return materialize(words.select("node", F.arrow_udf(_reach(words.sparkSession.sparkContext.broadcast(known)), T.IntegerType())("seq").alias("r")))
    places = lookup_join(materialize(listed.drop("comp")), several, "s", "inner", rows=0, spread=F.col("node")).groupBy("node").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    gaps = F.transform(F.slice(F.arrays_zip(F.slice("ps", 2, F.size("ps")).alias("b"), F.col("ps").alias("a")), 1, F.size("ps") - 1), lambda x: F.least(x["b"] - x["a"], F.lit(SHINGLE)))
    covered = materialize(places.select("node", (F.aggregate(gaps, F.lit(0), lambda total, g: total + g) + SHINGLE).alias("r")))
    return materialize(words.select("node").join(covered, "node", "left").select("node", F.coalesce("r", F.lit(0)).alias("r")))


def _shareable(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, r): of how many words of a member of a crowded bucket the shingles are found in such a member of another component."""
    words, listed, several = _listed(members.filter(F.col("size") > LARGE), nodes)
    return _under(words, listed, several.select("s"))


def _by_rare(crowded: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the members of crowded buckets (node, r), their words under common shingles, and the pairs (a, b, na, nb) of one
    bucket but of different components that share rare ones, which with the common ones may be enough for a link."""
    words, listed, several = _listed(crowded, nodes)
    common = _under(words, listed, several.filter(F.col("n") > COMMON).select("s"))
    rare = materialize(several.filter(F.col("n") <= COMMON).select("s"))
    facts = words.select("node", "comp", (F.length("seq") / 4).cast("int").alias("n")).join(common, "node")
    own = materialize(lookup_join(materialize(listed.select("node", "s")), rare, "s", "inner", rows=NARROW, spread=F.col("node")).join(facts, "node"))
    other = own.select("s", F.col("node").alias("o"), F.col("comp").alias("oc"), F.col("n").alias("on"), F.col("r").alias("or_"))
    met = own.join(other, "s").filter((F.col("node") < F.col("o")) & (F.col("comp") != F.col("oc")))
    met = met.groupBy(F.col("node").alias("a"), F.col("o").alias("b"), F.col("n").alias("na"), F.col("on").alias("nb"), F.least("r", "or_").alias("r")).agg(F.count("*").alias("shared"))
    enough = _can_link("na", F.col("r") + SHINGLE * F.col("shared"), "nb", F.col("r") + SHINGLE * F.col("shared"))
    keys = materialize(crowded.groupBy("node").agg(F.collect_list("k").alias("ks")))
    pairs = materialize(met.filter(enough).drop("r", "shared")).join(keys.select(F.col("node").alias("a"), "ks"), "a").join(keys.select(F.col("node").alias("b"), F.col("ks").alias("oks")), "b")
    return common, materialize(pairs.filter(F.arrays_overlap("ks", "oks")).select("a", "b", "na", "nb"))


def _can_link(n: str, r: str | Column, on: str, or_: str | Column) -> Column:
    """A link needs 4/9 of both texts' words in common; r and or_ are those that a text may share at all."""
    return F.least(r, or_) >= (F.col(n) + F.col(on)) * (SIMILARITY / (1 + SIMILARITY))


def _relabelled(members: DataFrame, comp: DataFrame) -> DataFrame:
    """members with their components (node, comp) now."""
    return materialize(lookup_join(members.drop("comp"), comp, "node", rows=NARROW, spread=F.col("k")).withColumn("comp", F.coalesce("comp", "node")))


#: A member of bucket k, the words that it may share, and whether it was compared to all others of the bucket.
_MEMBER = ("k", "node", "comp", "n", "r", "met")


def _still_mixed(members: DataFrame) -> DataFrame:
    """The members (k, node, comp, n, r, met) of buckets with several components, with the bucket's size now and its least n; they are read more than once, so they should be written."""
    mixed = materialize(_mixed(members))
    return materialize(lookup_join(members.select(*_MEMBER), mixed, "k", "inner", rows=NARROW, spread=F.col("node")))


def _middles(pool: DataFrame) -> DataFrame:
    """(k, hub, hn, hr, hc): of the members of each bucket the one with the fewest words that no one else has."""
    middle = pool.groupBy("k").agg(F.min(F.struct((F.col("n") - F.col("r")).alias("own"), "node", "n", "r", "comp")).alias("m"))
    return materialize(middle.select("k", F.col("m.node").alias("hub"), F.col("m.n").alias("hn"), F.col("m.r").alias("hr"), F.col("m.comp").alias("hc")))


def _centres(pool: DataFrame, reach: DataFrame, comp: DataFrame) -> DataFrame:
    """(k, hub, hn, hr, hc): of the component with the most members in each bucket the text (node, n, reach) of the greatest reach, be it in this bucket or not."""
    best = lookup_join(materialize(reach), comp, "node", rows=NARROW).withColumn("comp", F.coalesce("comp", "node"))
    best = best.groupBy("comp").agg(F.max(F.struct("reach", "node", "n")).alias("m"))
    best = materialize(best.select(F.col("comp").alias("hc"), F.col("m.node").alias("hub"), F.col("m.n").alias("hn"), F.col("m.n").alias("hr")))
    main = pool.groupBy("k", "comp").agg(F.count("*").alias("many")).groupBy("k").agg(F.max(F.struct("many", "comp")).alias("m"))
    main = materialize(main.select("k", F.col("m.comp").alias("hc")))
    return materialize(lookup_join(main, best, "hc", "inner", rows=NARROW, spread=F.col("k")).select("k", "hub", "hn", "hr", "hc"))


def _across(members: DataFrame, nodes: DataFrame, found: DataFrame, tested: DataFrame) -> DataFrame:
    """found, with the links between members (k, node, n, met, size) of one bucket but of different components.

    Where a bucket is crowded, the words are counted that a member can share with a member of another component at all, and
    members that then can link to no one are set aside. Of the rest, the one with the fewest other words is the middle of
    its bucket: all are compared to it first, and then to the middle of what is left. Those that are then not of the bucket's
    largest component are compared to that component's centre: near copies of one text share buckets in which it is not, and
    are mostly nearer to it than to each other. What is apart after that is compared where it shares rare shingles, or where
    the words under common ones alone allow a link. In other buckets every word counts as shareable, as their members were
    not all counted.
    """
    # A text is central if its buckets are large: what is near many shares sketches with many.
    reach = members.filter(F.col("size") > LARGE).groupBy("node").agg(F.min("n").alias("n"), F.sum("size").alias("reach"))
    comp = connected_components(found.select("a", "b"))
    members = _still_mixed(_relabelled(members, comp).withColumn("r", F.col("n")))
    crowded = members.filter(F.col("size") > LARGE)
    if not crowded.isEmpty():
        limited = lookup_join(crowded.drop("r"), _shareable(members, nodes), "node", "inner", rows=NARROW, spread=F.col("k"))
        limited = materialize(limited.filter(_can_link("n", "r", "least", "r")).select(*_MEMBER))
        members = _still_mixed(limited.unionByName(members.filter(F.col("size") <= LARGE).select(*_MEMBER)))
    hubs = None
    for last in [False] * MIDDLES + [True]:
        pool = members.filter(F.col("size") > LARGE)
        if pool.isEmpty():
            break
        if hubs is not None and not last:
            met = members.join(hubs.select("k", F.col("hub").alias("node")), ["k", "node"]).select("k", "comp").distinct()
            pool = pool.join(met, ["k", "comp"], "left_anti")
        middle = _centres(pool, reach, comp) if last else _middles(pool)
        hubs = middle if hubs is None else hubs.unionByName(middle)
        members = materialize(lookup_join(members, middle, "k", rows=NARROW, spread=F.col("node")))
        rows = members.filter((F.col("comp") != F.col("hc")) & _can_link("n", "r", "hn", "hr"))
        members = members.withColumn("met", F.col("met") | F.coalesce(F.col("node") == F.col("hub"), F.lit(False))).select(*_MEMBER)
        pairs = materialize(_pairs(rows, "node", "n", "hub", "hn").join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        found, tested = found.union(_verified(pairs, nodes)), tested.unionByName(pairs)
        comp = connected_components(found.select("a", "b"))
        members = _still_mixed(_relabelled(members, comp))
    # Hubs, middles and centres have met their whole bucket. Of all the other buckets that two texts share, the one with the least key
    # makes the pair.
    members = members.filter(~F.col("met"))
    crowded = materialize(members.filter(F.col("size") > LARGE))
    by_rare = None
    if not crowded.isEmpty():
        common, by_rare = _by_rare(crowded, nodes)
        limited = lookup_join(crowded.drop("r"), common, "node", "inner", rows=NARROW, spread=F.col("k"))
        limited = materialize(limited.filter(_can_link("n", "r", "least", "r")).select(*_MEMBER))
        members = _still_mixed(limited.unionByName(members.filter(F.col("size") <= LARGE).select(*_MEMBER)))
    keys = members.groupBy("node").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    members = materialize(members.select(*_MEMBER).join(keys, "node"))
    other = members.select("k", F.col("node").alias("o"), F.col("comp").alias("oc"), F.col("n").alias("on"), F.col("r").alias("or_"), F.col("ks").alias("oks"))
    apart = (F.col("node") < F.col("o")) & (F.col("comp") != F.col("oc")) & _can_link("n", "r", "on", "or_") & (F.array_min(F.array_intersect("ks", "oks")) == F.col("m.k"))
    met = members.alias("m").join(other.alias("o"), (F.col("m.k") == F.col("o.k")) & apart)
    pairs = met.select(F.col("node").alias("a"), F.col("o").alias("b"), F.col("n").alias("na"), F.col("on").alias("nb"))
    if by_rare is not None:
        pairs = pairs.unionByName(by_rare).distinct()
    return found.union(_verified(materialize(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")), nodes))


def links(nodes: DataFrame) -> DataFrame:
    """Verified links (a, b, similarity) that connect all candidate pairs; nodes, written, has (node, n, sig, seq), copies of a text alike."""
    keyed = nodes.select("node", "n", F.explode("sig").alias("k"))
    hubs = materialize(keyed.groupBy("k").agg(F.count("*").alias("size"), F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub <> last").drop("last"))
    total = nodes.agg(F.sum(F.size("sig"))).first()[0] or 0
    heavy = hubs.filter(F.col("size") * SHARE > total).select("k")
    members = materialize(lookup_join(keyed, hubs.select("k", "hub", "size"), "k", "inner", rows=0, spread=F.col("node"), heavy=heavy).distinct())
    sizes = members.filter(F.col("node") == F.col("hub")).select("hub", F.col("n").alias("hn")).distinct()
    stars = lookup_join(members.select("node", "n", "hub").distinct(), materialize(sizes), "hub", "inner", rows=NARROW, spread=F.col("node"))
    tested = materialize(_pairs(stars, "node", "n", "hub", "hn"))
    found = _verified(tested, nodes)
    # Where a bucket still holds several components, its texts are compared across them.
    members = members.select("k", "node", "n", (F.col("node") == F.col("hub")).alias("met"), "size")
    return materialize(_across(members, nodes, found, tested))


def classes(rows: DataFrame, id_col: str) -> DataFrame:
    """(th, keeper, class_id, copies, class_size) for each distinct text of the sketched rows; keeper is the __uid of the class's first document."""
    with scratch(rows.sparkSession) as scope:
        first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__uid").alias("uid")))
        texts = rows.groupBy(F.col("__s.th").alias("th")).agg(first.alias("first"), F.count("*").alias("copies"))
        nodes = rows.select(F.col("__s.th").alias("node"), F.col("__s.n").alias("n"), F.col("__s.sig").alias("sig"), F.col("__s.seq").alias("seq"))
        comp = connected_components(links(nodes).select("a", "b"))
        named = materialize(texts.join(comp.withColumnRenamed("node", "th"), "th", "left").withColumn("comp", F.coalesce("comp", "th")))
        whole = named.groupBy("comp").agg(F.min("first").alias("of_class"), F.sum("copies").alias("class_size"))
        return scope.keep(materialize(lookup_join(named, whole, "comp", "inner", spread=F.col("th")).select("th", "copies", "class_size", F.col("of_class.uid").alias("keeper"), F.col("of_class.id").alias("class_id"))))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), class_size, copies of its own words, and whether it is the one that stays."""
    wanted = docs.select(column_or_null(docs, id_col, "long").alias("doc_id"), column_or_null(docs, text_col, "string").alias("text"))
    rows = sketched(wanted, "text")
    named = classes(rows, "doc_id")
    facts = rows.select("doc_id", "__uid", F.col("__s.th").alias("th"))
    return lookup_join(facts, named, "th", "inner", spread=F.col("__uid")).select("doc_id", "class_id", "class_size", "copies", (F.col("keeper") == F.col("__uid")).alias("keeper"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one with the least doc_id, with all columns of docs."""
    rows = sketched(docs.select(nested(docs), column_or_null(docs, id_col, "long").alias("__id"), column_or_null(docs, text_col, "string").alias("__text")), "__text")
    named = classes(rows.select("__id", "__uid", "__s"), "__id")
    facts = rows.select("__uid", F.col("__s.th").alias("th"))
    gone = lookup_join(facts, named.filter("class_size > 1"), "th", "inner", spread=F.col("__uid")).filter(F.col("keeper") != F.col("__uid")).select("__uid")
    return drop_rows(rows, materialize(gone)).select(*unnested(docs))
