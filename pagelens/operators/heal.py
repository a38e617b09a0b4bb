"""Finding elements again: candidates scored by label and attributes, simple selectors checked offline, and a keyed cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.similarity import fuzzy_ratio
from ..functions.text import squeeze

#: Weight of the label, bonuses of attributes, and the least score and most candidates kept.
TEXT_WEIGHT, BONUS = 0.7, {"has_testid": 0.3, "has_id": 0.2, "has_name": 0.2, "has_aria": 0.25}
LEAST_SCORE, MOST = 0.35, 10


def score(label: Column, candidate: Column) -> Column:
    """Of a candidate with the flags has_testid, has_id, has_name and has_aria; 1 at most."""
    total = fuzzy_ratio(label, candidate) * TEXT_WEIGHT
    for name, bonus in BONUS.items():
        total = total + F.when(F.coalesce(name, F.lit(False)), bonus).otherwise(0.0)
    return F.least(F.lit(1.0), total)


def rank(wanted: DataFrame, candidates: DataFrame, *, key: str = "request_id", join_on: str = "page_id") -> DataFrame:
    """Per request (key, join_on, label) its ten best candidates (join_on, pos, selector, candidate_label, flags) by score."""
    rows = wanted.select(key, join_on, "label").join(candidates, join_on).withColumn("score", score(F.col("label"), F.col("candidate_label"))).filter(F.col("score") >= LEAST_SCORE)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "pos"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= MOST)


def candidates(nodes: DataFrame) -> DataFrame:
    """Interactive nodes of pages as candidates: the most specific simple selector, the label from attributes or text, and flags."""
    a = F.col("attrs")
    has = lambda name: F.coalesce(a[name], F.lit("")) != ""
    selector = F.when(has("data-testid"), F.concat(F.lit('[data-testid="'), a["data-testid"], F.lit('"]'))).when(has("id"), F.concat(F.lit("#"), a["id"])).when(has("name"), F.concat("tag", F.lit('[name="'), a["name"], F.lit('"]'))).when(has("class"), F.concat("tag", F.lit("."), F.element_at(F.split(F.trim(a["class"]), r"\s+"), 1))).otherwise(F.col("tag"))
    label = F.coalesce(*[F.when(has(n), squeeze(a[n])) for n in ("aria-label", "placeholder")], F.when(squeeze(F.col("text")) != "", squeeze(F.col("text"))), *[F.when(has(n), squeeze(a[n])) for n in ("name", "alt", "value")], F.lit(""))
    rows = nodes.filter(F.col("tag").isin("a", "button", "input", "select", "textarea") | (a["role"] == "button") | F.map_contains_key("attrs", "onclick"))
    return rows.select("page_id", F.col("node_id").alias("pos"), "tag", selector.alias("selector"), label.alias("candidate_label"), has("data-testid").alias("has_testid"), has("id").alias("has_id"), has("name").alias("has_name"), has("aria-label").alias("has_aria"))


def matches(selector: Column) -> Column:
    """Whether a node (tag, attrs) is met by a simple selector: #id, [attr="v"], tag[attr="v"], tag.class or tag."""
    a, tag = F.col("attrs"), F.regexp_extract(selector, r"^([A-Za-z][\w-]*)", 1)
    attr, value = F.regexp_extract(selector, r"\[([\w-]+)=", 1), F.regexp_extract(selector, r'=["\']?([^"\'\]]*)["\']?\]', 1)
    by_id, by_class = F.regexp_extract(selector, r"#([\w-]+)", 1), F.regexp_extract(selector, r"\.([\w-]+)", 1)
    ok = ((tag == "") | (F.col("tag") == F.lower(tag))) & ((by_id == "") | (F.coalesce(a["id"], F.lit("")) == by_id))
    ok &= (attr == "") | (F.coalesce(F.try_element_at(a, attr), F.lit("")) == value)
    plain = F.when(attr == "", by_class).otherwise("")
    return ok & ((plain == "") | F.array_contains(F.split(F.coalesce(a["class"], F.lit("")), r"\s+"), plain))


def verify(requests: DataFrame, nodes: DataFrame, *, key: str = "request_id") -> DataFrame:
    """Per request (key, page_id, selector, label, action_type): how many nodes the selector meets, and whether the first is
    the element: one to three matches, and a like label, or for an empty label the same tag."""
    met = requests.select(key, "page_id", "selector", "label", "action_type").join(nodes, "page_id").filter(matches(F.col("selector")))
    a = F.col("attrs")
    own = F.coalesce(F.when(F.coalesce(a["aria-label"], F.lit("")) != "", squeeze(a["aria-label"])), F.when(squeeze(F.col("text")) != "", squeeze(F.col("text"))), squeeze(a["placeholder"]))
    first = met.groupBy(key).agg(F.count("*").alias("n_matches"), F.min_by(F.struct("tag", own.alias("own"), "label", "action_type"), "node_id").alias("f"))
    like = F.when(F.coalesce("f.label", F.lit("")) == "", F.col("f.tag") == F.substring_index(F.lower("f.action_type"), "[", 1)).otherwise(fuzzy_ratio(F.col("f.label"), F.col("f.own")) >= 0.5)
    out = requests.select(key).join(first, key, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0).cast("long")))
    return out.select(key, "n_matches", (F.col("n_matches").between(1, 3) & F.coalesce(like, F.lit(False))).alias("verified"))


def heal(wanted: DataFrame, pages_nodes: DataFrame, cache: DataFrame | None = None, *, threshold: float = 0.85, key: str = "request_id") -> DataFrame:
    """Per request (key, page_id, url, label, action_type) a selector: from the cache, else the best verified candidate of that score."""
    best = rank(wanted, candidates(pages_nodes), key=key).filter(F.col("score") >= threshold)
    tried = best.select(F.concat_ws(":", key, "rank").alias("try"), key, "page_id", "selector", "rank", "score").join(wanted.select(key, "label", "action_type"), key)
    checked = tried.join(verify(tried, pages_nodes, key="try"), "try").filter("verified")
    found = checked.groupBy(key).agg(F.min_by(F.struct("selector", "score"), "rank").alias("f")).select(key, "f.selector", "f.score", F.lit("local").alias("source"))
    if cache is None:
        return found
    known = wanted.withColumn("cache_key", cache_key(F.col("url"), F.col("label"), F.col("action_type"))).join(cache.select("cache_key", "selector"), "cache_key")
    known = known.select(key, "selector", F.lit(1.0).alias("score"), F.lit("cache").alias("source"))
    return known.unionByName(found.join(known.select(key), key, "left_anti"))


def cache_key(url: Column, label: Column, action_type: Column) -> Column:
    """host|path|tag|label"""
    host, path = urls.authority(url), urls.path(url)
    tag = F.lower(F.substring_index(action_type, "[", 1))
    return F.concat_ws("|", F.when(host == "", "local").otherwise(host), F.when(path == "", "/").otherwise(path), tag, F.lower(squeeze(label)))


def latest_cache(log: DataFrame, *, key: str = "cache_key") -> DataFrame:
    """The cache after a log of writes: log has key, at, selector; the last write of a key counts, and a NULL selector removes it."""
    last = log.groupBy(key).agg(F.max_by(F.struct("selector"), F.col("at")).alias("l"))
    return last.select(key, F.col("l.selector").alias("selector")).filter("selector is not null")
