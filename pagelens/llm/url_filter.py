"""URL filters: rules first, then the templates of each host's paths judged by their smoothed labelled purity.

Every path becomes a template: digits become {n}, and then, depth by depth below each host, a segment becomes * where a
parent has many different children and most urls bring a new one. Then, depth by depth again, sibling branches that go on
are merged into {~} where they are alike: a chi-square test finds the shapes below a branch spread as below its siblings,
and, where a branch and its siblings both have labels, a test of two proportions finds these alike too. Odd branches are
set aside, the worst first, until those left are alike. So a branch without labels is judged with those built as it is.

Labels are the verdicts of the rules: a url that a rule decides counts as labelled in its template. Purity is the share of
blocked among labelled urls, smoothed from the corpus to the registered domain, the host, the template's parent and the
template: each level has SMOOTH urls of what the level above says, half way back to one half. Urls without a rule are
blocked if their template's purity is REJECT or more; so no url is blocked by what lies above its template alone.

DataFrame functions only. Trees are built from counts per (host, path shape), never from a host's rows.

Defined results: a NULL url, or one without ://, has empty host and path and is allowed; a NULL or repeated page_id is
judged by itself; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_or_null, lookup_join, materialize

#: The rules as (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Levels of the SQL below, and its rounds of setting odd branches aside. The operator itself goes on as far as there is something to do.
DEPTHS, ROUNDS = 3, 5
#: Different children of a parent, and their share of its urls, from which on children are variable.
MANY, NEW_SHARE = 20, 0.3
#: Branches are alike below this z of the two-proportion test, and of the chi-square test (by the cube root approximation).
ALIKE = 1.96
#: Least urls of a branch whose shapes are compared.
LEAST_URLS = 8
#: Urls that the level above counts for, and how far its departure from one half carries down.
SMOOTH, CARRY = 2.0, 0.5
#: Purity from which on a template is rejected.
REJECT = 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, in lower case, and path of a url; both empty without ://."""
    after = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or NULLs. Rules are tried one by one: for lists of hundreds."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _templates(shapes: DataFrame) -> DataFrame:
    """(id, template, labelled, blocked) from counts (id, host, shape, n, labelled, blocked) per host and path shape."""
    tree = shapes.withColumn("seg", F.split("shape", "/")).withColumn("prefix", F.col("host"))
    depth = 0
    # A parent has no more children than path shapes that go on: where none has MANY of these, nothing further down is variable.
    while not tree.filter(F.size("seg") > depth + 1).groupBy(F.md5("prefix")).count().filter(F.col("count") >= MANY).isEmpty():
        depth += 1
        here = F.try_element_at("seg", F.lit(depth + 1))
        tree = materialize(tree.withColumn("here", here).withColumn("parent", F.md5("prefix")))
        # Children first, then parents: a parent with any number of children is summed before it is shuffled.
        children = tree.filter("here is not null").groupBy("parent", "here").agg(F.sum("n").alias("n"))
        parents = children.groupBy("parent").agg(F.count("*").alias("kinds"), F.sum("n").alias("urls"))
        wide = materialize(parents.filter((F.col("kinds") >= MANY) & (F.col("kinds") >= F.col("urls") * NEW_SHARE)).select("parent", F.lit(True).alias("wide")))
        tree = lookup_join(tree, wide, "parent", spread=F.xxhash64("id"))
        step = F.when(F.col("wide") & F.col("here").isNotNull(), F.lit("*")).otherwise(F.col("here"))
        tree = tree.withColumn("prefix", F.when(step.isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), step))).drop("here", "wide", "parent")
    tail = F.array_join(F.slice("seg", depth + 2, F.greatest(F.size("seg"), F.lit(1))), "/")
    return materialize(tree.withColumn("template", F.when(F.size("seg") > depth + 1, F.concat("prefix", F.lit("/"), tail)).otherwise(F.col("prefix"))).select("id", "host", "template", "n", "labelled", "blocked"))


def _limit(dof: Column) -> Column:
    """The chi-square value that ALIKE standard deviations reach, by the cube root approximation."""
    spread = F.lit(2.0) / (F.lit(9.0) * dof)
    return dof * F.pow(F.lit(1.0) - spread + F.lit(ALIKE) * F.sqrt(spread), F.lit(3.0))


def _compared(cells: DataFrame) -> DataFrame:
    """Each child of a parent against all its siblings, from written counts (pk, ck, tail, n, labelled, blocked) of the shapes below: (pk, ck, sums, ratio), ratio being chi-square by its limit, NULL where there is nothing to compare."""
    cells = cells.withColumn("tk", F.md5(F.concat("pk", F.lit("\n"), "tail")))
    tails = materialize(cells.groupBy("tk", "pk").agg(F.sum("n").alias("n_tail")))
    shared = lookup_join(cells, tails.select("tk", "n_tail"), "tk", "inner", spread=F.xxhash64("ck"))
    children = materialize(shared.groupBy("pk", "ck").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.sum(F.col("n") * F.col("n") / F.col("n_tail")).alias("met")))
    parents = children.groupBy("pk").agg(F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    parents = materialize(parents.join(tails.groupBy("pk").agg(F.count("*").alias("n_tails")), "pk"))
    joined = lookup_join(children, parents, "pk", "inner", spread=F.xxhash64("ck"))
    n, rest = F.col("n"), F.col("all_n") - F.col("n")
    # The sum over shapes of (seen - expected)^2 / expected, of the child against all its siblings.
    chi2 = (F.col("met") * F.col("all_n") / n - n) * F.col("all_n") / rest
    ratio = F.when((rest > 0) & (F.col("n_tails") > 1), chi2 / _limit((F.col("n_tails") - 1).cast("double")))
    return materialize(joined.withColumn("ratio", ratio))


def _alike(cells: DataFrame) -> DataFrame:
    """(pk, ck) of the children to merge, from written counts (pk, ck, tail, n, labelled, blocked) of the shapes below each child ck of a parent pk.

    While some children are not alike, the worst of them (those at or above the mean) are set aside, so that odd branches don't
    keep the others from being merged.
    """
    enough = materialize(cells.groupBy("ck").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_URLS).select("ck"))
    cells = materialize(lookup_join(cells, enough, "ck", "inner", spread=F.xxhash64("tail")))
    while True:
        children = _compared(cells)
        bad = children.filter("ratio > 1").select("pk", "ck", "ratio")
        if bad.isEmpty():
            break
        bound = materialize(bad.groupBy("pk").agg(F.least(F.avg("ratio"), F.max("ratio")).alias("bound")))
        gone = materialize(lookup_join(bad, bound, "pk", "inner", spread=F.xxhash64("ck")).filter("ratio >= bound").select("ck", F.lit(True).alias("gone")))
        cells = materialize(lookup_join(cells, gone, "ck", spread=F.xxhash64("tail")).filter("gone is null").drop("gone"))
    others = F.col("all_labelled") - F.col("labelled")
    rate = F.col("all_blocked") / F.col("all_labelled")
    gap = F.col("blocked") / F.col("labelled") - (F.col("all_blocked") - F.col("blocked")) / others
    agree = F.when((F.col("labelled") > 0) & (others > 0), gap * gap <= ALIKE * ALIKE * rate * (1 - rate) * (1 / F.col("labelled") + 1 / others)).otherwise(F.lit(True))
    return children.filter(F.col("ratio").isNotNull() & agree).select("pk", "ck")


def _merged(named: DataFrame) -> DataFrame:
    """(template, merged) with alike sibling branches merged, from the host down."""
    path = F.expr("substring(template, length(host) + 1)")
    tree = named.groupBy("template", "host").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    tree = materialize(tree.select("*", F.split(path, "/").alias("seg"), F.col("host").alias("prefix")))
    depth = 0
    while True:
        depth += 1
        # What goes on below its segment of this depth, as children of the path above.
        tree = tree.withColumn("pk", F.md5("prefix")).withColumn("here", F.try_element_at("seg", F.lit(depth + 1)))
        tree = materialize(tree.withColumn("ck", F.md5(F.concat("prefix", F.lit("/"), "here"))))
        below = tree.filter(F.size("seg") > depth + 1)
        # What a path holds is no less than what those below it hold: where none has enough to compare, none further down has.
        if below.groupBy("pk").agg(F.count("*").alias("k"), F.sum("n").alias("n")).filter((F.col("k") > 1) & (F.col("n") >= 2 * LEAST_URLS)).isEmpty():
            break
        tail = F.array_join(F.slice("seg", depth + 2, F.size("seg")), "/")
        cells = below.groupBy("pk", "ck", tail.alias("tail")).agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
        alike = materialize(_alike(materialize(cells)))
        several = materialize(alike.groupBy("pk").agg(F.count("*").alias("k")).filter("k > 1").select("pk"))
        alike = materialize(lookup_join(alike, several, "pk", "inner", spread=F.xxhash64("ck")).select("ck", F.lit(True).alias("alike")))
        tree = lookup_join(tree, alike, "ck", spread=F.xxhash64("template"))
        step = F.when(F.col("alike") & (F.size("seg") > depth + 1), F.lit("{~}")).otherwise(F.col("here"))
        tree = tree.withColumn("prefix", F.when(step.isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), step))).drop("here", "pk", "ck", "alike")
    rest = F.array_join(F.slice("seg", depth + 1, F.greatest(F.size("seg"), F.lit(1))), "/")
    whole = F.when(F.size("seg") > depth, F.concat("prefix", F.lit("/"), rest)).otherwise(F.col("prefix"))
    return materialize(tree.select("template", "host", whole.alias("merged"), "labelled", "blocked"))


def _level(rows: DataFrame, key: str) -> DataFrame:
    """(key, labelled, purity) from counts (key, labelled, blocked) with the purity of the level above as above_purity."""
    prior = 0.5 + CARRY * (F.col("above_purity") - 0.5)
    sums = rows.groupBy(key).agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.first("above_purity").alias("above_purity"))
    return materialize(sums.select(key, "labelled", ((F.col("blocked") + SMOOTH * prior) / (F.col("labelled") + SMOOTH)).alias("purity")))


def _purity(named: DataFrame) -> DataFrame:
    """(id, template, labelled, purity) with alike branches merged."""
    merged = _merged(named)
    facts = merged.groupBy("host", "merged").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    parent = F.concat("host", F.regexp_replace(F.expr("substring(merged, length(host) + 1)"), "/[^/]*$", ""))
    facts = materialize(facts.select("*", parent.alias("parent"), F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1).alias("domain"), F.lit("").alias("corpus"), F.lit(0.5).alias("above_purity")))
    levels = ["corpus", "domain", "host", "parent", "merged"]
    found = None
    for above, key in zip(["corpus", *levels], levels, strict=False):
        if found is not None:
            facts = lookup_join(facts.drop("above_purity"), found.select(F.col(above), F.col("purity").alias("above_purity")), above, "inner", spread=F.xxhash64("merged"))
        found = _level(facts, key)
    of = materialize(lookup_join(merged.select("template", "merged"), found, "merged", "inner", spread=F.xxhash64("template")))
    return lookup_join(named.select("id", "template"), of, "template", spread=F.xxhash64("id")).select("id", F.col("merged").alias("template"), "labelled", "purity")


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """One row per page: host, path, rule, verdict, and the template with its labelled urls and purity."""
    rows = pages.select(column_or_null(pages, id_col, "long").alias("page_id"), F.coalesce(column_or_null(pages, url_col, "string"), F.lit("")).alias("__url"))
    host, path = host_and_path(F.col("__url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    shape = F.regexp_replace(F.translate(F.col("path"), string.ascii_uppercase, string.ascii_lowercase), "[0-9]+", "{n}")
    rows = materialize(rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), shape.alias("shape"), F.md5(F.concat("host", F.lit("\n"), shape)).alias("id")))
    block = F.lit("block")
    shapes = rows.groupBy("id", "host", "shape").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == block, 1)).alias("blocked"))
    purity = materialize(_purity(_templates(materialize(shapes))))
    out = lookup_join(rows, purity, "id", spread=F.xxhash64("page_id"))
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= REJECT, block).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "labelled", "purity")


#: The same in DuckDB SQL, one template level after the other.
ORACLE_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(after, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
         regexp_replace(translate(path, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[0-9]+', '{{n}}', 'g') AS shape FROM parts),
judged AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruling FROM ruled),
t0 AS (
  SELECT host, shape, string_split(shape, '/') AS seg, host AS prefix, count(*) AS n, count(ruling) AS labelled,
         count(*) FILTER (WHERE ruling = 'block') AS blocked FROM judged GROUP BY host, shape),
{
    "".join(
        f'''w{d} AS (
  SELECT prefix, count(DISTINCT seg[{d + 1}]) AS kinds, sum(n) AS urls FROM t{d - 1} WHERE len(seg) >= {d + 1} GROUP BY prefix),
t{d} AS (
  SELECT t.host, t.shape, t.seg, t.n, t.labelled, t.blocked,
         CASE WHEN len(t.seg) < {d + 1} THEN t.prefix
              WHEN w.kinds >= {MANY} AND w.kinds >= w.urls * {NEW_SHARE} THEN t.prefix || '/*'
              ELSE t.prefix || '/' || t.seg[{d + 1}] END AS prefix
  FROM t{d - 1} t LEFT JOIN w{d} w ON t.prefix = w.prefix),
'''
        for d in range(1, DEPTHS + 1)
    )
}named AS (
  SELECT host, shape, n, labelled, blocked,
         CASE WHEN len(seg) > {DEPTHS + 1} THEN prefix || '/' || array_to_string(seg[{DEPTHS + 2}:], '/') ELSE prefix END AS template FROM t{DEPTHS}),
m0 AS (
  SELECT template, host, string_split(substr(template, length(host) + 1), '/') AS seg, host AS prefix,
         sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM named GROUP BY template, host),
{
    "".join(
        f'''c{d} AS (
  SELECT prefix, seg[{d + 1}] AS child, array_to_string(seg[{d + 2}:], '/') AS tail, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked
  FROM m{d - 1} WHERE len(seg) > {d + 1} GROUP BY ALL),
o{d}_0 AS MATERIALIZED (
  SELECT * FROM c{d} QUALIFY sum(n) OVER (PARTITION BY prefix, child) >= {LEAST_URLS}),
''' + "".join(f'''k{d}_{r} AS (
  SELECT prefix, child, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked, sum(n * n / n_tail) AS met
  FROM (SELECT *, sum(n) OVER (PARTITION BY prefix, tail) AS n_tail FROM o{d}_{r}) GROUP BY prefix, child),
a{d}_{r} AS (
  SELECT k.*, sum(k.n) OVER w AS all_n, sum(k.labelled) OVER w AS all_labelled, sum(k.blocked) OVER w AS all_blocked, t.n_tails
  FROM k{d}_{r} k JOIN (SELECT prefix, count(DISTINCT tail) AS n_tails FROM o{d}_{r} GROUP BY prefix) t ON k.prefix = t.prefix WINDOW w AS (PARTITION BY k.prefix)),
j{d}_{r} AS MATERIALIZED (
  SELECT *, CASE WHEN all_n > n AND n_tails > 1 THEN (met * all_n / n - n) * all_n / (all_n - n)
    / ((n_tails - 1) * pow(1.0 - 2.0 / (9.0 * (n_tails - 1)) + {ALIKE} * sqrt(2.0 / (9.0 * (n_tails - 1))), 3)) END AS ratio FROM a{d}_{r}),
g{d}_{r} AS (
  SELECT prefix, child FROM (SELECT *, least(avg(ratio) OVER w, max(ratio) OVER w) AS bound FROM j{d}_{r} WHERE ratio > 1 WINDOW w AS (PARTITION BY prefix)) WHERE ratio >= bound),
o{d}_{r + 1} AS MATERIALIZED (
  SELECT o.* FROM o{d}_{r} o ANTI JOIN g{d}_{r} g ON o.prefix = g.prefix AND o.child = g.child),
''' for r in range(ROUNDS)) + f'''s{d} AS (
  SELECT prefix, child, count(*) OVER (PARTITION BY prefix) AS mates FROM j{d}_{ROUNDS - 1}
  WHERE ratio IS NOT NULL
    AND CASE WHEN labelled > 0 AND all_labelled > labelled THEN
          pow(blocked / labelled - (all_blocked - blocked) / (all_labelled - labelled), 2)
          <= {ALIKE * ALIKE} * (all_blocked / all_labelled) * (1 - all_blocked / all_labelled) * (1.0 / labelled + 1.0 / (all_labelled - labelled))
        ELSE true END),
m{d} AS (
  SELECT m.template, m.host, m.seg, m.n, m.labelled, m.blocked,
         CASE WHEN len(m.seg) < {d + 1} THEN m.prefix WHEN len(m.seg) > {d + 1} AND s.mates > 1 THEN m.prefix || '/{{~}}' ELSE m.prefix || '/' || m.seg[{d + 1}] END AS prefix
  FROM m{d - 1} m LEFT JOIN s{d} s ON m.prefix = s.prefix AND m.seg[{d + 1}] = s.child),
'''
        for d in range(1, DEPTHS + 1)
    )
}merged AS (
  SELECT template, host, labelled, blocked,
         CASE WHEN len(seg) > {DEPTHS + 1} THEN prefix || '/' || array_to_string(seg[{DEPTHS + 2}:], '/') ELSE prefix END AS merged FROM m{DEPTHS}),
l0 AS (
  SELECT host, merged, host || regexp_replace(substr(merged, length(host) + 1), '/[^/]*$', '') AS parent,
         regexp_extract(host, '([^.]*\\.?[^.]*)$', 1) AS domain, sum(labelled) AS labelled, sum(blocked) AS blocked, CAST(0.5 AS DOUBLE) AS prior
  FROM merged GROUP BY host, merged),
{
    ",".join(
        f'''l{k} AS (
  SELECT * EXCLUDE (prior), 0.5 + {CARRY} * ((sum(blocked) OVER w + {SMOOTH} * prior) / (sum(labelled) OVER w + {SMOOTH}) - 0.5) AS prior FROM l{k - 1} WINDOW w AS (PARTITION BY {key}))'''
        for k, key in enumerate(("1", "domain", "host", "parent"), 1)
    )
},
purity AS (
  SELECT merged, CAST(labelled AS BIGINT) AS labelled, (blocked + {SMOOTH} * prior) / (labelled + {SMOOTH}) AS purity FROM l4)
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.ruling, CASE WHEN p.purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
       m.merged AS template, p.labelled, CAST(p.purity AS DOUBLE) AS purity
FROM judged j JOIN named n ON j.host = n.host AND j.shape = n.shape JOIN merged m ON n.template = m.template JOIN purity p ON m.merged = p.merged
"""
