"""The rendered text index: text blocks with heading paths, their quality, ranked outlines under a token budget, and fetch.

The parse stage gives each page's records in document order: the text of headings, paragraphs, list items, quotes and
code, and clusters of the other text. All that follows is windows over the records of a page, which share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ENGAGEMENT, count_prices, has_price, round1, tokens, truncate_at_sentence
from .dom import Node, clean, extract, scope

#: Tags of content, of zones that other operators read, and the bounds of a cluster.
CONTENT = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "pre")
EXCLUDED = ("nav", "footer", "aside", "form", "table")
MOST_TOKENS, MOST_NODES = 120, 24
TYPES = {"p": "paragraph", "li": "list_item", "blockquote": "blockquote", "pre": "code"}
#: Runs of short linked items before the content.
RUN_TOKENS, RUN_LENGTH, CONTENT_TOKENS = 10, 5, 15

RECORDS = "pos int, tag string, type string, level int, text string, has_link boolean"


def _own_texts(node: Node) -> list[str]:
    """The text of a content element without that of content elements inside."""
    out = [node.text]
    for child in node.children:
        if child.tag not in CONTENT:
            out += _own_texts(child)
        out.append(child.tail)
    return [t for t in out if t]


def _records(root: Node | None, comments: bool = True) -> list[dict]:
    if root is None:
        return []
    top = scope(root)
    order = {id(n): k for k, n in enumerate(top.walk())}
    barred = top.tag in EXCLUDED or any(a.tag in EXCLUDED for a in top.above())
    loose: list[tuple[Node, str]] = []  # text outside content and zones, with the element that holds it
    found: list[tuple[int, dict]] = []
    size: dict[int, list[int]] = {}  # per element: characters and pieces of loose text, content elements below

    def survey(node: Node, in_zone: bool, in_content: bool) -> list[int]:
        """Counts for the node's subtree; loose texts and content records on the way."""
        content = node.tag in CONTENT
        zone = in_zone or node.tag in EXCLUDED
        total = [0, 0, 0]
        if content and not in_zone:
            text = clean(" ".join(_own_texts(node)))
            if text:
                level = int(node.tag[1]) if node.tag[0] == "h" else 0
                found.append((order[id(node)], {"tag": node.tag, "type": "heading" if level else TYPES[node.tag], "level": level, "text": text, "has_link": node.tag == "li" and any("href" in a.attrs for a in node.find("a"))}))
        free = not zone and not in_content and not content
        pieces = [node.text] if node.tag or comments else []

        def take(piece: str) -> None:
            text = clean(piece)
            if text:
                loose.append((node, text))
                total[0] += len(text)
                total[1] += 1

        if free:
            for piece in pieces:
                take(piece)
        for child in node.children:
            below = survey(child, zone, in_content or content)
            for k in range(3):
                total[k] += below[k]
            if free:
                take(child.tail)
            total[2] += child.tag in CONTENT and not zone
        size[id(node)] = total
        return total

    survey(top, barred, False)
    owners: dict[int, Node] = {}

    def owner(node: Node) -> Node:
        """The highest element up from node that stays one compact cluster."""
        if id(node) not in owners:
            above = node.parent if node is not top else None
            chars, pieces, content = size[id(above)] if above is not None else (0, 0, 0)
            stop = above is None or above.tag in ("html", "body") or above.tag in EXCLUDED or above.tag in CONTENT or content or pieces > MOST_NODES or chars // 4 > MOST_TOKENS
            owners[id(node)] = node if stop else owner(above)
        return owners[id(node)]

    clusters: dict[int, tuple[Node, list[str]]] = {}
    for node, text in loose:
        at = owner(node)
        clusters.setdefault(id(at), (at, []))[1].append(text)
    found += [(order[key], {"tag": node.tag or "text", "type": "text_group", "level": 0, "text": clean(" ".join(texts)), "has_link": False}) for key, (node, texts) in clusters.items()]
    found.sort(key=lambda x: x[0])
    return [{"pos": k} | r for k, (_, r) in enumerate(found)]


def records(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The text records of each page in document order, before headings and runs are looked at."""
    return extract(pages, _records, RECORDS, html_col=html_col, keep=keep)


def heading_path(keep: tuple[str, ...] = ("page_id",)) -> Column:
    """The headings above a record, joined by " > ": of each level the last one, if no heading of its level or above came after it."""
    so_far = Window.partitionBy(*keep).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = {level: F.last(F.when(F.col("level") == level, F.col("pos")), ignorenulls=True).over(so_far) for level in range(1, 7)}
    name = {level: F.last(F.when(F.col("level") == level, F.col("text")), ignorenulls=True).over(so_far) for level in range(1, 7)}
    live = [F.when(last[1].isNotNull(), name[1])]
    for level in range(2, 7):
        shallower = F.greatest(*[F.coalesce(last[k], F.lit(-1)) for k in range(1, level)], F.lit(-1))
        live.append(F.when(last[level] > shallower, name[level]))
    path = F.concat_ws(" > ", *live)
    return F.when(path == "", "root").otherwise(path)


def blocks(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per text block: block_no and id (p0, p1, …), tag, type, level, tokens, heading_path, text."""
    page = Window.partitionBy(*keep)
    rows = records(pages, html_col=html_col, keep=keep).withColumn("tokens", tokens(F.col("text"))).withColumn("heading_path", heading_path(keep))
    starts = (F.col("tag") == "h2") | ((F.col("tag") == "p") & (F.col("tokens") > CONTENT_TOKENS))
    rows = rows.withColumn("__content", F.min(F.when(starts, F.col("pos"))).over(page))
    short = (F.col("type") == "list_item") & (F.col("tokens") <= RUN_TOKENS) & F.col("has_link") & (F.col("pos") < F.col("__content"))
    rows = rows.withColumn("__short", F.coalesce(short, F.lit(False)))
    # Islands: within a run of equal flags, the place on the page and the place among equal flags move together.
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*keep, "__short").orderBy("pos"))
    rows = rows.withColumn("__island", island).withColumn("__run", F.count("*").over(Window.partitionBy(*keep, "__short", "__island")))
    rows = rows.filter(~(F.col("__short") & (F.col("__run") >= RUN_LENGTH)))
    rows = rows.withColumn("block_no", F.row_number().over(page.orderBy("pos")) - 1)
    return rows.select(*keep, "block_no", F.concat(F.lit("p"), "block_no").alias("id"), "tag", "type", "level", "tokens", "heading_path", "text")


def _source(root: Node | None) -> list[dict]:
    if root is None:
        return [{"source_text": "", "source_chars": 0}]
    parts: list[str] = []

    def visit(node: Node, in_zone: bool) -> None:
        zone = in_zone or node.tag in EXCLUDED
        if not zone:
            parts.append(clean(node.text))
        for child in node.children:
            visit(child, zone)
        if not zone:
            parts.extend(clean(c.tail) for c in node.children)

    top = scope(root)
    visit(top, any(a.tag in EXCLUDED for a in top.above()))
    parts = [p for p in parts if p]
    return [{"source_text": " ".join(parts), "source_chars": sum(map(len, parts))}]


def is_card() -> Column:
    return has_price(F.col("text")) & (F.col("type") != "heading") & F.col("tokens").between(4, 160)


def is_feed_item() -> Column:
    counter = (F.col("tokens") <= 18) & F.col("text").rlike(ENGAGEMENT) & ~has_price(F.col("text"))
    return (F.col("type") != "heading") & F.col("tokens").between(12, 140) & ~counter


def quality(pages: DataFrame, blks: DataFrame, *, html_col: str = "html") -> DataFrame:
    """How much of each page's text its blocks hold: tokens, coverage, repeated terms, price signals. Ratios have one decimal."""
    source = extract(pages, _source, "source_text string, source_chars int", html_col=html_col)
    index = blks.groupBy("page_id").agg(
        F.sum("tokens").alias("indexed_tokens"),
        F.sum(F.length("text")).alias("indexed_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda s: s["text"]), " ").alias("indexed_text"),
        F.count_if(F.col("type") == "text_group").alias("structural_blocks"),
        F.count_if(is_card()).alias("card_blocks"),
    )
    both = source.join(index, "page_id", "left").fillna("", ["indexed_text"]).fillna(0, ["indexed_tokens", "indexed_chars", "structural_blocks", "card_blocks"])
    terms = lambda c: F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda t: t != "")
    # A signed count per term: what the index has more of than the source is repeated.
    counted = both.select("page_id", F.explode(terms(F.col("indexed_text"))).alias("t"), F.lit(1).alias("k")).union(both.select("page_id", F.explode(terms(F.col("source_text"))).alias("t"), F.lit(-1).alias("k")))
    extra = counted.groupBy("page_id", "t").agg(F.sum("k").alias("n"), F.count_if(F.col("k") > 0).alias("i")).groupBy("page_id").agg(F.sum(F.greatest("n", F.lit(0))).alias("extra"), F.sum("i").alias("terms"))
    out = both.join(extra, "page_id", "left").fillna(0, ["extra", "terms"])
    out = out.withColumn("source_price_signals", count_prices(F.col("source_text"))).withColumn("indexed_price_signals", count_prices(F.col("indexed_text")))
    empty = F.col("source_text") == ""
    return out.select(
        "page_id",
        F.when(empty, 0).otherwise(tokens(F.col("source_text"))).alias("source_tokens"),
        "indexed_tokens",
        F.when(empty, 100.0).otherwise(round1(F.least(F.lit(100.0), 100 * F.col("indexed_chars") / F.greatest(F.lit(1), "source_chars")))).alias("coverage_pct"),
        round1(100 * F.col("extra") / F.greatest(F.lit(1), "terms")).alias("duplicate_overhead_pct"),
        "source_price_signals",
        "indexed_price_signals",
        F.when(F.col("source_price_signals") > 0, round1(100 * F.col("indexed_price_signals") / F.greatest(F.lit(1), "source_price_signals"))).otherwise(100.0).alias("signal_retention_pct"),
        "structural_blocks",
        "card_blocks",
        F.when(F.col("structural_blocks") > 0, "hybrid").otherwise("semantic").alias("mode"),
    )


def ranked(blks: DataFrame, *, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Blocks with catalog and feed flags of their page, their score and their rank for the outline (1 is first)."""
    page = Window.partitionBy(*keep)
    rows = blks.withColumn("priced", has_price(F.col("text"))).withColumn("card", is_card()).withColumn("__item", is_feed_item())
    rows = rows.withColumn("catalog", F.sum(F.col("priced").cast("int")).over(page) >= 5).withColumn("__bucket", F.floor(F.col("tokens") / 20))
    # The fullest band of 20 tokens among the items; of equally full ones the first met.
    rows = rows.withColumn("__items", F.sum(F.col("__item").cast("int")).over(page))
    rows = rows.withColumn("__in_band", F.when(F.col("__item"), F.count("*").over(Window.partitionBy(*keep, "__item", "__bucket"))))
    rows = rows.withColumn("__band_first", F.when(F.col("__item"), F.min("block_no").over(Window.partitionBy(*keep, "__item", "__bucket"))))
    best = F.max(F.when(F.col("__item"), F.struct(F.col("__in_band"), -F.col("__band_first"), F.col("__bucket")))).over(page)
    rows = rows.withColumn("__best", best)
    size = F.col("__best").getField("__in_band")
    feed = ~F.col("catalog") & F.coalesce((size >= 5) & (size >= F.greatest(F.lit(5), F.floor(F.col("__items") / 3))), F.lit(False))
    rows = rows.withColumn("feed", feed).withColumn("feed_item", F.col("feed") & F.col("__item") & (F.col("__bucket") == F.col("__best").getField("__bucket")))
    t = F.col("tokens")
    yes = lambda cond, points: F.when(cond, points).otherwise(0)
    heading = F.col("type") == "heading"
    high = heading & (F.col("level") <= 2)
    score = F.when(heading, F.when(F.col("level") <= 1, 40).when(F.col("level") == 2, 25).otherwise(10)).otherwise(0)
    score += F.when(F.col("card"), 120 + yes(t.between(8, 100), 30)).when(F.col("priced"), 70 + yes(t <= 200, 15)).otherwise(0)
    in_catalog = F.when(F.col("card"), 80).when(F.col("priced"), 40).when(high, 20).otherwise(-40 + yes(t <= 6, -20) + yes(t > 180, -25))
    in_feed = F.when(F.col("feed_item"), 140 + yes(t.between(20, 100), 25)).when(high, 30).otherwise(-35 + yes(t <= 8, -25) + yes(F.col("text").rlike(ENGAGEMENT) & (t <= 24), -30))
    in_article = yes(F.col("type").isin("paragraph", "list_item", "blockquote", "code"), 5)
    rows = rows.withColumn("score", score + F.when(F.col("catalog"), in_catalog).when(F.col("feed"), in_feed).otherwise(in_article))
    rows = rows.withColumn("rank", F.row_number().over(page.orderBy(F.col("score").desc(), "block_no")))
    return rows.drop("__item", "__bucket", "__items", "__in_band", "__band_first", "__best")


def outline(blks: DataFrame, *, max_tokens: int = 600, offset: int = 0, quality_rows: DataFrame | None = None, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per page: the outline text, a line for each ranked block from `offset` on, with a summary line, in max_tokens."""
    page = Window.partitionBy(*keep)
    rows = ranked(blks, keep=keep)
    path = F.substring("heading_path", 1, 120)
    shown = F.when(F.col("card"), "card").when(F.col("feed_item"), "feed").otherwise(F.col("type"))
    head = F.concat_ws(" | ", "id", "tag", path, F.concat("tokens", F.lit("t")))
    other = F.concat_ws(" | ", F.col("id"), path, shown, F.concat("tokens", F.lit("t")), F.replace(F.substring("text", 1, 80), F.lit("\n"), F.lit(" ")))
    rows = rows.withColumn("__line", F.when(F.col("type") == "heading", head).otherwise(other))
    rows = rows.withColumn("__total", F.count("*").over(page)).withColumn("__source", F.sum("tokens").over(page))
    rows = rows.withColumn("__cards", F.sum(F.col("card").cast("int")).over(page)).withColumn("__feeds", F.sum(F.col("feed_item").cast("int")).over(page))
    extra = F.lit("")
    if quality_rows is not None:
        rows = rows.join(quality_rows.select(*keep, "coverage_pct", "mode", "indexed_price_signals", "source_price_signals"), list(keep), "left")
        extra = F.concat(F.lit(" coverage="), F.format_string("%.1f", F.col("coverage_pct").cast("double")), F.lit("% mode="), "mode", F.lit(" signals="), "indexed_price_signals", F.lit("/"), "source_price_signals")

    def summary(end: Column) -> Column:
        start = F.least(F.lit(max(0, offset)).cast("long"), F.lit(2**31)).cast("string")
        more = F.when(end < F.col("__total"), F.concat(F.lit(" next="), end)).otherwise("")
        cards = F.when(F.col("__cards") > 0, F.concat(F.lit(" cards="), "__cards")).otherwise("")
        feeds = F.when(F.col("__feeds") > 0, F.concat(F.lit(" feeds="), "__feeds")).otherwise("")
        return F.concat(F.lit("range="), start, F.lit(":"), end, F.lit("/"), "__total", F.lit(" source="), "__source", F.lit("t"), more, cards, feeds, extra)

    begin = max(0, offset)
    listed = F.col("rank") > begin
    so_far = page.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__chars", F.sum(F.when(listed, F.length("__line") + 1).otherwise(0)).over(so_far))
    over = listed & (F.floor((F.col("__chars") + F.length(summary(F.col("rank")))) / 4) > max_tokens)
    rows = rows.withColumn("__stop", F.min(F.when(over, F.col("rank"))).over(page))
    fits = listed & (F.col("__stop").isNull() | (F.col("rank") < F.col("__stop")))
    ends = F.coalesce(F.max(F.when(fits, F.col("rank"))).over(page), F.lit(begin))
    rows = rows.withColumn("__end", ends).withColumn("__summary", summary(F.col("__end")))
    lines = F.array_sort(F.collect_list(F.when(fits, F.struct("rank", "__line"))))
    out = rows.groupBy(*keep).agg(lines.alias("l"), F.max("__summary").alias("s"))
    text = F.array_join(F.concat(F.transform("l", lambda x: x["__line"]), F.array("s")), "\n")
    text = F.when(tokens(text) <= max_tokens, text).otherwise(F.substring(text, F.lit(1), F.lit(max(0, max_tokens) * 4)))
    return out.select(*keep, (text if max_tokens > 0 else F.lit("")).alias("outline"), F.size("l").alias("n_lines"))


def fetch(blks: DataFrame, wanted: DataFrame, *, max_tokens: int = 2000, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The text of blocks asked for: `wanted` has the page and the array `ids`. In the order asked, each once, within max_tokens; the block that overflows is cut at a sentence and is the last."""
    asked = wanted.select(*keep, F.posexplode(F.array_distinct("ids")).alias("ask", "id"))
    rows = asked.join(blks, [*keep, "id"])
    before = Window.partitionBy(*keep).orderBy("ask").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    rows = rows.withColumn("__used", used).withColumn("__over", F.col("__used") + F.col("tokens") > max_tokens)
    first_over = F.min(F.when(F.col("__over"), F.col("ask"))).over(Window.partitionBy(*keep))
    rows = rows.withColumn("__stop", first_over).filter(F.col("__stop").isNull() | (F.col("ask") <= F.col("__stop")))
    marker = " […truncated]"
    room = F.greatest(F.lit(0), (F.lit(max_tokens) - F.col("__used")).cast("int") * 4 - len(marker))
    cut = truncate_at_sentence(F.col("text"), room)
    text = F.when(~F.col("__over"), F.col("text")).otherwise(F.when(cut != "", F.concat(cut, F.lit(marker))))
    return rows.select(*keep, "ask", "id", text.alias("text")).filter("text is not null" if max_tokens > 0 else "false")
