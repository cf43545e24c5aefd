"""Walks over listing pages: page order, product order, caps and stop rules.

A walk follows the ``next`` address from a start page. Many catalogs are walked at once.
The position of a page is found by growing jumps: after k rounds every page knows the page
4**k steps on, and all pages less than 4**k steps from the start know their distance. A
chain of n pages takes log4(n) rounds, not n.

A catalog takes part in a round only while its walk is open. It closes when the walk ends or
reaches the page cap, at a page without news, and when enough products have been met; its pages
are left out of all later rounds. So a capped walk costs what it finds, not what the catalog has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.functions.rows import explode_items, of_groups
from offerlake.session import discard, materialize

# Jumps per round. More jumps mean fewer rounds and tables but more joins in each.
LEAPS = 4

# Pages per block when positions are summed up along a walk; bounds every window.
PAGES_PER_BLOCK = 4096


def _leaps(jump: DataFrame) -> DataFrame:
    """From ``catalog, page, t1`` the pages one to four jumps on: ``t1`` to ``t4``."""
    leaps = jump
    for reach in range(1, LEAPS):
        following = jump.select(
            "catalog", F.col("page").alias(f"t{reach}"), F.col("t1").alias(f"t{reach + 1}")
        )
        leaps = leaps.join(following, ["catalog", f"t{reach}"], "left")
    return leaps


def further(reached: DataFrame, leaps: DataFrame, span: int) -> DataFrame:
    """Pages less than ``LEAPS * span`` steps from the start, from those less than ``span``.

    Both are ``catalog, page, steps``. A page that is met again ends the walk, so it keeps its
    smallest number of steps.
    """
    landings = F.array(
        *(
            F.struct(F.col(f"t{n}").alias("page"), F.lit(n * span).alias("steps"))
            for n in range(1, LEAPS)
        )
    )
    landed = reached.join(leaps, ["catalog", "page"]).select(
        "catalog", "steps", F.explode(landings).alias("landing")
    )
    fresh = landed.select(
        "catalog", "landing.page", (F.col("steps") + F.col("landing.steps")).alias("steps")
    ).where(F.col("page").isNotNull())
    return reached.unionByName(fresh).groupBy("catalog", "page").agg(F.min("steps").alias("steps"))


def first_occurrences(links: DataFrame) -> DataFrame:
    """First place of each product address of a catalog: ``catalog, url, page_no, pos``.

    Page and position are packed in one long, so that the minimum is a hash aggregation
    with partial results on the map side; an address on every page costs nothing extra.
    """
    place = F.shiftleft(F.col("page_no"), 32) + F.col("pos")
    first = links.groupBy("catalog", "url").agg(F.min(place).alias("place"))
    return first.select(
        "catalog",
        "url",
        F.shiftright("place", 32).alias("page_no"),
        F.col("place").bitwiseAND((1 << 32) - 1).alias("pos"),
    )


def page_news(first: DataFrame, walked: DataFrame) -> DataFrame:
    """Number of addresses of its own of each page of the walks: ``catalog, page_no, n``."""
    page = ["catalog", "page_no"]
    counts = first.groupBy(page).agg(F.count("*").alias("n"))
    return walked.select(*page).join(counts, page, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def walk_ends(news: DataFrame, reach: int, max_pages: int, limit: int) -> DataFrame:
    """``catalog, stop, closed``: the first page without news, and whether the walk is over.

    ``news`` holds the first ``reach`` pages of each walk, or all that it has.
    """
    stop = F.min(F.when(F.col("n") == 0, F.col("page_no")))
    closed = stop.isNotNull() | (F.max("page_no") < reach)
    if limit:
        closed = closed | (F.sum("n") >= limit)
    if max_pages and reach >= max_pages:
        closed = F.lit(True)
    return news.groupBy("catalog").agg(stop.alias("stop"), closed.alias("closed"))


def fruitful_pages(news: DataFrame, ends: DataFrame) -> DataFrame:
    """Pages with addresses of their own, ``catalog, page_no, n``, before the walk stops.

    It stops at the first page that has none, and that page and all later ones count for
    nothing. The rule is applied to pages, never to links, and the pages are dealt out by
    block afterwards, so a catalog that holds most of the pages is not kept in one task.
    """
    before = F.col("stop").isNull() | (F.col("page_no") < F.col("stop"))
    block = F.expr(f"page_no div {PAGES_PER_BLOCK}").alias("block")
    return (
        news.join(ends, "catalog")
        .where(before)
        .select("catalog", "page_no", block, "n")
        .repartition("catalog", "block")
    )


def number_products(first: DataFrame, pages: DataFrame) -> DataFrame:
    """Addresses on the given pages with ``seq``, their position in the catalog, from 1.

    A window over a whole catalog would sort the largest catalog in one task. Positions
    are summed in levels instead: inside a page, pages inside a block, blocks.
    """
    page = ["catalog", "page_no"]
    all_before = (Window.unboundedPreceding, -1)

    def sum_before(window) -> Column:
        return F.coalesce(F.sum("n").over(window.rowsBetween(*all_before)), F.lit(0))

    blocks = pages.groupBy("catalog", "block").agg(F.sum("n").alias("n"))
    block_start = sum_before(Window.partitionBy("catalog").orderBy("block"))
    in_block = sum_before(Window.partitionBy("catalog", "block").orderBy("page_no"))
    starts = (
        pages.withColumn("in_block", in_block)
        .join(
            blocks.select("catalog", "block", block_start.alias("block_start")),
            ["catalog", "block"],
        )
        .select(*page, (F.col("block_start") + F.col("in_block")).alias("start"))
    )
    in_page = F.row_number().over(Window.partitionBy(page).orderBy("pos"))
    return first.withColumn("in_page", in_page).join(starts, page).select(
        "catalog", (F.col("start") + F.col("in_page")).alias("seq"), "page_no", "pos", "url"
    )


def rounds(
    pages: DataFrame, starts: DataFrame, max_pages: int, limit: int
) -> Iterator[DataFrame]:
    """Product addresses of the catalogs that close in each round; see :func:`crawl`."""
    key = ["catalog", "page"]
    hops = pages.where(F.col("next").isNotNull()).select(*key, F.col("next").alias("t1"))
    jump = materialize(hops, "jump")
    reached = materialize(starts.select(*key, F.lit(0).cast("long").alias("steps")), "reached")
    span = 1
    while True:
        leaps = materialize(_leaps(jump), "leaps")
        grown = materialize(further(reached, leaps, span), "reached")
        span *= LEAPS
        order = grown.select(*key, (F.col("steps") + 1).alias("page_no"))
        if max_pages:
            order = order.where(F.col("page_no") <= max_pages)
        walked = order.join(pages.select(*key, "links"), key)
        first = materialize(
            first_occurrences(explode_items(walked, "links", "url", "catalog", "page_no")), "first"
        )
        news = materialize(page_news(first, order.join(pages.select(*key), key)), "news")
        ends = walk_ends(news, span, max_pages, limit)
        # Two numbers: catalogs that close in this round, and those that go on.
        closing, going_on = ends.agg(F.count_if("closed"), F.count_if(~F.col("closed"))).first()
        if closing:
            over = ends.where("closed")
            found = number_products(
                of_groups(first, over, "catalog", F.col("url")) if going_on else first,
                fruitful_pages(news, over),
            )
            yield materialize(found.where(F.col("seq") <= limit) if limit else found, "found")
        discard(jump, reached, first)
        jump = leaps.where(F.col(f"t{LEAPS}").isNotNull()).select(*key, F.col(f"t{LEAPS}").alias("t1"))
        if going_on:
            going = ends.where("not closed").select("catalog") if closing else None
            jump = materialize(_open_only(jump, going), "jump")
            reached = materialize(_open_only(grown, going), "reached") if closing else grown
        discard(news, leaps, *([] if reached is grown else [grown]))
        if not going_on:
            return


def _open_only(rows: DataFrame, going: DataFrame | None) -> DataFrame:
    return rows if going is None else of_groups(rows, going, "catalog", F.col("page"))


def crawl(
    pages: DataFrame, starts: DataFrame, max_pages: int = 0, limit: int = 0
) -> DataFrame:
    """Product addresses in the order a walk meets them: ``catalog, seq, page_no, pos, url``.

    ``pages`` is ``catalog, page, next, links`` with one row per page, ``starts`` is
    ``catalog, page``. Zero means no cap. The order of the rules counts: page cap, first
    occurrence, stop at a page without news, product cap. The pages are read once per round,
    so they should be written out.
    """
    found = list(rounds(pages, starts, max_pages, limit))
    if not found:
        types = dict(pages.dtypes)
        schema = f"catalog {types['catalog']}, seq long, page_no long, pos long, url string"
        return pages.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)
