"""Links of listing pages: extraction, resolution, first occurrence, next page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.functions.dom import CATALOG_ID, dom_fields
from offerlake.functions.markup import has_attribute, raw_attribute, start_tags, unescape_all
from offerlake.functions.rows import explode_items
from offerlake.functions.urls import resolve, url_parts


def hrefs(html: Column) -> Column:
    """Targets of all anchors of a page, in order."""
    anchors = F.filter(start_tags(html, "a"), lambda tag: has_attribute(tag, "href"))
    return unescape_all(F.transform(anchors, lambda tag: raw_attribute(tag, "href")))


def next_href(html: Column) -> Column:
    """Target of the first ``link`` or ``a`` whose ``rel`` holds the word ``next``."""

    def is_next(tag: Column) -> Column:
        rel = F.coalesce(raw_attribute(tag, "rel"), F.lit(""))
        return has_attribute(tag, "href") & rel.rlike(r"(?U)(^|\s)next(\s|$)")

    tags = F.filter(start_tags(html, "a", "link"), is_next)
    first = F.transform(F.slice(tags, 1, 1), lambda tag: raw_attribute(tag, "href"))
    return F.get(unescape_all(first), 0)


def with_links(pages: DataFrame) -> DataFrame:
    """Per page the array of resolved links. No shuffle; the html ends here."""
    return (
        pages.withColumn("base", url_parts(F.col("url")))
        .withColumn("hrefs", hrefs(F.col("html")))
        .drop("html")
        .withColumn(
            "links", F.transform("hrefs", lambda href: resolve(F.col("base"), href))
        )
        .drop("base")
    )


def page_links(pages: DataFrame) -> DataFrame:
    """One row per link occurrence: page, position, raw and resolved target."""
    pairs = F.arrays_zip("hrefs", "links")
    return explode_items(with_links(pages), pairs, "pair", "page_id", "url").select(
        "page_id",
        "url",
        "pos",
        F.col("pair.hrefs").alias("href"),
        F.col("pair.links").alias("link"),
    )


def distinct_page_links(pages: DataFrame) -> DataFrame:
    """Links of each page without repeats, in order of first occurrence.

    A page is one row, so its repeats are found inside the row and nothing is shuffled.
    """
    return explode_items(with_links(pages), F.array_distinct("links"), "link", "page_id")


def listing_pages(pages: DataFrame) -> DataFrame:
    """Product links and next page of each listing page: ``url, links, next``.

    Only pages with the marks of a product list leave the JVM. Write the result before
    filtering on it: Spark would evaluate it once for the filter and once for the row.
    """
    read = pages.select(
        "url", next_href(F.col("html")).alias("following"), dom_fields(F.col("html"), CATALOG_ID).alias("dom")
    )
    based = read.withColumn("base", url_parts(F.col("url")))
    links = F.transform(
        F.coalesce("dom.hrefs", F.array().cast("array<string>")),
        lambda href: resolve(F.col("base"), href),
    )
    return based.select(
        "url",
        F.array_distinct(links).alias("links"),
        F.when(F.col("following").isNotNull(), resolve(F.col("base"), F.col("following"))).alias("next"),
    )
