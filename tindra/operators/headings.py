"""Pages as rows: links in order, item headings, the region each item stands under."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tindra.operators.order import fill_forward, first_per_key


def page_links(pages: DataFrame, wanted: Callable[[Column], Column], page: str = "page_id", html: str = "html") -> DataFrame:
    """Distinct wanted links of each page with their first place."""
    links = pages.select(page, F.posexplode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return links.where(wanted(F.col("href"))).groupBy(page, "href").agg(F.min("pos").cast("long").alias("first_pos"))


def single_part_link(href: Column, host: str, listing: str) -> Column:
    """A link to an article: the host is in its authority, its path has one part, which is no listing."""
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(href, F.lit("PATH")), F.lit("")), "/", -1), lambda x: x != "")
    return F.coalesce(F.try_parse_url(href, F.lit("HOST")).contains(host) & (F.size(parts) == 1) & ~F.get(parts, F.lit(0)).startswith(listing), F.lit(False))


def item_levels(headings: DataFrame, is_item: Callable[[DataFrame], Column], page: str = "page_id") -> DataFrame:
    """The heading level with the most item links of each page; the one seen first wins ties."""
    counted = headings.where(is_item(headings)).groupBy(page, "level").agg(F.count("*").alias("_n"), F.min("pos").alias("_first"))
    return first_per_key(counted, [page], [F.desc("_n"), F.asc("_first")]).select(page, "level")


def listed_items(headings: DataFrame, is_item: Callable[[DataFrame], Column], region: Column, chrome: tuple[str, ...], listing: str, page: str = "page_id") -> DataFrame:
    """Item headings with the last unlinked heading above item level before them, or the region."""
    levels = item_levels(headings, is_item, page).withColumnRenamed("level", "_item_level")
    rows = headings.join(levels, page).withColumn("_item", is_item(headings))
    marks = ~F.col("_item") & (F.col("level") < F.col("_item_level")) & (F.col("text") != "") & ~F.col("text").isin(*chrome) & ~F.col("text").startswith(listing)
    filled = fill_forward(rows, F.when(marks, F.col("text")), [page], [F.asc("pos")])
    return rows.withColumn("location", F.coalesce(filled, region)).where("_item").select(page, "pos", F.col("text").alias("name"), "href", "location")
