"""From raw rows to catalogue rows: articles, named features, links, guards, dates, points."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tindra.functions import geo, geometry, text
from tindra.operators.matching import static_duplicates
from tindra.operators.order import first_per_key

# How redirects begin, limits of a request's text and of an article's.
REDIRECTS = r"(?U)^(#REDIRECT|#TILVÍSUN)"
LONGEST_REQUEST, SHORTEST_ARTICLE, SHORTEST_NOTE = 10_000, 100, 5


def is_redirect(c: Column) -> Column:
    return F.upper(text.strip(text.nonnull(c))).rlike(REDIRECTS)


def request_fault(c: Column) -> Column:
    """Why a text is refused; null where it is accepted."""
    return F.when(text.strip(text.nonnull(c)) == "", "empty").when(F.length(c) > LONGEST_REQUEST, "too long")


def last_changed(c: Column) -> Column:
    """A timestamp from either of the two stored forms: with a blank, or with T and fractions."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def formatted_gps(lat: Column, lon: Column, digits: int = 6, separator: str = ", ") -> Column:
    """Coordinates with fixed decimals, rounded from the exact binary value."""
    return F.concat(geo.fixed(lat, digits), F.lit(separator), geo.fixed(lon, digits))


def peaks(elements: DataFrame) -> DataFrame:
    """gps, caption and height of map elements (lat, lon, tags: map), the tallest first, ties by caption:
    those with a name, a point of their own and a height that is a number."""
    height = text.elevation(F.col("tags")["ele"])
    named = elements.where("tags['name'] <> '' AND lat IS NOT NULL AND lon IS NOT NULL")
    rows = named.select(F.concat(geo.shortest(F.col("lat")), F.lit(", "), geo.shortest(F.col("lon"))).alias("gps"), F.col("tags")["name"].alias("caption"), height.alias("height"))
    return rows.where("height IS NOT NULL").orderBy(F.desc("height"), "caption")


def points_in_disc(df: DataFrame, lat: float, lon: float, radius_km: float, seed: int) -> DataFrame:
    """A random point per row, uniform over the disc's area."""
    angle, reach = F.rand(seed) * 2 * F.lit(3.141592653589793), F.sqrt(F.rand(seed + 1)) * radius_km
    drawn = df.withColumns({"_a": angle, "_r": reach})
    return drawn.withColumns({"lat": F.lit(lat) + F.col("_r") / geo.DEGREE_KM * F.cos("_a"), "lon": F.lit(lon) + F.col("_r") / (F.lit(geo.DEGREE_KM) * F.cos(F.radians(F.lit(lat)))) * F.sin("_a")}).drop("_a", "_r")


def story_links(pages: DataFrame, page: str = "page_id", html: str = "html", ending: str = ".htm", index: str = "./thjod.htm") -> DataFrame:
    """Distinct links to stories in page order: of the ending, not upwards, not the index."""
    links = F.array_distinct(F.filter(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1)), lambda h: h.endswith(ending) & ~h.contains("../") & (h != index)))
    return pages.select(page, F.posexplode(links).alias("pos", "href"))


def search_hits(df: DataFrame, answer: str, most: int = 20) -> DataFrame:
    """The first hits of a search answer (JSON) as rows with pos, caption and value; answers that are
    no JSON or lack the list give none."""
    hits = F.from_json(answer, "query struct<search: array<struct<title: string, pageid: long>>>")["query"]["search"]
    return df.select(*(c for c in df.columns if c != answer), F.posexplode(F.slice(hits, 1, most)).alias("pos", "_h")).select("*", F.col("_h.title").alias("caption"), F.col("_h.pageid").alias("value")).drop("_h")


def page_extract(answer: Column, pageid: Column) -> Column:
    """The extract of a page in an answer (JSON), empty where it lacks one."""
    pages = F.from_json(answer, "query struct<pages: map<string, struct<extract: string>>>")["query"]["pages"]
    return F.coalesce(F.try_element_at(pages, pageid.cast("string"))["extract"], F.lit(""))


def with_extracts(articles: DataFrame, extracts: DataFrame) -> DataFrame:
    """Articles (lang, pageid) with the fetched ``extract`` of their page in their language; others keep
    the one they have."""
    return articles.join(extracts.select("lang", "pageid", F.col("extract").alias("_new")), ["lang", "pageid"], "left").withColumn("extract", F.coalesce("_new", "extract")).drop("_new")


def first_hits(hits: DataFrame, key: str, probe: str, pos: str) -> DataFrame:
    """The first hit of each key over probes (or categories) in order, and in a probe by position."""
    return first_per_key(hits, [key], [F.asc(probe), F.asc(pos)])


def category_pages(links: DataFrame, names: DataFrame, href: str = "href") -> DataFrame:
    """Links whose file name is a known category's (file_name, category); the small side decides."""
    return links.withColumn("file_name", F.regexp_replace(href, r"^[./]+", "")).join(names, "file_name")


def with_link_slots(df: DataFrame, url: Column, source: Column, home: str = "wikipedia_is") -> DataFrame:
    """The URL in the slot of its source's language, the other slot empty."""
    return df.withColumns({"link": F.when(source == home, url).otherwise(""), "link_eng": F.when(source == home, "").otherwise(url)})


def new_articles(articles: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue rows of articles (pageid, title, lat, lon, lang, extract): long enough, not there yet, and
    one per place at three decimals - the first by language and title, so ``en`` before ``is``."""
    rows = articles.withColumns({"story": text.clean_extract(F.col("extract")), "id": F.concat_ws("_", "lang", F.col("pageid").cast("string"))})
    rows = rows.where(F.length("story") >= SHORTEST_ARTICLE)
    fresh = rows.join(static_duplicates(rows.select("id", "title", "lat", "lon"), catalogue), "id", "left_anti")
    first = first_per_key(fresh, [geo.milli_key(F.col("lat")), geo.milli_key(F.col("lon"))], [F.asc("lang"), F.asc("title"), F.asc("id")])
    home = F.col("lang") == "is"
    return first.select(
        "id", F.col("title").alias("name"), "lat", "lon", F.lit("Saga").alias("tag"), F.when(home, F.col("story")).otherwise("").alias("story"), F.when(home, "").otherwise(F.col("story")).alias("story_eng"),
        text.article_url(F.col("lang"), F.col("title")).alias("ref"), F.concat(F.lit("wikipedia_"), F.col("lang")).alias("source"), F.length("story").cast("long").alias("char_count"),
    )


def feature_rows(layers: list[DataFrame], meanings: DataFrame) -> DataFrame:
    """Catalogue rows of named features (ornefni, tvinefni, nafnberi, ornefnalysing, tilvist, heimild,
    geom) of all layers: with a name, a note of at least five characters and a readable geometry."""
    rows = reduce(DataFrame.unionByName, layers)
    note, name = text.strip(text.nonnull(F.col("ornefnalysing"))), text.strip(text.nonnull(F.col("ornefni")))
    rows = rows.where(F.col("ornefnalysing").isNotNull() & (F.length(F.trim("ornefnalysing")) >= SHORTEST_NOTE)).where((name != "") & (F.length(note) >= SHORTEST_NOTE))
    placed = rows.withColumn("_p", geometry.point("geom")).where("_p.lat IS NOT NULL")
    known = placed.join(meanings, "nafnberi", "left")  # a dictionary of feature types, of any size
    story = text.feature_story(name, text.strip(text.nonnull(F.col("tvinefni"))), F.col("nafnberi"), note, F.col("tilvist"), F.col("meaning"))
    return known.select(name.alias("name"), formatted_gps(F.col("_p.lat"), F.col("_p.lon"), 7, ",").alias("gps"), F.lit("Örnefni").alias("tag"), story.alias("story"), F.concat(F.lit("LMI Örnefni. "), text.nonnull(F.col("heimild"))).alias("ref"), F.lit("lmi").alias("source"), F.lit(0).cast("long").alias("visibility"))
