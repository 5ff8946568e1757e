"""The catalogue's reads: search, progress, nearby, areas, exports, work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tindra.functions import geo, text
from tindra.functions.lineage import settle
from tindra.operators.order import collapse_repeats
from tindra.plans.catalog import HIDDEN, LODGING


def not_tag(tag: Column, hidden: str) -> Column:
    """Whole-string inequality that keeps null; in this form it reaches the scan."""
    return tag.isNull() | (tag != hidden)


def without_tags(tag: Column, words: list[str]) -> Column:
    """No listed word in the tag, ASCII letters of any case; null is kept."""
    out = F.lit(True)
    for word in words:
        out &= tag.isNull() | ~text.matches_like(tag, "%", word, "%")
    return out


def drafted(name: Column) -> Column:
    return text.nonnull(name).rlike(r"^[*+]")


def is_found(wanted: str, hidden: str = HIDDEN, folded: tuple[str, str] | None = None) -> Column:
    """Whether a search finds an item: all that are visible; of one letter, those whose name begins with
    it; of more, those whose story or name holds the text.  ``%`` and ``_`` are wildcards.  ``folded`` names columns that
    have the folded name and story, null as empty."""
    wanted, shown = wanted.strip(), not_tag(F.col("tag"), hidden)
    if not wanted:
        return shown
    name, story = (F.col(c) for c in folded or ("name", "story"))
    like = text.like_folded if folded else text.matches_like
    if len(wanted) == 1:
        found = like(name, "", wanted, "%")
        return shown & (F.col("name").isNotNull() & found if folded else found)
    if not folded:
        return shown & (like(story, "%", wanted, "%") | like(name, "%", wanted, "%"))
    held = lambda c, own: F.col(own).isNotNull() & text.holds_parts(c, wanted) & like(c, "%", wanted, "%")
    return shown & (held(story, "story") | held(name, "name"))


def search(items: DataFrame, wanted: str, hidden: str = HIDDEN) -> DataFrame:
    """The items that ``is_found``; ``operators.search`` has the same over a stored index."""
    return items.where(is_found(wanted, hidden))


def search_order(df: DataFrame, wanted: str) -> DataFrame:
    return df.orderBy(F.asc("name"), F.asc("id")) if len(wanted.strip()) == 1 else df.orderBy(F.desc("id"))


def with_areas(items: DataFrame, bridge: DataFrame, areas: DataFrame) -> DataFrame:
    """Items with ``area_ids`` (text array) and ``area`` (captions), in area order."""
    pairs = bridge.join(areas.select(F.col("id").alias("area_id"), "caption"), "area_id")
    nested = pairs.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("area_id", "caption"))).alias("_a"))
    joined = items.join(nested, items["id"] == nested["item_id"], "left").drop("item_id")
    ids = F.transform("_a", lambda a: a["area_id"].cast("string"))
    return joined.withColumns({"area_ids": F.coalesce(ids, F.array().cast("array<string>")), "area": F.coalesce(F.array_join(F.transform("_a", lambda a: a["caption"]), ", "), F.lit(""))}).drop("_a")


def _progress(found: Column, wanted: str) -> Column:
    """Aggregates of the found items: to translate, done, all, percent.  Legends and literature count only
    in searches for legends."""
    name = text.nonnull(F.col("name"))
    eligible = found if text.LEGEND in wanted else found & ~name.contains(text.LEGEND) & ~name.contains(text.LITERATURE)
    total, done = F.count_if(eligible), F.count_if(eligible & (text.nonnull(F.col("story_eng")) != ""))
    percent = F.coalesce(F.floor(100 * done / F.nullif(total, F.lit(0)) + 0.5), F.lit(0)).cast("long")
    return F.struct(F.lit(wanted).alias("wanted"), total.alias("total_translate"), done.alias("total_done"), F.count_if(found).alias("count"), percent.alias("percent"))


def progress(found: DataFrame, wanted: str) -> DataFrame:
    """One row: items to translate, done, percent, of those that a search found."""
    return found.agg(_progress(F.lit(True), wanted).alias("p")).select("p.total_translate", "p.total_done", "p.count", "p.percent")


def progress_each(items: DataFrame, wanted: list[str]) -> DataFrame:
    """A row per search (wanted and the columns of ``progress``), all in one pass over the items."""
    each = items.agg(F.array(*(_progress(is_found(w), w) for w in wanted)).alias("p"))
    return each.select(F.explode("p").alias("p")).select("p.*")


NAMES_SENT = 20_000  # names in reach that are sent to all tasks


def nearby(items: DataFrame, lat: float, lon: float, radius_m: float = 4000, most: int = 10, lodging: str = LODGING) -> DataFrame:
    """The nearest items by whole metres, ties by name; repeats of a name at one place count once.

    Repeats are collapsed before the distance test, as an item far away ends a run of repeats too; only
    names that are in reach somewhere take part in that.  They are sent to all tasks while they are few,
    so nothing else is shuffled.  ``places`` has the same search over a stored layout."""
    name, gps = text.nonnull(F.col("name")), geo.squeezed(F.col("gps"))
    rows = items.where(geo.has_location(F.col("gps")) & ~drafted(F.col("name")) & ~text.nonnull(F.col("tag")).contains(lodging))
    rows = geo.with_point(rows.select("id", F.col("name").alias("_name"), name.alias("name"), gps.alias("gps")), "gps", "_lat", "_lon")
    rows = rows.withColumn("_d", geo.haversine(F.col("_lat"), F.col("_lon"), F.lit(lat), F.lit(lon)))
    names = settle(rows.where(F.col("_d") < radius_m).select("name").distinct())
    few = names.limit(NAMES_SENT + 1).count() <= NAMES_SENT
    rows = rows.join(F.broadcast(names) if few else names, "name", "left_semi")
    rows = collapse_repeats(rows, F.col("name"), (F.col("gps"),), (F.col("_name").asc_nulls_first(), F.asc("id")))
    near = rows.where(F.col("_d") < radius_m)
    return near.select(F.col("name").alias("key"), F.floor("_d").cast("long").alias("value"), "id").orderBy("value", "key", "id").limit(most)


def _place(gps: Column, part: int) -> Column:
    return F.when(geo.has_location(gps), F.get(F.split(geo.squeezed(gps), ",", -1), F.lit(part))).otherwise("")


def export_items(items: DataFrame, lang: str, hidden: str = HIDDEN) -> DataFrame:
    eng = lang == "ENG"
    gps, name = geo.squeezed(F.col("gps")), text.nonnull(F.col("name"))
    rows = items.withColumns({"_gps": gps, "_name": name}).where((F.col("_gps") != "") & ~drafted(F.col("_name")))
    if eng:
        rows = rows.where(not_tag(F.col("tag"), hidden))
    rows = collapse_repeats(rows, F.col("_name"), (F.col("_gps"),), (F.col("name").asc_nulls_first(), F.asc("id")))
    pick = lambda c: text.nonnull(F.col(f"{c}_eng" if eng else c))
    return rows.select(
        F.col("id").cast("string").alias("id"), pick("name").alias("name"), text.exported_story(pick("story")).alias("story"), "tag", F.col("ref").alias("reference"), "source",
        F.col("_gps").alias("gps"), _place(F.col("gps"), 0).alias("lat"), _place(F.col("gps"), 1).alias("lon"), pick("link").alias("link"), "visibility",
    )


def export_areas(areas: DataFrame, bridge: DataFrame, lang: str) -> DataFrame:
    end = "_eng" if lang == "ENG" else ""
    ids = bridge.groupBy("area_id").agg(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")).alias("item_ids"))
    rows = areas.where(geo.has_location(F.col("gps")) & ~drafted(F.col("caption"))).join(ids, areas["id"] == ids["area_id"], "left")
    pick = lambda c: text.nonnull(F.col(c + end))
    return rows.select(
        F.col("id").cast("string").alias("id"), pick("caption").alias("caption"), pick("description").alias("description"), geo.squeezed(F.col("gps")).alias("gps"), _place(F.col("gps"), 0).alias("lat"), _place(F.col("gps"), 1).alias("lon"),
        F.col("radius").cast("string").alias("radius"), text.nonnull(F.col("media")).alias("media"), "visibility", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def items_in_area(items: DataFrame, bridge: DataFrame, area_id: int) -> DataFrame:
    return items.join(bridge.where(F.col("area_id") == area_id).select(F.col("item_id").alias("id")), "id")


def area_or_default(areas: DataFrame, key: str) -> DataFrame:
    """One area; for the key ``new`` an empty record; no row for an unknown key."""
    if key == "new":
        empty = {"caption": "", "caption_eng": "", "description": "", "description_eng": "", "media": "", "gps": ""}
        return areas.sparkSession.range(1).select(F.lit(None).cast("long").alias("id"), *(F.lit(v).alias(k) for k, v in empty.items()), F.lit(0).cast("long").alias("visibility"), F.lit(1000).cast("long").alias("radius"))
    return areas.where(F.col("id") == F.lit(key).try_cast("long")).select("id", "caption", "caption_eng", "description", "description_eng", "media", "gps", "visibility", "radius")


def title_queue(items: DataFrame) -> DataFrame:
    """Items with a translated story but no translated title."""
    blank = lambda c: F.trim(text.nonnull(F.col(c))) == ""
    return items.where(~blank("story_eng") & blank("name_eng") & ~blank("name"))


def speech_candidates(items: DataFrame, field: str, exclude: list[str], visible_only: bool = False, ids: list[int] | None = None, limit: int = 0) -> DataFrame:
    """Items with a story in the field's language, by id."""
    rows = items.where(F.col(field).isNotNull() & (F.trim(field) != "") & without_tags(F.col("tag"), exclude))
    if visible_only:
        rows = rows.where("visibility = 1")
    if ids:
        rows = rows.where(F.col("id").isin(ids))
    return rows.orderBy("id").limit(limit) if limit else rows.orderBy("id")


def language_gap(items: DataFrame, long_chars: int = 3500) -> DataFrame:
    """Which translation work an item needs, and its longer story's length."""
    has = lambda c: text.nonnull(F.col(c)) != ""
    length = lambda c: F.length(text.nonnull(F.col(c)))
    both = has("story") & has("story_eng")
    kind = F.when(both, "both").when(has("story_eng"), "en_only").when(has("story"), "is_only").otherwise("neither")
    size = F.greatest(length("story"), length("story_eng")).cast("long")
    return items.select("id", kind.alias("class"), size.alias("char_count"), (size > long_chars).alias("long"))


def shown_on_map(items: DataFrame, wanted: str) -> DataFrame:
    """Rows with ``shown``: whether the name holds the wanted text, in any case; all do for an empty one.
    The counter beside the map is the number of rows shown."""
    held = F.contains(F.lower(text.nonnull(F.col("name"))), F.lit(wanted.lower()))
    return items.withColumn("shown", held if wanted else F.lit(True))


def response(items: DataFrame, totals: DataFrame) -> DataFrame:
    """A search's answer as JSON lines (part, line): the counts of ``totals`` (see ``progress``) as line
    0, then a line per item under its id; written out in that order they are the whole answer."""
    head = F.to_json(F.struct(F.col("total_translate").alias("TotalTranslate"), F.col("total_done").alias("TotalDone"), F.col("count").alias("Count"), F.lit("").alias("Error")))
    line = F.to_json(F.struct(F.col("id").alias("Id"), *(text.nonnull(F.col(c)).alias(n) for c, n in (("name", "Name"), ("gps", "Gps"), ("tag", "Tag")))))
    return totals.select(F.lit(None).cast("long").alias("part"), head.alias("line")).unionByName(items.select(F.col("id").alias("part"), line.alias("line")))
