"""State changes as plans: each returns the table's rows after the change.  ``sources.versions`` writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delete(items: DataFrame, bridge: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and bridge without the ids (column id); bridge rows go with their items."""
    return items.join(ids, "id", "left_anti"), bridge.join(ids.select(F.col("id").alias("item_id")), "item_id", "left_anti").select(*bridge.columns)


def upsert(table: DataFrame, incoming: DataFrame, key: str = "id", kept: tuple[str, ...] = ()) -> DataFrame:
    """Full-row replacement by key, and insertion; columns that the incoming rows lack become null,
    but for ``kept`` ones, which keep the old value.  Rows with a null key get
    keys above all old ones, distinct but not dense."""
    cols = table.columns
    top = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    named = incoming.where(F.col(key).isNotNull())
    new = incoming.where(F.col(key).isNull())
    numbered = new.crossJoin(F.broadcast(top)).withColumn(key, F.col("_top") + 1 + F.monotonically_increasing_id())  # one row of top
    rows = named.unionByName(numbered.select(*incoming.columns))
    if kept:
        rows = rows.drop(*kept).join(table.select(key, *kept), key, "left")
    full = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in cols))
    return table.join(rows.select(key), key, "left_anti").select(*cols).unionByName(full)


def rewrite_bridge(bridge: DataFrame, item_ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """Bridge rows of the items (column item_id) replaced by ``pairs``, each once."""
    return bridge.join(item_ids.distinct(), "item_id", "left_anti").select(*bridge.columns).unionByName(pairs.select(*bridge.columns).distinct())


def replace_where(table: DataFrame, condition: Column, incoming: DataFrame) -> DataFrame:
    """All rows that meet the condition replaced by the incoming ones."""
    return table.where(~F.coalesce(condition, F.lit(False))).unionByName(incoming.select(*table.columns))


def update_columns(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Columns of ``changes`` set where its key matches and its value is not null."""
    sets = [c for c in changes.columns if c != key]
    joined = table.join(changes.select(key, *(F.col(c).alias(f"_{c}") for c in sets)), key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in sets else F.col(c) for c in table.columns))


def remaining(work: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Work whose key is not done yet."""
    return work.join(done.select(key).distinct(), key, "left_anti").select(*work.columns)


def stored_or_new(work: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Stored results where there are any, the work's own values elsewhere."""
    return update_columns(work, stored, key)


def save_areas(areas: DataFrame, incoming: DataFrame) -> DataFrame:
    """Areas replaced by key or added; an incoming area without a radius gets 1000, without a
    visibility 0."""
    filled = incoming.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in incoming.columns else F.lit(v) for c, v in (("radius", 1000), ("visibility", 0))})
    return upsert(areas, filled.withColumns({c: F.col(c).cast(areas.schema[c].dataType) for c in ("radius", "visibility")}))


def stamped(df: DataFrame, column: str = "lastchanged", now: Column | None = None, iso: bool = False) -> DataFrame:
    """The column set to the time of the change, as text in one of the two stored forms."""
    return df.withColumn(column, stored_time(F.current_timestamp() if now is None else now, iso))


def stored_time(ts: Column, iso: bool = False) -> Column:
    """A timestamp as stored text: with a blank, or ISO with T and, where there are any, six digits of
    fractions; null stays null."""
    if not iso:
        return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(ts == F.date_trunc("second", ts), whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
