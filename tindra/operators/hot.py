"""Lookups by keys of which a few may hold much of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARES = 2000  # a key over 1 / HOT_SHARES of the rows is hot, so there are at most that many


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` (no null keys) left joined with ``table`` (unique keys; ``weight`` is the number of rows of
    a key, ``total`` that of all rows): hot keys are few whatever the data, so they are broadcast and
    their rows stay where they are; all others meet in a shuffle."""
    bound = total // HOT_SHARES
    hot = F.broadcast(table.where(F.col(weight) > bound))
    seen = rows.join(hot, key, "inner")
    cold = rows.join(F.broadcast(table.where(F.col(weight) > bound).select(key)), key, "left_anti").join(table.where(F.col(weight) <= bound), key, "left")
    return seen.unionByName(cold)
