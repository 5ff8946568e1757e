"""Order-dependent operators as windows: collapse, first and last per key, fill-forward, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tindra.functions.lineage import settle


def collapse_repeats(df: DataFrame, name: Column, keys: tuple[Column, ...], order: tuple[Column, ...]) -> DataFrame:
    """Drops rows equal in name and keys to the row before them in name order.

    Rows with equal names are adjacent in that order, so the window is partitioned by the name and no
    task sees the whole table.  Filters that decide what counts as a row belong before this."""
    w = Window.partitionBy(name).orderBy(*order)
    same = [F.lag(k).over(w).eqNullSafe(k) for k in keys]
    first = F.row_number().over(w) == 1
    repeat = ~first
    for s in same:
        repeat &= s
    return df.withColumn("_repeat", repeat).where(~F.col("_repeat")).drop("_repeat")


def first_per_key(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def fill_forward(df: DataFrame, value: Column, partition: list[str], order: list[Column]) -> Column:
    """The last non-null value up to each row."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(value, ignorenulls=True).over(w)


def before(df: DataFrame, value: Column, partition: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``_before``: the sum of ``value`` over the rows before, per partition key.

    The rows are range-partitioned by key and order, so a key with many rows has many tasks; a task sums
    its own rows, and what its keys had before is a row of its own ahead of them, one per task and key."""
    ranged = settle(df.withColumn("_v", value.cast("long")).repartitionByRange(*partition, *order).withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy("_p", *partition).agg(F.sum("_v").alias("_s"))
    ahead = F.coalesce(F.sum("_s").over(Window.partitionBy(*partition).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = sums.select("_p", *partition, ahead.alias("_v"), F.lit(False).alias("_own"))
    rows = ranged.withColumn("_own", F.lit(True)).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy("_p", *partition).orderBy("_own", *order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_before", F.coalesce(F.sum("_v").over(w), F.lit(0))).where("_own").select(*df.columns, "_before")


def batches(df: DataFrame, partition: list[str], order: list[Column], size: int = 20) -> DataFrame:
    """``df`` with ``batch``: batch numbers from 0 in each partition, ``size`` rows each."""
    return before(df, F.lit(1), partition, order).withColumn("batch", F.floor(F.col("_before") / size).cast("long")).drop("_before")


def first_successes(df: DataFrame, success: Column, order: list[Column], limit: int, partition: list[str]) -> DataFrame:
    """Rows up to the one with the ``limit``-th success, as a loop that stops there would visit them."""
    return before(df, F.coalesce(success, F.lit(False)).cast("int"), partition, order).where(F.col("_before") < limit).drop("_before")
