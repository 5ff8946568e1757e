"""Difference of two snapshots of a table, with rows that came back under another key.

Rows become digests first: 128 bits of SHA-256 per compared column and for all of them together (the
content id), so texts never move.  Rows with equal keys meet in one aggregation, which is combined before
its shuffle.  What is left over is ranked by content: the rows are range-sorted by content id, side and
directed key (ascending for earlier rows, descending for later ones), every partition counts its runs of
one content and side, and a run that crosses a border adds what the partitions before have of it: one
number per partition.  Rows then join on content id and rank, so the copies of one content are spread like
any other rows, however many they are.

Semantics: keys pair where they are equal, nulls with nulls.  Where a key is repeated, its i-th earlier
row pairs with its i-th later one in order of content (ranked the same way), the rest is left over.  Of
leftovers with equal content the i-th smallest earlier key pairs with the i-th largest later key; a null
key is the smallest.  Columns are compared as text, nulls equal only nulls.  Empty tables give inserts or
deletes only, or nothing; columns that are not compared are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tindra.llm import shared

WIDTH = 16  # bytes of a content id


def _digest(value: Column) -> Column:
    return F.substring(F.unhex(F.sha2(value.cast("binary"), 256)), 1, WIDTH)


def row_text(columns: tuple[str, ...]) -> Column:
    """The columns as text, a line each, a null as ``~``."""
    return F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))


def digests(df: DataFrame, side: int, key: str, columns: tuple[str, ...]) -> DataFrame:
    """key, side, row: cid (content id), parts (a digest per column), sha (of ``row_text``, later rows)."""
    parts = F.array(*(_digest(F.col(c).cast("string")) for c in columns))
    sha = F.unhex(F.sha2(row_text(columns).cast("binary"), 256)) if side else F.lit(None).cast("binary")
    one = df.select(F.col(key).alias("key"), F.lit(side).alias("side"), parts.alias("parts"), sha.alias("sha"))
    flags = F.concat(*(F.when(F.get("parts", F.lit(i)).isNull(), F.lit(b"0")).otherwise(F.concat(F.lit(b"1"), F.get("parts", F.lit(i)))) for i in range(len(columns))))
    return one.select("key", "side", F.struct(_digest(flags).alias("cid"), "parts", "sha").alias("row"))


def meet(rows: DataFrame, *by: str) -> DataFrame:
    """Per group how many rows each side has (n0, n1) and one of each (a, b)."""
    of = lambda side: F.when(F.col("side") == side, F.col("row"))
    counts = [F.count_if(F.col("side") == side).alias(f"n{side}") for side in (0, 1)]
    return rows.groupBy(*by).agg(*counts, F.first(of(0), ignorenulls=True).alias("a"), F.first(of(1), ignorenulls=True).alias("b"))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank``: the place of each row, from 1, among those of its ``gid`` (``WIDTH``
    bytes) and ``side`` in the order.  The rows should be settled: they are read twice."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("gid"), F.col("side"), *order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last, before, first = TaskContext.get().partitionId(), 0, None, 0, True
        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            gid = np.frombuffer(b"".join(batch.column("gid").to_pylist()), np.dtype([("x", "<u8"), ("y", "<u8")]))
            side = np.asarray(batch.column("side"))
            new = np.ones(k, bool)
            new[1:] = (gid[1:] != gid[:-1]) | (side[1:] != side[:-1])
            new[0] = last is None or (gid[0].tobytes(), side[0]) != last
            begin = np.maximum.accumulate(np.where(new, np.arange(k), -1))
            local = np.where(begin < 0, before + np.arange(k) + 1, np.arange(k) - begin + 1)
            opened = np.cumsum(new) - (seen == 0)  # the partition's first row opens no second run
            in_first = (opened == 0) & first
            cols = [pa.array(np.full(k, part, np.int32)), pa.array(seen + np.arange(k)), pa.array(local), pa.array(in_first)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "part", "pos", "local", "in_first"])
            first, last, before, seen = bool(in_first[-1]), (gid[-1].tobytes(), side[-1]), int(local[-1]), seen + k

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    runs = shared.settle(dealt.mapInArrow(run, f"{fields}, part int, pos long, local long, in_first boolean"), "runs")
    ends = runs.groupBy("part").agg(F.min_by(F.struct("gid", "side"), "pos").alias("head"), F.max_by(F.struct("gid", "side", "local"), "pos").alias("tail"))
    had = ends.select("tail.gid", "tail.side", "part", F.col("tail.local").alias("n"), F.lit(1).alias("turn"))
    asks = ends.select("head.gid", "head.side", "part", F.lit(0).cast("long").alias("n"), F.lit(0).alias("turn"))
    carried = had.unionByName(asks).selectExpr("*", "sum(n) over (partition by gid, side order by part, turn rows between unbounded preceding and current row) as carry").where("turn = 0")
    told = runs.join(F.broadcast(carried.select("part", "carry")), "part", "left")  # a row per partition
    return told.withColumn("rank", F.col("local") + F.when(F.col("in_first"), F.col("carry")).otherwise(0)).drop("part", "pos", "local", "in_first", "carry")


def difference(earlier: DataFrame, later: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """key (later, else earlier), old_key (earlier), op (same, update, rekey, insert, delete), changed
    (the differing columns of a pair of equal keys), row_sha256 (of the later row's ``row_text``)."""
    spark = earlier.sparkSession
    rows = digests(earlier, 0, key, columns).unionByName(digests(later, 1, key, columns))
    met = shared.settle(meet(rows, "key"), "keys")
    by_key, left = met.where("n0 = 1 AND n1 = 1"), met.where("n0 + n1 = 1")
    if met.where("n0 > 1 OR n1 > 1").limit(1).count():
        repeated = _repeated_keys(spark, rows, met)
        by_key = by_key.unionByName(repeated.where("n0 = 1 AND n1 = 1"), allowMissingColumns=True)
        left = left.unionByName(repeated.where("n0 + n1 = 1"), allowMissingColumns=True)
    differs = [F.when(~F.get("a.parts", F.lit(i)).eqNullSafe(F.get("b.parts", F.lit(i))), F.lit(c)) for i, c in enumerate(columns)]
    changed = F.array_compact(F.array(*differs))
    pairs = by_key.select("key", F.col("key").alias("old_key"), F.when(F.size(changed) > 0, "update").otherwise("same").alias("op"), changed.alias("changed"), F.col("b.sha").alias("sha"))

    side = F.when(F.col("n0") == 1, 0).otherwise(1)
    row = F.coalesce("a", "b")
    rest = shared.settle(left.select("key", side.alias("side"), row["cid"].alias("gid"), row["sha"].alias("sha"), F.monotonically_increasing_id().alias("salt")), "leftovers")
    directed = [F.when(F.col("side") == 0, F.col("key")).asc_nulls_first(), F.when(F.col("side") == 1, F.col("key")).desc_nulls_last(), F.col("salt").asc()]
    placed = ranked(rest, directed).withColumn("there", F.lit(True))
    old = placed.where("side = 0").select("gid", "rank", F.col("key").alias("old_key"), F.col("there").alias("was"))
    new = placed.where("side = 1").select("gid", "rank", F.col("key").alias("new_key"), "sha", F.col("there").alias("is"))
    both = old.join(new, ["gid", "rank"], "full")
    op = F.when(F.col("was").isNull(), "insert").when(F.col("is").isNull(), "delete").otherwise("rekey")
    moved = both.select(F.when(F.col("is"), F.col("new_key")).otherwise(F.col("old_key")).alias("key"), "old_key", op.alias("op"), F.array().cast("array<string>").alias("changed"), "sha")
    return pairs.unionByName(moved).select("key", "old_key", "op", "changed", F.lower(F.hex("sha")).alias("row_sha256"))


def _repeated_keys(spark, rows: DataFrame, met: DataFrame) -> DataFrame:
    """``met`` of the rows whose key is repeated on a side, paired by key and rank."""
    kid = F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("null"))
    rows = shared.settle(rows.select("key", "side", "row", kid.alias("kid"), F.monotonically_increasing_id().alias("salt")), "all-rows")
    found = met.where("n0 > 1 OR n1 > 1").select(kid.alias("kid"), (F.col("n0") + F.col("n1")).alias("copies"))
    own = shared.lookup(rows, found, ["kid"], "copies", rows.count()).where("copies IS NOT NULL")
    own = shared.settle(own.select("key", "side", "row", "salt", _digest(F.col("kid")).alias("gid")), "repeated")
    return meet(ranked(own, [F.col("row.cid"), F.col("salt")]), "key", "rank").drop("rank")
