"""Work units of exact verification: runs of rows with equal keys, and links counted without pairs.

A candidate group is dealt to blocks of bounded size; a unit is a pair of blocks.  Inside a unit all
pairs are compared in memory, strip by strip, but only one row per member leaves it: the weight of its
partners and the smallest member that links reach inside the unit.  Counts add up over units, and the
reached members are edges enough to join the units' components later.

Rows with equal content are one node before any of this: its number is a hash of the content, checked
by a second hash, and its weight is the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.llm import graph, shared

LINKS = "node long, links long, root long"
STRIP = 512  # rows of a unit that are compared at once


def one_content(found: DataFrame, name: str) -> DataFrame:
    """``found`` (node, node2: hashes of one content) with node distinct between contents.

    Where two contents share a node, the ones beyond the smallest node2 take a number from node2."""
    clash = found.where("node IS NOT NULL").groupBy("node").agg(F.min("node2").alias("_low"), F.max("node2").alias("_high")).where("_low <> _high").select("node", "_low")
    clash = shared.settle(clash, f"{name}-clashes")  # chance meetings of 64 bits: a handful in 10**10 rows
    if not clash.limit(1).count():
        return found
    named = found.join(F.broadcast(clash), "node", "left")
    return shared.settle(named.withColumn("node", F.when(F.col("_low") < F.col("node2"), F.xxhash64("node2", F.lit(name))).otherwise(F.col("node"))).drop("_low"), f"{name}-apart")


def deal(members: DataFrame, group: str, node: str, blocks: str) -> DataFrame:
    """A row of ``members`` for every unit (i, j) of its group that holds it, with its block ``b``;
    ``blocks`` is the number of blocks of the group."""
    n = F.col(blocks).cast("int")
    b = F.pmod(F.xxhash64(node, F.lit(17)), n).cast("int")
    dealt = members.withColumn("b", b)
    return dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), n - 1))).select(*members.columns, "b", F.least("b", "_o").alias("i"), F.greatest("b", "_o").alias("j"))


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of sorted batches, one table per run of equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cut = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cut, cut[1:]):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def summarise(node: np.ndarray, weight: np.ndarray, adj: np.ndarray) -> dict[str, np.ndarray]:
    """Links and root of the members of a unit that have partners; ``adj`` is symmetric, its
    diagonal false."""
    big = np.iinfo(np.int64).max
    rows = np.flatnonzero(adj.any(axis=1))
    sub = adj if len(rows) == len(adj) else adj[np.ix_(rows, rows)]
    label = node[rows]
    strips = [slice(lo, lo + STRIP) for lo in range(0, len(rows), STRIP)]
    links = np.zeros(len(rows))
    for s in strips:
        links[s] = sub[s].astype(np.float64) @ weight[rows].astype(np.float64)
    while len(rows):
        nxt = np.concatenate([np.minimum(label[s], np.where(sub[s], label[None, :], big).min(axis=1)) for s in strips])
        if (nxt == label).all():
            break
        label = nxt
    return {"node": node[rows], "links": links.astype(np.int64), "root": label}


def emit(results: Iterator[dict[str, np.ndarray]], least: int = 4096) -> Iterator[pa.RecordBatch]:
    """Joins small results to batches."""
    held: list[dict[str, np.ndarray]] = []
    n = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[k] for h in held]), pa.int64()) for k in ("node", "links", "root")], ["node", "links", "root"])

    for r in results:
        if len(r["node"]):
            held.append(r)
            n += len(r["node"])
        if n >= least:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


def in_units(rows: DataFrame, group: str, link: Callable[[pa.Table], dict[str, np.ndarray]]) -> DataFrame:
    """Applies ``link`` to each unit (group, i, j).  The units of a group (of ``blocks`` blocks) go to
    one task after the other, so a large group is spread evenly."""
    n, keys = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), (group, "i", "j")
    turn = F.pmod(F.pmod(F.xxhash64(group), F.lit(n)) + F.col("i") * F.col("blocks") + F.col("j"), F.lit(n)).cast("int")
    dealt = rows.repartitionById(n, turn).drop("blocks").sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(link(t) for t in runs(batches, keys))

    return dealt.mapInArrow(run, LINKS)


def resolve(rows: DataFrame, classes: DataFrame, links: DataFrame, id_column: str, total: int) -> DataFrame:
    """Per row of ``rows`` (its id and node, null where it links with nothing): n_links, component_id,
    kept, n_copies.  ``classes`` has node, first_id (the smallest id) and copies."""
    joined = shared.settle(graph.components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))), "joined")
    leaders = shared.settle(joined.join(classes.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("leader"), F.count("*").alias("_size")), "leaders")
    led = shared.lookup(joined, leaders, ["component"], "_size", total).select("node", "leader")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    by_node = classes.select("node", "first_id", "copies").join(led, "node", "left").join(counted, "node", "left")
    by_node = shared.settle(by_node.select("node", "copies", F.coalesce("leader", "first_id").alias("leader"), F.coalesce("links", F.lit(0)).alias("links")), "classes-led")
    out = shared.lookup(rows.select(id_column, "node"), by_node, ["node"], "copies", total)
    leader = F.coalesce("leader", id_column)
    return out.select(
        id_column,
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        leader.alias("component_id"),
        F.coalesce(leader == F.col(id_column), F.lit(True)).alias("kept"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )
