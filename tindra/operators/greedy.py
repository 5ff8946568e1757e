"""Ordered greedy acceptance: a row is rejected if it matches the seeds or an earlier accepted row.

Sequential by definition, but a row's fate is known once its earlier neighbours' fates are: accepted
if all are rejected, rejected if one is accepted.  Rounds of two aggregations settle at least the
earliest open row of every component; edges between settled rows leave the table, so rounds get
cheaper.  Once at most ``LOCAL_EDGES`` edges are open, one task goes through them in order, so a long
chain does not take a round a row.

Where rows match because they share a key, pairs of rows are never made.  A key's rows match each other,
so at most one of them is accepted: such a class is one row, its head, the earliest member not rejected
yet.  A row looks at classes instead of at earlier rows: it waits while a class has an earlier open head,
is rejected by an accepted one that it matches, and passes a class whose head comes later or matches not.
Edges and looks together are linear in the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tindra.functions.lineage import settle
from tindra.operators.hot import lookup

LOCAL_EDGES = 200_000  # open edges that one task may hold


def accept(nodes: DataFrame, edges: DataFrame, seeded: DataFrame | None = None, members: DataFrame | None = None, looks: DataFrame | None = None, matches: Callable[[str], Column] | None = None) -> DataFrame:
    """``node`` and ``accepted`` for every row of ``nodes`` (column node, unique).

    ``edges`` has node and earlier (an earlier node it matches); ``seeded`` the nodes that match a
    seed, which are rejected from the start.  ``members`` (node, cls and what ``matches`` needs) puts nodes
    in classes of nodes that all match each other; ``looks`` (node, cls and the like) says which classes
    hold nodes that a node may match, its own included.  ``matches(prefix)`` tells whether the node of a
    look matches a class's head, whose columns have the prefix; without it all do."""
    gone = (seeded if seeded is not None else nodes.limit(0)).select("node").distinct()
    state = nodes.select("node").join(gone.withColumn("_seed", F.lit(True)), "node", "left").select("node", F.when(F.col("_seed"), False).alias("accepted"))
    state = settle(state)
    open_edges = settle(edges.select("node", "earlier").where("node <> earlier").distinct().join(gone, "node", "left_anti"))
    if members is not None:
        members, looks = settle(members), settle(looks.join(gone, "node", "left_anti"))
    while True:
        fates = open_edges.join(state.select(F.col("node").alias("earlier"), F.col("accepted").alias("fate")), "earlier", "left").select("node", "fate")
        if members is not None:
            fates = fates.unionByName(_class_fates(state, members, looks, matches))
        judged = fates.groupBy("node").agg(F.max(F.coalesce("fate", F.lit(False))).alias("hit"), F.max(F.col("fate").isNull()).alias("waits"))
        judged = judged.select("node", F.when(F.col("hit"), False).when(~F.col("waits"), True).alias("verdict"), F.lit(True).alias("has_edges"))
        nxt = state.join(judged, "node", "left").select("node", F.coalesce("accepted", "verdict", F.when(F.col("has_edges").isNull(), True)).alias("accepted"))
        state = settle(nxt)
        still = state.where("accepted IS NULL").select("node")
        if not still.limit(1).count():
            return state
        open_edges = settle(open_edges.join(still, "node", "left_semi"))
        if members is not None:
            looks = settle(looks.join(still, "node", "left_semi"))
            members = settle(members.join(state.where("accepted IS NOT FALSE").select("node"), "node", "left_semi"))
            if _pairs_at_most(members, looks) > LOCAL_EDGES:
                continue
            open_edges = settle(open_edges.unionByName(_class_edges(members, looks, matches)).distinct())
            still_open = open_edges.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES
            if still_open:  # what looks found nothing to match in is free
                members = looks = None
                bound = settle(open_edges.select("node").distinct().withColumn("_bound", F.lit(True)))
                state = settle(state.join(bound, "node", "left").select("node", F.coalesce("accepted", F.when(F.col("_bound").isNull(), True)).alias("accepted")))
        else:
            still_open = open_edges.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES
        if still_open:
            fates = open_edges.join(state.select(F.col("node").alias("earlier"), F.col("accepted").alias("fate")), "earlier", "left")
            kind = state.schema["node"].dataType.simpleString()
            last = fates.select("node", "earlier", "fate").repartition(1).mapInPandas(_in_order, f"node {kind}, verdict boolean")
            done = state.join(last, "node", "left").select("node", F.coalesce("accepted", "verdict").alias("accepted"))
            return settle(done)


def _heads(state: DataFrame, members: DataFrame) -> DataFrame:
    """cls and head: the earliest member that is not rejected, with its fate."""
    alive = members.join(state.where("accepted IS NOT FALSE"), "node")
    attributes = [c for c in members.columns if c not in ("node", "cls")]
    return alive.groupBy("cls").agg(F.min_by(F.struct("node", "accepted", *attributes), "node").alias("head"))


def _class_fates(state: DataFrame, members: DataFrame, looks: DataFrame, matches) -> DataFrame:
    """node and fate of every look of an open node: true where the class rejects it, null where it must
    wait, false where the class lets it pass."""
    counted = looks.groupBy("cls").agg(F.count("*").alias("_looks"))
    heads = counted.join(_heads(state, members), "cls", "left")
    told = lookup(looks, heads, "cls", "_looks", looks.count())
    earlier = F.coalesce(F.col("head.node") < F.col("node"), F.lit(False))
    meets = F.lit(True) if matches is None else F.coalesce(matches("head."), F.lit(False))
    fate = F.when(~earlier, False).when(F.col("head.accepted"), meets)
    return told.join(state.where("accepted IS NULL").select("node"), "node", "left_semi").select("node", fate.alias("fate"))


def _pairs_at_most(members: DataFrame, looks: DataFrame) -> int:
    """How many pairs the classes of the open looks could make."""
    asked, there = (df.groupBy("cls").agg(F.count("*").cast("double").alias(c)) for df, c in ((looks, "_a"), (members, "_b")))
    return int(asked.join(there, "cls").agg(F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0.0))).first()[0])


def _class_edges(members: DataFrame, looks: DataFrame, matches) -> DataFrame:
    """The open looks as edges; only for few pairs."""
    held = members.select("cls", F.struct(*(c for c in members.columns if c != "cls")).alias("other"))
    pairs = looks.join(held, "cls").where(F.col("other.node") < F.col("node"))
    if matches is not None:
        pairs = pairs.where(matches("other."))
    return pairs.select("node", F.col("other.node").alias("earlier"))


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The fates of all open nodes of an edge table (node, earlier, fate): each after those before it."""
    fate: dict = {}
    waits: dict = {}
    for batch in batches:
        for node, earlier, known in zip(batch["node"].tolist(), batch["earlier"].tolist(), batch["fate"].tolist()):
            waits.setdefault(node, []).append(earlier)
            if known is not None and known == known:
                fate[earlier] = bool(known)
    for first in sorted(waits):
        todo = [first]
        while todo:  # where numbers do not follow the order, what a node waits for goes first
            node = todo[-1]
            ahead = [x for x in waits[node] if x not in fate and x in waits] if node not in fate else []
            if ahead:
                todo += ahead
                continue
            fate.setdefault(node, not any(fate.get(x, False) for x in waits[node]))
            todo.pop()
    yield pd.DataFrame({"node": list(waits), "verdict": [fate[x] for x in waits]})
