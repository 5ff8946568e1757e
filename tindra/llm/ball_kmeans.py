"""Ball k-means over integer vectors.

A cluster is a ball: its centroid and a radius that holds all its members.  Centroids are few, so their
mutual distances are worked out once a round on the driver; a ball's neighbours are the centroids nearer
than twice its radius, and no other centroid can win one of its members.  The neighbours' half distances
cut a ball into a stable core, whose members are nearer to their centroid than to any border and stay
uncompared, and annuli: a member of the i-th annulus is compared, exactly, with the i nearest neighbours
only.  All arithmetic is in 64-bit integers, ties included, so the result is that of comparing every
vector with every centroid.

A round is one narrow pass that writes vectors with their clusters to the shared folder, and one
aggregation with a row per task and cluster; the round before is deleted.  A moved centroid widens its
ball by the length of its move, which spares a pass for the new radius.

Semantics: a vector takes part if it has exactly ``dim`` components, none null or non-finite, and none
beyond ``LIMIT`` after scaling (|x| of 262,144 at a scale of 256: squares of larger ones do not fit a
long); others are left out.  Rows that share an id are vectors of their own; a null id is never a first
centroid.  With fewer vectors than ``k`` there are as many clusters as vectors with an id; without any,
no rows.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.llm import shared

LIMIT = 1 << 26


def scaled(rows: DataFrame, id_column: str, vector_column: str, dim: int, scale: int) -> DataFrame:
    """vec_id and v, the components times ``scale``, rounded down."""
    one = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("x"))
    fits = F.forall("x", lambda x: F.coalesce(F.abs(x) * scale <= LIMIT, F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0))))
    return one.where((F.size("x") == dim) & fits).select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("v"))


class Balls:
    """Centroids, and of each its neighbours by distance; ``radius`` holds bounds, None for no bound."""

    def __init__(self, centroids: np.ndarray, radius: list[int | None]):
        self.centroids = centroids
        self.near, self.gap = [], []
        for i, r in enumerate(radius):
            gap = ((centroids - centroids[i]) ** 2).sum(axis=1)
            order = np.array([j for j in np.lexsort((np.arange(len(gap)), gap)) if j != i], np.int64)
            if r is not None:
                order = order[gap[order] <= 4 * min(r * r, 1 << 60)]
            self.near.append(order)
            self.gap.append(gap[order])

    def nearest(self, v: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector (of equals the first), its squared distance, and how many
        distances to other centroids than ``home`` that took.  Any home is right, a near one cheap."""
        best, who, compared = ((v - self.centroids[home]) ** 2).sum(axis=1), home.copy(), 0
        for i in np.unique(home).tolist():
            rows = np.flatnonzero(home == i)
            rings = np.searchsorted(self.gap[i], 4 * best[rows], "right")  # 0 is the stable core
            order = np.argsort(-rings, kind="stable")
            rows, rings = rows[order], rings[order]
            for m, j in enumerate(self.near[i][: rings[0]].tolist()):
                at = rows[: int(np.searchsorted(-rings, -m, "left"))]
                d = ((v[at] - self.centroids[j]) ** 2).sum(axis=1)
                compared += len(at)
                wins = (d < best[at]) | ((d == best[at]) & (j < who[at]))
                best[at[wins]], who[at[wins]] = d[wins], j
        return who, best, compared


def assign(state: DataFrame, balls: Balls) -> DataFrame:
    """vec_id, v, cluster and distance; ``state`` may have the clusters of the round before."""
    sent = state.sparkSession.sparkContext.broadcast(balls)  # k centroids
    dim = balls.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column("v").flatten()).reshape(-1, dim).astype(np.int64)
            home = np.asarray(batch.column("cluster")).astype(np.int64)
            who, distance, _ = sent.value.nearest(v, home)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(who.astype(np.int32)), pa.array(distance)], ["vec_id", "v", "cluster", "distance"])

    return state.select("vec_id", "v", "cluster").mapInArrow(run, "vec_id long, v array<int>, cluster int, distance long")


def _length(squared: int) -> int:
    """The square root, rounded up."""
    return isqrt(squared) + (isqrt(squared) ** 2 < squared)


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dim: int = 64, salt: str = "2:", id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia (sums of distance), centroid (its
    components).  The first centroids are the ``k`` vectors with the smallest SHA-256 of salt and id."""
    spark = rows.sparkSession
    vectors = scaled(rows, id_column, vector_column, dim, scale)
    drawn = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id IS NOT NULL").orderBy(drawn, "v").limit(k).select("v").collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dim)
    radius: list[int | None] = [None] * len(first)
    state, old = vectors.withColumn("cluster", F.lit(0)), None
    if not first:
        state, rounds = vectors.limit(0).withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), -1
    for r in range(rounds + 1):
        path = shared.fresh(spark, "balls")
        moved = assign(state, Balls(centroids, radius))
        moved.write.parquet(path)
        if old:
            shared.discard(spark, old)
        state, old = spark.read.schema(moved.schema).parquet(path), path
        if r < rounds:
            sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), F.array(*(F.sum(F.get("v", F.lit(p))) for p in range(dim))).alias("sums"))
            before, radius = centroids.copy(), [0] * len(first)
            for row in sums.collect():  # k rows at most
                centroids[row.cluster] = [s // row.n for s in row["sums"]]
                radius[row.cluster] = _length(row.far) + _length(int(((centroids[row.cluster] - before[row.cluster]) ** 2).sum()))
    inertia = {row.cluster: int(row.s) for row in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # k rows at most
    told = [(c, s, sum(inertia.values()), centroids[c].tolist()) for c, s in sorted(inertia.items())]
    named = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return state.drop("v").join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
