"""Ball k-means against comparing every vector with every centroid."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np

from tindra.llm import ball_kmeans, registry, shared

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, v string"


def plain(rows, k, rounds, dim):
    """Exact integers, one pair after the other."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in order[:k]]
    if not cents:
        return []
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        found = [min((dist(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
        if r < rounds:
            members = defaultdict(list)
            for (_, v), (_, j) in zip(kept, found):
                members[j].append(v)
            for j, vs in members.items():
                cents[j] = [sum(col) // len(vs) for col in zip(*vs)]
    own = defaultdict(int)
    for d, j in found:
        own[j] += d
    return sorted(((i, j, d, own[j], sum(own.values()), tuple(cents[j])) for (i, _), (d, j) in zip(kept, found)), key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, 5, "x") for i, v in rows], SCHEMA)
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in ball_kmeans.cluster(df, **more).collect()), key=str)


def test_against_a_loop(spark):
    rng = random.Random(1)
    middle = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in middle[i % 9]]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 6) for i in range(40)] + [(1000, [-0.25] * 6), (None, [0.1] * 6), (2000, None), (2001, [0.1] * 5), (2002, [0.1] * 5 + [None]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2005, [])]
    assert run(spark, rows, k=12, rounds=5, dim=6) == plain(rows, 12, 5, 6)


def test_ties_and_equal_centroids(spark):
    """Few distinct places: equal centroids, empty clusters, vectors half way between two."""
    rows = [(i, [(i % 5) / 128, (i % 3) / 256]) for i in range(120)]
    assert run(spark, rows, k=20, rounds=3, dim=2) == plain(rows, 20, 3, 2)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.1, 0.2]), (2, [5.0, -7.0])]
    assert run(spark, rows, k=40, rounds=2, dim=2) == plain(rows, 40, 2, 2)
    assert run(spark, [], k=40, dim=2) == [] == run(spark, [(1, [float("nan"), 0.0])], k=40, dim=2)


def test_large_components_are_exact(spark):
    rows = [(i, [(-1) ** i * (262_144.0 - i), i * 1.0]) for i in range(50)] + [(99, [262_145.0, 0.0])]
    assert run(spark, rows, k=4, rounds=2, dim=2) == plain(rows[:-1], 4, 2, 2)


def test_balls_spare_comparisons():
    rng = np.random.default_rng(3)
    cents = rng.integers(-2000, 2000, (40, 16))
    home = rng.integers(0, 40, 5000)
    v = cents[home] + rng.integers(-200, 200, (5000, 16))
    radius = [int(np.ceil(np.sqrt(((v[home == i] - cents[i]) ** 2).sum(axis=1).max()))) for i in range(40)]
    who, best, compared = ball_kmeans.Balls(cents, radius).nearest(v, home)
    every = ((v[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (who == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert compared < 0.05 * 39 * len(v)
    anywhere, _, _ = ball_kmeans.Balls(cents, [None] * 40).nearest(v, np.zeros(5000, np.int64))
    assert (anywhere == who).all()


def test_query_against_a_loop(spark, sf_dir):
    rows = [tuple(r) for r in shared.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()]
    got = sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in registry.op11_ball_kmeans(spark, sf_dir).collect()), key=str)
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    assert got == sorted(((*r[:5], sha(r[5])) for r in plain(rows, 40, 5, 64)), key=str)
