"""The radius lattice and the stored layout against plain loops."""

import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.test_operators import loop_nearby, metres
from tindra.functions import geo
from tindra.operators import joins, places


def test_one_table_from_the_equator_to_the_pole(spark):
    rng = random.Random(4)
    pts = [(lat + rng.uniform(-0.05, 0.05 if lat < 89.9 else 0), rng.choice([rng.uniform(-180, 180), rng.uniform(-21.1, -21), rng.choice([-180.0, 179.99])])) for lat in (0, 64, -64, 89.9, -89.95) for _ in range(60)]
    pts += [(90.0, 0.0), (90.0, 123.0), (-90.0, 1.0), (0.0, 180.0), (0.0, -180.0)]
    rows = [(i, *p) for i, p in enumerate(pts)]
    for radius in (900, 5000, 30_000):
        a, b = spark.createDataFrame(rows, "a long, alat double, alon double"), spark.createDataFrame(rows, "b long, blat double, blon double")
        got = sorted((r.a, r.b) for r in joins.radius_join(a, b, radius, ("alat", "alon"), ("blat", "blon")).collect())
        assert got == sorted((x[0], y[0]) for x in rows for y in rows if metres(*x[1:], *y[1:]) < radius)


def test_a_polar_row_changes_no_other_cell(spark):
    rng = random.Random(5)
    rows = [(64 + rng.random(), -22 + rng.random()) for _ in range(4000)] + [(90.0, 0.0)]
    placed = geo.Cells(1000).keyed(spark.createDataFrame(rows, "lat double, lon double"), "lat", "lon")
    assert placed.groupBy("_cy", "_cx").count().agg(F.max("count")).first()[0] < 20
    assert placed.where("lat = 90").first()._cx == 0


def test_ranges_hold_every_point_in_reach(spark):
    rng = random.Random(6)
    cases = [(rng.choice([0, 45, 64.2, -33, 89.99, -90, 90, 88]) + rng.uniform(-0.01, 0.01), rng.choice([-21.6, 0, 179.999, -180, 180, 90])) for _ in range(60)]
    points, owners = [], []
    for k, (lat, lon) in enumerate(cases):
        lat = max(-90.0, min(90.0, lat))
        for _ in range(40):
            points.append((k, max(-90.0, min(90.0, lat + rng.gauss(0, 0.03))), (lon + rng.gauss(0, 0.03 / max(0.01, math.cos(math.radians(lat)))) + 180) % 360 - 180))
        owners.append((lat, lon))
    df = spark.createDataFrame(points, "k int, lat double, lon double").withColumn("place", places.curve(F.col("lat"), F.col("lon")))
    inside = 0
    held = {k: places.ranges(*owners[k], 4000) for k in range(len(cases))}
    for r in df.collect():
        if metres(*owners[r.k], r.lat, r.lon) < 4000:
            inside += 1
            assert any(low <= r.place <= high for low, high in held[r.k]), (owners[r.k], r)
    assert inside > 300 and max(map(len, held.values())) <= places.RANGES + 4
    narrow = sum(high - low + 1 for low, high in places.ranges(64.2, -21.6, 4000)) / (1 << 2 * places.BITS)
    assert narrow < 1e-5


def catalogue_rows(n, seed=8):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lat, lon = 63.5 + rng.random() * 3, -24 + rng.random() * 10
        if i % 5 == 0:
            lat, lon = 64.1 + round(rng.random() / 100, 3), -21.9 + round(rng.random() / 100, 3)
        gps = rng.choice([f"{lat:.4f},{lon:.4f}", f"{lat:.4f}, {lon:.4f}"]) if i % 17 else rng.choice([None, "", "NOLOC", "x,y"])
        rows.append((i, rng.choice([None, "", "*draft", f"n{rng.randrange(40)}", f"place {i}"]), gps, rng.choice([None, "src9", "t"])))
    return rows


@pytest.mark.parametrize("most", [10, 3])
def test_stored_search_is_the_loop(spark, tmp_path, most):
    rows = [(i, n, g, None if t == "src9" else t) for i, n, g, t in catalogue_rows(1500)]
    path = str(tmp_path / "places")
    places.store(spark.createDataFrame(rows, "id long, name string, gps string, tag string"), path, "src9", files=4)
    for lat, lon in ((64.1, -21.9), (65, -20), (64.105, -21.895)):
        got = [(r.key, r.value) for r in places.nearby(places.read(spark, path), lat, lon, most=most).collect()]
        want = loop_nearby(rows, lat, lon)[:most]
        assert [v for _, v in got] == [v for _, v in want] and (len(set(want)) < most or got == want)


def test_stored_search_reads_cells_in_reach_only(spark, tmp_path):
    path = str(tmp_path / "places")
    n = 400_000
    df = spark.range(n).select("id", F.concat(F.lit("n"), "id").alias("name"), F.format_string("%.5f,%.5f", 60 + F.rand(1) * 10, -30 + F.rand(2) * 20).alias("gps"), F.lit("t").alias("tag"))
    places.store(df, path, "src9", files=8)
    found = places.nearby(places.read(spark, path), 64.2, -21.6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PushedFilters" in plan and "GreaterThanOrEqual(place," in plan
    held = places.ranges(64.2, -21.6, 4000)
    groups = rows = 0
    for file in sorted((tmp_path / "places").glob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            col = next(meta.row_group(g).column(c) for c in range(meta.num_columns) if meta.row_group(g).column(c).path_in_schema == "place")
            rows += meta.row_group(g).num_rows
            groups += any(low <= col.statistics.max and high >= col.statistics.min for low, high in held)
    assert rows == n and groups <= 3


def test_nearest_of_every_probe(spark):
    rows = [(i, f"n{i % 7}", 64 + (i % 97) / 1e4, -21 + (i % 89) / 1e4) for i in range(600)]
    layout = spark.createDataFrame(rows, "id long, name string, lat double, lon double")
    probes = [(k, 64 + k / 500, -21.0) for k in range(20)]
    got = {}
    for r in places.nearby_each(layout, spark.createDataFrame(probes, "probe long, probe_lat double, probe_lon double"), 900, 5).collect():
        got.setdefault(r.probe, {})[r.rank] = (r.value, r.key, r.id)
    for k, lat, lon in probes:
        want = sorted((math.floor(d), n, i) for i, n, a, b in rows if (d := metres(a, b, lat, lon)) < 900)[:5]
        assert [got.get(k, {})[j + 1] for j in range(len(want))] == want
