"""Interval joins, counts and peaks against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tindra.operators import intervals

SPAN = ("s", "e")


def made(n, seed, longest=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choice([rng.randrange(-1000, 1000), 7, 2**62, None])
        e = None if rng.random() < 0.1 else (s if s is not None else rng.randrange(-1000, 1000)) + rng.choice([0, 1, -5, rng.randrange(1, longest), 2**20])
        rows.append((i, rng.choice([1, 1, 1, 2, None]), s, e))
    return rows


def meets(a, b):
    low, high = float("-inf"), float("inf")
    lo = lambda r: low if r[2] is None else r[2]
    hi = lambda r: high if r[3] is None else r[3]
    return a[1] is not None and a[1] == b[1] and lo(a) < hi(a) and lo(b) < hi(b) and lo(a) < hi(b) and lo(b) < hi(a)


@pytest.fixture(scope="module")
def sides(spark):
    a, b = made(300, 1), made(250, 2, 5)
    return a, b, spark.createDataFrame(a, "id long, k int, s long, e long"), spark.createDataFrame(b, "other long, k int, from_ long, to_ long")


def test_pairs_once(sides):
    a, b, left, right = sides
    found = intervals.overlaps(left, right, ["k"], SPAN, ("from_", "to_"))
    assert found.columns == ["id", "k", "s", "e", "other", "from_", "to_"]
    assert sorted((r.id, r.other) for r in found.collect()) == sorted((x[0], y[0]) for x in a for y in b if meets(x, y))
    with pytest.raises(ValueError):
        intervals.overlaps(left, right.withColumnRenamed("from_", "S"), ["k"], SPAN, SPAN)


def test_counts(sides):
    a, b, left, right = sides
    found = intervals.overlap_counts(left, right.withColumnsRenamed({"from_": "s", "to_": "e"}), ["k"], "id", SPAN, SPAN).collect()
    assert {r.id: r.n_overlaps for r in found} == {x[0]: sum(meets(x, y) for y in b) for x in a} and len(found) == len(a)


def test_most_at_once(sides):
    a, _, left, _ = sides
    low, high = intervals.EVER, intervals.NEVER
    spans = [(k, low if s is None else s, high if e is None else e) for _, k, s, e in a]
    want = {}
    for key in (1, 2):
        own = [(s, e) for k, s, e in spans if k == key and s < e]
        most, at = max((sum(s <= m < e for s, e in own), -m) for m, _ in own)
        want[key] = (most, None if -at == low else -at)
    assert {r.k: (r.most, r.since) for r in intervals.most_at_once(left, ["k"], SPAN).collect()} == want


def test_one_hot_moment_and_key(spark):
    rows = spark.range(200_000).select("id", F.lit(1).alias("k"), F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id")).cast("long").alias("s")).withColumn("e", F.col("s") + 3)
    counts = {r.n_overlaps: r.n for r in intervals.overlap_counts(rows, rows, ["k"], "id", SPAN, SPAN).groupBy("n_overlaps").agg(F.count("*").alias("n")).collect()}
    # 100,000 rows are [5, 8); they and the odd ones at 3, 5 and 7 overlap all of them and three odd ones
    assert counts == {100_003: 100_003, 3: 99_995, 2: 2}
    assert intervals.most_at_once(rows, ["k"], SPAN).first().most == 100_002


def test_short_spans_do_not_meet_all(spark):
    """Rows that meet in a cell are few times the pairs: short spans all over a long time, one long one."""
    rows = spark.range(20_000).select("id", F.lit(1).alias("k"), (F.col("id") * 50).alias("s"), (F.col("id") * 50 + 60).alias("e"))
    other = rows.select(F.col("id").alias("other"), "k", F.col("s").alias("from_"), F.when(F.col("id") == 0, 2_000_000).otherwise(F.col("e")).alias("to_"))
    found = intervals.overlaps(rows, other, ["k"], SPAN, ("from_", "to_"))
    assert found.count() == 20_000 * 3 - 2 + 19_998


def test_levels_that_few_are_on_are_left_out():
    assert intervals.used_levels({}) == [] and intervals.used_levels({9: 5, intervals.OPEN: 1}) == [9, intervals.OPEN]
    assert intervals.used_levels({9: 1_000_000, 12: 10, 15: 10, 18: 10}) == [9]
    assert intervals.used_levels({9: 1_000_000, 30: 1_000}) == [9, 30]  # cut, these would be two million cells each
    assert intervals.used_levels({3: 10, 9: 1_000_000, 12: 900_000}) == [3, 9, 12]  # nine cells of each would be more
    assert intervals.used_levels({3: 10, 9: 1_000_000, 12: 100_000}) == [3, 9]


def test_empty_and_dates(spark):
    none = spark.createDataFrame([], "id long, k int, s long, e long")
    assert intervals.overlaps(none, none.withColumnsRenamed({"id": "o", "s": "s2", "e": "e2"}), ["k"], SPAN, ("s2", "e2")).count() == 0
    assert intervals.overlap_counts(none, none, ["k"], "id", SPAN, SPAN).count() == intervals.most_at_once(none, ["k"], SPAN).count() == 0
    texts = [("2020-01-01", "2020-01-01"), ("", None), (" 2020-01-02", ""), ("2020-02-30", "2020-03-01"), ("2020-01-05", "x")]
    got = spark.createDataFrame(texts, "a string, b string").select(*intervals.days(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(18262, 18263), (None, None), (18263, None), (0, 0), (0, 0)]
