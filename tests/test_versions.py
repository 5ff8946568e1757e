"""Written changes: races, crashes, partitions."""

import pytest
from pyspark.sql import functions as F

from tindra.operators import changes
from tindra.sources.versions import Conflict, VersionedTable

COLS = "id long, tag string, name string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def start(spark):
    return spark.createDataFrame([(i, [None, "a", "b", "a/ü =%"][i % 4], f"n{i}") for i in range(40)], COLS)


def test_changes_are_those_of_the_plans(spark, start, tmp_path):
    table = VersionedTable.by_bucket(spark, str(tmp_path / "t"), buckets=8)
    assert table.version() == 0 and table.migrate(start) == (40, 40)
    fresh = spark.createDataFrame([(3, "x", None), (100, None, "new")], COLS)
    want = changes.upsert(start, fresh)
    assert table.upsert(fresh) == 2 and rows_of(table.read()) == rows_of(want)
    sets = spark.createDataFrame([(5, "N5"), (100, "N100"), (999, "none")], "id long, name string")
    want = changes.update_columns(want, sets)
    table.update(sets)
    assert rows_of(table.read()) == rows_of(want)
    table.delete(spark.createDataFrame([(7,), (100,), (998,)], "id long"))
    assert rows_of(table.read()) == [r for r in rows_of(want) if r[0] not in (7, 100)]
    assert rows_of(table.read(1)) == rows_of(start)  # versions stay
    assert table.append(start.limit(0)) == 5 and table.read().count() == 39


def test_only_touched_partitions_are_rewritten(spark, start, tmp_path):
    table = VersionedTable.by_bucket(spark, str(tmp_path / "t"), buckets=8)
    table.overwrite(start)
    before = table.manifest()["parts"]
    table.upsert(spark.createDataFrame([(3, "x", "y")], COLS))
    after = table.manifest()["parts"]
    assert sum(before[p] != after[p] for p in before) == 1 and set(before) == set(after)


def test_replace_by_tag(spark, start, tmp_path):
    table = VersionedTable.by_value(spark, str(tmp_path / "t"), "tag")
    table.overwrite(start)
    for tag in ("a", None, "a/ü =%"):
        fresh = spark.createDataFrame([(1000, tag, "only")], COLS)
        same = F.col("tag").eqNullSafe(F.lit(tag))
        want = table.read().where(~same).unionByName(fresh)
        expected = rows_of(want)
        table.replace_by_value(tag, fresh)
        assert rows_of(table.read()) == expected
    table.replace_by_value("b", start.limit(0))
    assert table.read().where("tag = 'b'").count() == 0
    with pytest.raises(ValueError):
        table.replace_by_value("a", spark.createDataFrame([(1, "b", "x")], COLS))
    assert table.version() == 5


def between(table, monkeypatch, other):
    """Another writer commits just before this one publishes."""
    publish, done = table._publish, []

    def late(manifest):
        if not done:
            done.append(1)
            other()
        return publish(manifest)

    monkeypatch.setattr(table, "_publish", late)


def test_two_writers_of_different_partitions(spark, start, tmp_path, monkeypatch):
    one, two = (VersionedTable.by_value(spark, str(tmp_path / "t"), "tag") for _ in range(2))
    one.overwrite(start)
    between(one, monkeypatch, lambda: two.replace_by_value("b", spark.createDataFrame([(2000, "b", "two")], COLS)))
    one.replace_by_value("a", spark.createDataFrame([(1000, "a", "one")], COLS))
    assert one.version() == 3
    got = rows_of(one.read())
    assert (1000, "a", "one") in got and (2000, "b", "two") in got and len(got) == 22


def test_two_writers_of_one_partition(spark, start, tmp_path, monkeypatch):
    one, two = (VersionedTable.by_value(spark, str(tmp_path / "t"), "tag") for _ in range(2))
    one.overwrite(start)
    between(one, monkeypatch, lambda: two.replace_by_value("a", spark.createDataFrame([(2000, "a", "two")], COLS)))
    with pytest.raises(Conflict):
        one.replace_by_value("a", spark.createDataFrame([(1000, "a", "one")], COLS))
    assert one.version() == 2 and (2000, "a", "two") in rows_of(one.read())
    assert one.vacuum() and one.version() == 2 and (2000, "a", "two") in rows_of(one.read())


def test_a_crash_between_files_and_commit(spark, start, tmp_path, monkeypatch):
    table = VersionedTable.by_bucket(spark, str(tmp_path / "t"), buckets=4)
    table.overwrite(start)

    def die(manifest):
        raise OSError("lost")

    monkeypatch.setattr(table, "_publish", die)
    with pytest.raises(OSError):
        table.overwrite(spark.createDataFrame([(1, "z", "z")], COLS))
    monkeypatch.undo()
    again = VersionedTable.by_bucket(spark, str(tmp_path / "t"), buckets=4)
    assert again.version() == 1 and rows_of(again.read()) == rows_of(start)
    assert len(again.vacuum()) == 1 and rows_of(again.read()) == rows_of(start)
    again.overwrite(start.limit(3))
    assert again.version() == 2 and again.read().count() == 3


def test_a_copy_that_lost_rows_is_no_version(spark, start, tmp_path, monkeypatch):
    table = VersionedTable.by_bucket(spark, str(tmp_path / "t"))
    table.overwrite(start)
    write = table._write
    monkeypatch.setattr(table, "_write", lambda rows: (write(rows.where("id > 5"))[0], rows.count()))
    with pytest.raises(RuntimeError, match="40 rows were read and 34 written"):
        table.migrate(start)
    assert table.version() == 1 and table.read().count() == 40
