import shutil
import time

import pytest
from pyspark.sql import functions as F

from tindra.streaming.resume import load_stream

SCHEMA = "id long, v string"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, source, output, checkpoint, process=None, **more):
    stream = load_stream(spark.readStream.schema(SCHEMA).parquet(source), output, checkpoint, process or (lambda df: df.withColumn("n", F.col("id") * 2)), **more)
    stream.awaitTermination()


def rows_of(spark, output):
    return sorted(((r.id, r.v, r.n) for r in spark.read.parquet(output).collect()), key=str)


def test_finished_keys_are_skipped(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, source, [(i, "a") for i in range(5)])
    run(spark, source, output, str(tmp_path / "c1"))
    assert rows_of(spark, output) == [(i, "a", 2 * i) for i in range(5)]
    put(spark, source, [(i, "b") for i in range(3, 8)])
    run(spark, source, output, str(tmp_path / "c1"))
    want = [(i, "a" if i < 5 else "b", 2 * i) for i in range(8)]
    assert rows_of(spark, output) == want
    put(spark, source, [(8, "c")])
    run(spark, source, output, str(tmp_path / "c2"))
    assert rows_of(spark, output) == [*want, (8, "c", 16)]  # a new checkpoint does not bring old records back


def test_state_survives_without_the_output(spark, tmp_path):
    """Restarted on its checkpoint, the stream knows its keys although the output is gone."""
    source, output, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    put(spark, source, [(1, "a"), (2, "a")])
    run(spark, source, output, checkpoint)
    shutil.rmtree(output)
    put(spark, source, [(2, "late"), (3, "b"), (1, "late")])
    run(spark, source, output, checkpoint)
    assert rows_of(spark, output) == [(3, "b", 6)]


def test_repeats_in_a_batch_and_records_without_a_key(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, source, [(1, "z"), (1, "b"), (1, "m"), (None, "x"), (None, "w"), (2, None)] + [(7, f"k{i:05d}") for i in range(5000)])
    run(spark, source, output, str(tmp_path / "c"))
    assert rows_of(spark, output) == sorted([(1, "b", 2), (None, "w", None), (2, None, 4), (7, "k00000", 14)], key=str)


def test_a_batch_that_fails_after_writing_leaves_one_copy(spark, tmp_path):
    source, output, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    put(spark, source, [(1, "a"), (2, "a")])
    fail = []

    def process(df):
        if not fail:
            fail.append(1)
            df.withColumn("n", F.col("id") * 2).write.mode("overwrite").parquet(f"{output}/_run=other/_batch=9")  # another run's row is there
            raise OSError("lost")
        return df.withColumn("n", F.col("id") * 2)

    with pytest.raises(Exception):
        run(spark, source, output, checkpoint, process)
    shutil.rmtree(f"{output}/_run=other")
    run(spark, source, output, checkpoint, process)
    run(spark, source, output, checkpoint, process)
    assert rows_of(spark, output) == [(1, "a", 2), (2, "a", 4)]


def test_keys_are_forgotten_in_time(spark, tmp_path):
    source, output, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    put(spark, source, [(1, "a")])
    run(spark, source, output, checkpoint, forget_ms=500)
    time.sleep(1)
    put(spark, source, [(1, "b")])
    run(spark, source, output, checkpoint, forget_ms=500)
    assert rows_of(spark, output) == [(1, "a", 2), (1, "b", 2)]
