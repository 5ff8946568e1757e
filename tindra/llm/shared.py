"""Folders that driver and executors share, and small helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a folder of our own where it is unset
    on one machine.  On a cluster it must be set: executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()  # by setCheckpointDir
    if not base and chosen.isDefined():
        base = chosen.get()
    if not base and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tindra-"))
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/tindra-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the session's folder."""
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Removes what this application has settled; results that were not written elsewhere go with it."""
    discard(spark, session_folder(spark))


def discard(spark: SparkSession, path: str) -> None:
    """Removes a settled table that nothing reads any more."""
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back, which cuts the lineage: a lost
    executor costs no more than the tasks of the stage that reads them."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_prefix(df: DataFrame) -> str:
    """A prefix for columns of our own that no column of ``df`` has."""
    taken, n = [c.lower() for c in df.columns], 0
    while any(c.startswith(f"_own{n}_") for c in taken):
        n += 1
    return f"_own{n}_"


def give_back() -> None:
    """Returns freed memory of this process to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_shared(path: str, mode: str):
    """A file of the shared folder, whatever store it is in: 'r' is random access, 'w' a stream."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if mode == "r":
        return store.open_input_file(inner)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(inner)


def files_in(folder: str, ending: str) -> list[str]:
    """Paths of the files of a shared folder, none where it is not there."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    head = folder[: len(folder) - len(inner)] if folder.endswith(inner) else ""
    return sorted(head + x.path for x in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if x.path.endswith(ending))


def is_scan(df: DataFrame) -> bool:
    """Whether the plan only reads, filters and projects, so its partitions are the same at every run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Exchange", "Python", "Arrow", "Pandas", "Sample", "AdaptiveSparkPlan"))


def publish(path: str, data: bytes) -> None:
    """Writes a file under another name and renames it, so a task that runs twice (a retry after a
    lost executor, speculation) leaves one whole file."""
    from pyarrow import fs

    temp = f"{path}.{uuid.uuid4().hex}.part"
    with open_shared(temp, "w") as out:
        out.write(data)
    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    store.move(fs.FileSystem.from_uri(temp)[1] if "://" in temp or temp.startswith("file:") else temp, inner)


HOT_SHARES = 2000  # a key over 1 / HOT_SHARES of the rows is hot, so there are at most that many


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` left joined with ``table`` (unique keys) without a task per hot key.

    ``weight`` is the number of rows of a key, ``total`` that of all rows: keys over a fixed share are
    few whatever the data, so they are broadcast; rows with a null key meet nothing and stay where they
    are; all others meet in a shuffle.  Both sides should be settled, they are read up to three times."""
    bound = total // HOT_SHARES
    hot = F.broadcast(table.where(F.col(weight) > bound))
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    seen = rows.where(whole).join(hot, keys, "left")
    cold = rows.where(whole).join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(weight) <= bound), keys, "left")
    return seen.where(F.col(weight).isNotNull()).unionByName(cold).unionByName(rows.where(~whole), allowMissingColumns=True)


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, the ones whose hashed key is smallest: the same for every plan."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(rows)


def held_out(key: str, modulus: int, remainder: int):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus)) == remainder
