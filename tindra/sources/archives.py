"""ZIP archives of whole tables: tasks deflate, the ends are joined.

A member is a JSON array in key order.  The rows are range-sorted; every task deflates its rows into a file
of its own, up to a byte border (a full flush), and tells checksum and lengths.  Such streams may stand one
after the other, so the archive is headers and these files, copied in order through a buffer, and the
member's checksum is put together from the tasks' own.  Nothing holds a table: not a task, not the driver.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.functions.lineage import fresh, settle

BUFFER, LEVEL = 1 << 20, 6
# The polynomial of CRC-32, lowest power first, and the ends of deflate streams.
POLYNOMIAL, LAST_BLOCK = 0xEDB88320, b"\x03\x00"


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32; bit 31 is the power 0."""
    product = 0
    for power in range(31, -1, -1):
        if a >> power & 1:
            product ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return product


def joined_crc(first: int, second: int, length: int) -> int:
    """The checksum of two texts one after the other; ``length`` is the second's."""
    shift, step = 1 << 31, 1 << 23  # the powers 0 and 8, a byte
    while length:
        if length & 1:
            shift = _times(shift, step)
        step, length = _times(step, step), length >> 1
    return _times(shift, first) ^ second


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _deflated(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush(zlib.Z_FULL_FLUSH)


def _blocks(df: DataFrame, order: str) -> list:
    """A row per task with rows, in order: path, crc, raw and packed bytes."""
    spark = df.sparkSession
    line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("key").asc_nulls_first(), F.xxhash64("line")]
    dealt = df.select(F.col(f"`{order}`").alias("key"), line.alias("line")).repartitionByRange(n, *by).sortWithinPartitions(*by).select("line")
    folder = fresh(spark, "deflated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, raw, crc = f"{folder}/{uuid.uuid4().hex}", None, 0, 0
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
        for batch in batches:
            for value in batch.column("line"):
                data = (b",\n" if raw else b"") + value.as_py().encode()
                if out is None:
                    store, inner = _open(path)
                    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(inner)
                crc, raw = zlib.crc32(data, crc), raw + len(data)
                out.write(z.compress(data))
        if out is not None:
            out.write(z.flush(zlib.Z_FULL_FLUSH))
            packed = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], "crc": pa.array([crc], pa.int64()), "raw": pa.array([raw], pa.int64()), "packed": pa.array([packed], pa.int64())})

    # a task that runs twice writes two files, and only one is told
    return settle(dealt.mapInArrow(run, "part int, path string, crc long, raw long, packed long")).orderBy("part").collect()


def write_archive(members: dict[str, DataFrame], path: str, order: str = "id") -> None:
    """A ZIP at ``path`` with a JSON array per table, in key order (null keys first)."""
    spark = next(iter(members.values())).sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    directory, at = b"", 0

    def put(data: bytes) -> None:
        nonlocal at
        out.write(bytearray(data))
        at += len(data)

    try:
        for name, df in members.items():
            pieces: list = [b"[\n"]
            for k, block in enumerate(_blocks(df, order)):
                pieces += [b",\n", block] if k else [block]
            pieces.append(b"\n]")
            crc = raw = packed = 0
            for p in pieces:
                own = (zlib.crc32(p), len(p), len(_deflated(p))) if isinstance(p, bytes) else (p.crc, p.raw, p.packed)
                crc, raw, packed = joined_crc(crc, own[0], own[1]), raw + own[1], packed + own[2]
            packed += len(LAST_BLOCK)
            label, start = name.encode(), at
            # sizes stand in the wide field, so they may be of any length
            common = struct.pack("<HHHHHIII", 45, 0x800, 8, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF)
            put(b"PK\x03\x04" + common + struct.pack("<HH", len(label), 20) + label + struct.pack("<HHQQ", 1, 16, raw, packed))
            for p in pieces:
                if isinstance(p, bytes):
                    put(_deflated(p))
                    continue
                store, inner = _open(p.path)
                with store.open_input_stream(inner) as source:
                    while data := source.read(BUFFER):
                        put(data)
            put(LAST_BLOCK)
            directory += b"PK\x01\x02" + struct.pack("<H", 45) + common + struct.pack("<HHHHHII", len(label), 28, 0, 0, 0, 0, 0xFFFFFFFF) + label + struct.pack("<HHQQQ", 1, 24, raw, packed, start)
        begin = at
        put(directory)
        n = len(members)
        put(b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(directory), begin))
        put(b"PK\x06\x07" + struct.pack("<IQI", 0, begin + len(directory), 1))
        put(b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), 0xFFFFFFFF, 0xFFFFFFFF, 0))
    finally:
        out.close()
