"""Token ids in files: frequency-ranked ids, variable-length bytes, separate control bytes.

A file holds up to ``FILE_IDS`` ids of consecutive documents (more for one longer document):

    magic, four little-endian uint32: documents, ranked ids, ids, data bytes
    ranked ids       uint32 each, most frequent in this file first (ties: smaller id)
    documents        doc_id int64, known uint8 (0: null doc_id), ids uint32
    control bytes    four ids each, two bits per id: bytes of its rank less one
    data bytes       the ranks, little-endian, without leading zero bytes

A reader maps a control byte to the four lengths with one table lookup, turns lengths to offsets by
a prefix sum, gathers four bytes at each offset and masks those that belong to the next id.

Semantics: null text is the empty text, which is the end id alone; documents with a null doc_id come
first; rows that share a doc_id keep a fixed order by their text; extra columns are ignored; an
empty table gives no files and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tindra.llm import kernel, shared, tokens

MAGIC = b"TNDRTK01"
FILE_IDS = 1 << 22
_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file's bytes."""
    ids = np.ascontiguousarray(ids, np.uint32)
    top = int(ids.max()) + 1 if len(ids) else 0
    if top <= 1 << 22:
        freq = np.bincount(ids, minlength=top)
        order = np.lexsort((np.arange(top), -freq))
        ranked = order[: int((freq > 0).sum())].astype(np.uint32)
        place = np.zeros(top, np.uint32)
        place[ranked] = np.arange(len(ranked), dtype=np.uint32)
        rank = place[ids]
    else:  # ids far apart: rank through their sorted set
        values, inv, freq = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.lexsort((values, -freq))
        ranked = values[order]
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        rank = place[inv]
    size = 1 + (rank > 0xFF).astype(np.uint8) + (rank > 0xFFFF) + (rank > 0xFFFFFF)
    codes = np.zeros(-(-len(rank) // 4) * 4, np.uint8)
    codes[: len(rank)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = rank.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    head = np.array([len(doc_ids), len(ranked), len(ids), len(data)], "<u4")
    return b"".join((MAGIC, head.tobytes(), ranked.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), counts.astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()))


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, known, counts and ids of a file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, ranks, n, size = np.frombuffer(raw, "<u4", 4, 8).tolist()
    at = 24

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    ranked, doc_ids, known, counts = take("<u4", ranks), take("<i8", docs), take("u1", docs), take("<u4", docs)
    control, data = take("u1", -(-n // 4)), take("u1", size)
    lens = _LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    begin = np.cumsum(lens) - lens
    padded = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.uint32)
    rank = padded[begin] | padded[begin + 1] << 8 | padded[begin + 2] << 16 | padded[begin + 3] << 24
    return doc_ids, known, counts, ranked[rank & _MASK[lens]]


def write(docs: DataFrame, folder: str, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the texts' ids to files in ascending id order; the manifest has a row per file:
    part, number, path, docs, ids.  Ranges of ids are dealt to tasks by sampled bounds; the text is
    a second sort key, so even one repeated id does not hold a task's whole share."""
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    keys = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt = picked.repartitionByRange(*keys).sortWithinPartitions(*keys, F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tok = TaskContext.get().partitionId(), tokens.tokenizer(vocabulary)
        held: list[tuple] = []
        total = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal total, number
            cols = [np.concatenate(x) for x in zip(*held)]
            path = f"{folder}/part-{part:06d}-{number:06d}.tok"
            shared.publish(path, pack(*cols))
            row = pa.RecordBatch.from_pydict({"part": [part], "number": [number], "path": [path], "docs": [len(cols[0])], "ids": [len(cols[3])]}, schema=MANIFEST)
            held.clear()
            total, number = 0, number + 1
            return row

        for batch in batches:
            for piece in kernel.slices(batch, "text"):
                ids, border, _ = tok.encode(piece.column("text"))
                ids, border = tokens.with_end(ids, border)
                key = piece.column("doc_id")
                held.append((np.asarray(key.fill_null(0)), np.asarray(key.is_valid()), np.diff(border), ids))
                total += len(ids)
                if total >= FILE_IDS:
                    yield flush()
        if held:
            yield flush()

    return dealt.mapInArrow(run, "part int, number int, path string, docs long, ids long")


MANIFEST = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])


def read(manifest: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start (ids before it), n_tokens, ids_crc32.

    What a file starts at is summed in two steps, inside parts and over the parts' totals."""
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    before = parts.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("before"))
    inner = Window.partitionBy("part").orderBy("number")
    files = manifest.withColumn("in_part", F.sum("ids").over(inner) - F.col("ids")).join(before, "part")
    files = files.select("path", (F.col("in_part") + F.col("before")).alias("base"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with shared.open_shared(path, "r") as f:
                    doc_ids, known, counts, ids = unpack(f.read())
                ends = np.cumsum(counts.astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (b - c) : 4 * b]) for b, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=known == 0), pa.array(base + ends - counts), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes the documents' ids to files in the shared folder and reads them back."""
    folder = shared.fresh(docs.sparkSession, "token-files")
    manifest = shared.settle(write(docs, folder, vocabulary or tokens.default_vocabulary()), "token-manifest")
    return read(manifest)
