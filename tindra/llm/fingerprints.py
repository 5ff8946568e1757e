"""Document fingerprints: one-permutation MinHash with optimal densification, a few bits per bin.

The shingles of a text (five words, folded case) are hashed once; the top bits of a hash choose its bin,
the rest is its value, and a bin keeps its least value.  Bins that stay empty are filled by optimal
densification: each bin has a random order of all bins, the same for every text, and takes the value of
the first full one in it, so a filled bin agrees between two texts with the probability of their
similarity, independently of the others.  Of each value the low ``BITS`` bits are stored, packed.  Two
different values agree in them by chance once in ``2 ** BITS`` times, which ``likeness`` takes out.

``with_next`` holds every text against an edited form, whose ending is the start of the next document's,
and against the next document.  The rows are range-sorted by descending id and read once; a row waits for
the one behind it, and the last row of a partition meets the first of the next in a join of one row per
partition.

Semantics: null texts count as empty; a text without words has the empty fingerprint, equal to that of
others without words and unlike all else; a text of under five words is one shingle of all its words;
texts are whole, of any length.  Null ids come last; rows that share an id follow in order of a hash of
their text; after the last row comes the first, which with one row is itself.  An empty table gives no
rows; extra columns are kept by ``fingerprint`` and left out by ``with_next``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tindra.llm import kernel, shared

SHINGLE, BINS, BITS = 5, 256, 4
ROWS = 2000  # texts whose bins are in memory at once
FEW = 16  # full bins up to which the nearest is looked for among the full ones, not along the order


def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For every bin all bins in its random order, and the place of each in it."""
    rng = np.random.default_rng(bins)
    order = np.array([rng.permutation(bins) for _ in range(bins)], np.int64)
    return order, np.argsort(order, axis=1)


_ORDER, _PLACE = _orders(BINS)


def bins_of(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts x bins: the least value of each, and which are full."""
    s, _, h = kernel.spans(off, data, kernel.WORDS)
    border = kernel.owners(off, s)
    count = np.diff(border)
    n = len(off) - 1
    value, full = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64), np.zeros(n * BINS, bool)
    hashes, owner = [], []
    long = np.flatnonzero(count >= SHINGLE)
    if len(long):  # all texts at once: no shingle starts in the last words of a text
        every = kernel.shingles(h, SHINGLE)
        lens = count[long] - SHINGLE + 1
        hashes.append(every[kernel.ragged(border[:-1][long], lens)])
        owner.append(np.repeat(long, lens))
    for k in np.flatnonzero((count > 0) & (count < SHINGLE)).tolist():
        hashes.append(kernel.shingles(h[border[k] : border[k + 1]], SHINGLE))
        owner.append(np.array([k]))
    if hashes:
        x, at = np.concatenate(hashes), np.concatenate(owner)
        cell = at * BINS + (x >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)
        np.minimum.at(value, cell, x)
        full[cell] = True
    return value.reshape(n, BINS), full.reshape(n, BINS)


def densify(value: np.ndarray, full: np.ndarray) -> np.ndarray:
    """``value`` with the empty bins filled; texts without a full bin stay as they are."""
    out, count = value.copy(), full.sum(axis=1)
    few = np.flatnonzero((count > 0) & (count <= FEW))
    for m in np.unique(count[few]).tolist():
        rows = few[count[few] == m]
        have = np.nonzero(full[rows])[1].reshape(len(rows), m)
        nearest = _PLACE[:, have].argmin(axis=2).T  # texts x bins: which of the full ones
        filled = np.take_along_axis(value[rows], np.take_along_axis(have, nearest, axis=1), axis=1)
        out[rows] = np.where(full[rows], value[rows], filled)
    row, bin_ = np.nonzero(~full & (count > FEW)[:, None])
    for step in range(BINS):
        if not len(row):
            break
        probe = _ORDER[bin_, step]
        hit = full[row, probe]
        out[row[hit], bin_[hit]] = value[row[hit], probe[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    return out


def fingerprints(texts: pa.Array) -> list[bytes]:
    """Packed fingerprints, empty for texts without words."""
    value, full = bins_of(*kernel.buffers(texts))
    low = (kernel.mix(densify(value, full)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    bits = (low[:, :, None] >> np.arange(BITS, dtype=np.uint8)) & np.uint8(1)
    packed = np.packbits(bits.reshape(len(low), BINS * BITS), axis=1)
    return [r.tobytes() if some else b"" for r, some in zip(packed, full.any(axis=1).tolist())]


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    for piece in kernel.slices(batch, column):
        for lo in range(0, piece.num_rows, ROWS):
            yield piece.slice(lo, ROWS)


def fingerprint(docs: DataFrame, text_column: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with its texts' fingerprints (binary), in place of a column of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, text_column):
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(fingerprints(piece.column(text_column)), pa.binary())], [*piece.schema.names, into])

    kept = docs.drop(into)
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(into, BinaryType())]))


def likeness(a: list[bytes | None], b: list[bytes | None]) -> np.ndarray:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1: 1 for equal fingerprints, 0 where only
    one is empty, NaN where one is missing."""
    out = np.zeros(len(a))
    out[[k for k, (x, y) in enumerate(zip(a, b)) if x is not None and x == y]] = 1.0
    out[[k for k, (x, y) in enumerate(zip(a, b)) if x is None or y is None]] = np.nan
    rows = [k for k, (x, y) in enumerate(zip(a, b)) if x and y and x != y]
    if rows:
        x, y = (np.unpackbits(np.frombuffer(b"".join(s[k] for k in rows), np.uint8).reshape(len(rows), -1), axis=1).reshape(len(rows), BINS, BITS) for s in (a, b))
        same, chance = (x == y).all(axis=2).mean(axis=1), 2.0**-BITS
        out[rows] = np.clip((same - chance) / (1 - chance), 0, 1)
    return out


_COMPARED = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(texts: list[str], prints: list[bytes], next_texts: list[str], next_prints: list[bytes]) -> list[pa.Array]:
    """The columns of ``_COMPARED``."""
    n = [len(x) for x in texts]
    edited = [(x[: k - k // 3] + y[: k // 3]).encode() for x, y, k in zip(texts, next_texts, n)]
    changed = fingerprints(pa.array(edited, pa.binary()))
    binary = lambda x: pa.array(x, pa.binary())
    return [pa.array(n, pa.int64()), binary([hashlib.sha256(x).digest() for x in edited]), binary(prints), binary(changed), pa.array(likeness(prints, changed)), pa.array(likeness(prints, next_prints))]


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_chars (code points), edited_sha256 (of the text whose last third is the start of the next
    document), fingerprint, edited_fingerprint, near_edited and near_next (likeness to the edited and the
    next text's)."""
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.col("hash").asc()]
    dealt = one.withColumn("hash", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        names = ["part", "edge", "id", "text", *(x.split()[0] for x in _COMPARED.split(", "))]

        def edge(which: str, row: tuple[pa.Array, str, bytes]) -> pa.RecordBatch:
            own, text, mark = row
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([which]), own, pa.array([text]), *none, pa.array([mark], pa.binary()), pa.nulls(1, pa.binary()), *[pa.nulls(1, pa.float64())] * 2], names)

        for batch in batches:
            for piece in _pieces(batch, "text"):
                ids, texts, prints = piece.column("id"), piece.column("text").to_pylist(), fingerprints(piece.column("text"))
                if held is None:
                    yield edge("first", (ids.slice(0, 1), texts[0], prints[0]))
                else:
                    ids, texts, prints = pa.concat_arrays([held[0], ids]), [held[1], *texts], [held[2], *prints]
                k = len(texts) - 1
                if k:
                    cols = _compared(texts[:-1], prints[:-1], texts[1:], prints[1:])
                    yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.nulls(k, pa.string()), ids.slice(0, k), pa.nulls(k, pa.string()), *cols], names)
                held = ids.slice(k, 1), texts[k], prints[k]
        if held is not None:
            yield edge("last", held)

    found = shared.settle(dealt.mapInArrow(run, f"part int, edge string, id {kind}, text string, {_COMPARED}"), "fingerprints")
    parts = sorted(r.part for r in found.where("edge = 'last'").select("part").collect())  # a number per partition
    behind = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, behind int")
    last = found.where("edge = 'last'").select("part", "id", "text", "fingerprint").join(F.broadcast(behind), "part")
    first = found.where("edge = 'first'").select(F.col("part").alias("behind"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    met = last.join(first, "behind").select("id", "text", "fingerprint", "next_text", "next_fingerprint")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                cols = _compared(*(row.column(c).to_pylist() for c in ("text", "fingerprint", "next_text", "next_fingerprint")))
                yield pa.RecordBatch.from_arrays([row.column("id"), *cols], ["id", *(x.split()[0] for x in _COMPARED.split(", "))])

    whole = found.where("edge IS NULL").drop("part", "edge", "text").unionByName(met.mapInArrow(close, f"id {kind}, {_COMPARED}"))
    return whole.withColumnRenamed("id", id_column)
