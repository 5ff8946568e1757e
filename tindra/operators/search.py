"""A substring index: which blocks of items hold which three letters.

``store`` sorts the items by id, cuts them into blocks and writes them with their folded name and story
(ASCII letters in upper case), and, beside the items, a posting table: for every three letters that stand
side by side in a folded text, the sorted numbers of the blocks where they do.  The pieces of a block are
taken from the code points of its texts, many texts at once.  ``search`` takes the wanted text's own three-letter pieces, reads their
postings - the table is sorted by piece, so the scan skips the rest -, intersects the rarest, and reads
the blocks that are left; LIKE on their folded texts decides.  A text without three letters in a row between its
wildcards is looked for in all items, as ``catalogue.search`` does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tindra.functions import text
from tindra.operators import catalogue

GRAM = 3
ITEMS = 64  # in a block
CHUNK = 4096  # blocks whose numbers stand in one row of the posting table
RAREST = 4  # pieces that are intersected
PUSHED = 500  # blocks that are named in the scan; more are joined
GROUP_BYTES = 4 << 20
FOLDED = ("_folded_name", "_folded_story")  # stored beside the items' own columns
TOGETHER = 1 << 21  # letters that are cut at once
HELD = 1 << 22  # pieces of blocks that a task holds before it passes them on


def _pieces_of(texts: list[str], blocks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The (piece, block) of some texts, few of them twice, a piece as three code points of 21 bits."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.array([len(t) for t in texts])
    ends = np.cumsum(size)
    whole = np.ones(len(points), bool)
    for k in range(1, GRAM):  # what would reach over a text's end
        whole[np.maximum(ends - k, 0)[ends >= k]] = False
    at = np.flatnonzero(whole)
    there = np.zeros(1 << 21, bool)
    there[points] = True
    letters = np.flatnonzero(there)
    rank = np.cumsum(there, dtype=np.uint32)[points] - np.uint32(1)
    numbers, owner = np.unique(np.array(blocks), return_inverse=True)
    most = len(numbers) * len(letters) ** GRAM
    if most >= 1 << 64 and len(texts) > 1:  # too many letters for one number
        halves = [_pieces_of(texts[a:b], blocks[a:b]) for a, b in ((0, len(texts) // 2), (len(texts) // 2, len(texts)))]
        return np.concatenate([h[0] for h in halves]), np.concatenate([h[1] for h in halves])
    kind = np.uint32 if most < 1 << 32 else np.uint64
    key, k = np.repeat(owner, size)[at].astype(kind), kind(len(letters))
    for j in range(GRAM):
        key = key * k + rank[at + j].astype(kind)
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    code = np.zeros(len(key), np.int64)
    for j in range(GRAM):
        code |= letters[(key % k).astype(np.int64)].astype(np.int64) << (21 * j)
        key //= k
    return code, numbers[key.astype(np.int64)]


def _posts(code: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    """A row per piece and chunk with its distinct blocks in order."""
    order = np.lexsort((block, code))
    code, block = code[order], block[order]
    new = np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1]))[: len(code)]
    code, block = code[new], block[new]
    chunk = block // CHUNK
    first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1]))) if len(code) else np.zeros(0, np.int64)
    letters = np.stack([code[first] >> (21 * (GRAM - 1 - j)) & ((1 << 21) - 1) for j in range(GRAM)], axis=1).astype("<u4")
    said = letters.tobytes().decode("utf-32-le", "surrogatepass")
    names = pa.array([said[i : i + GRAM] for i in range(0, len(said), GRAM)], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), pa.array(block))
    return pa.RecordBatch.from_arrays([names, pa.array(chunk[first]), lists], ["gram", "chunk", "blocks"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the rows (block, folded name, folded story), as far as a task sees them together."""
    texts, blocks, codes, numbers, letters, held = [], [], [], [], 0, 0

    def settled() -> None:
        nonlocal texts, blocks, letters, held
        if texts:
            code, number = _pieces_of(texts, blocks)
            codes.append(code)
            numbers.append(number)
            held += len(code)
        texts, blocks, letters = [], [], 0

    for batch in batches:
        number = batch.column("block").to_pylist()
        for c in FOLDED:
            for b, t in zip(number, batch.column(c)):
                t = t.as_py() or ""
                for i in range(0, max(len(t) - GRAM + 1, 0), TOGETHER):
                    part = t[i : i + TOGETHER + GRAM - 1]
                    if letters and letters + len(part) > TOGETHER:
                        settled()
                    texts.append(part)
                    blocks.append(b)
                    letters += len(part)
                if held > HELD:
                    yield _posts(np.concatenate(codes), np.concatenate(numbers))
                    codes, numbers, held = [], [], 0
    settled()
    if codes:
        yield _posts(np.concatenate(codes), np.concatenate(numbers))


def pieces(wanted: str) -> list[str]:
    """The pieces that every match of a LIKE text holds."""
    folded = "".join(chr(ord(x) - 32) if "a" <= x <= "z" else x for x in wanted.strip())
    if "\\" in folded:  # an escape: its reading is left to LIKE
        return []
    return sorted({part[i : i + GRAM] for part in re.split("[%_]", folded) for i in range(len(part) - GRAM + 1)})


def store(items: DataFrame, path: str, files: int | None = None) -> None:
    """Writes items and postings to the folder."""
    n = files or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spark = items.sparkSession
    # a block is a run of ids: ranges of the sorted table, numbered by file and place in it
    ranged = items.repartitionByRange(n, "id").sortWithinPartitions("id")
    file, place = F.spark_partition_id().cast("long"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    blocked = ranged.withColumn("block", F.shiftleft(file, 32) + F.floor(place / ITEMS).cast("long"))
    blocked = blocked.withColumns({c: text.fold(text.nonnull(F.col(own))) for c, own in zip(FOLDED, ("name", "story"))})
    blocked.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/items")
    stored = spark.read.parquet(f"{path}/items")
    cut = stored.select("block", *FOLDED).mapInArrow(_cut, "gram string, chunk long, blocks array<long>")
    posts = cut.groupBy("gram", "chunk").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocks")))).alias("blocks"))  # CHUNK at most
    posts.repartitionByRange(n, "gram", "chunk").sortWithinPartitions("gram", "chunk").write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/postings")


def candidates(spark: SparkSession, path: str, wanted: str) -> DataFrame | None:
    """The blocks (column block) that can hold a match; None where the index cannot tell."""
    asked = pieces(wanted)
    if not asked:
        return None
    posts = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(asked))
    sizes = {r.gram: r.n for r in posts.groupBy("gram").agg(F.sum(F.size("blocks")).alias("n")).collect()}  # a row per piece of the text
    if len(sizes) < len(asked):  # a piece that stands nowhere
        return posts.limit(0).select(F.lit(0).cast("long").alias("block"))
    rarest = sorted(asked, key=lambda g: (sizes[g], g))[:RAREST]
    found = posts.where(F.col("gram").isin(rarest)).select(F.explode("blocks").alias("block"))
    return found.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select("block")


def search(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """What ``catalogue.search`` finds in the stored items."""
    items = spark.read.parquet(f"{path}/items")
    blocks = candidates(spark, path, wanted) if len(wanted.strip()) > 1 else None
    if blocks is not None:
        few = [r.block for r in blocks.limit(PUSHED + 1).collect()]
        items = items.where(F.col("block").isin(few)) if len(few) <= PUSHED else items.join(blocks, "block", "left_semi")
    return items.where(catalogue.is_found(wanted, folded=FOLDED)).drop("block", *FOLDED)
