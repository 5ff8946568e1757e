"""Order-preserving packing of token streams into windows by dynamic programming.

Within a task the documents form one stream, in ascending doc_id.  A window is a stretch of at most
``limit`` ids.  Windows may be cut at document borders (free), at sentence ends and, where a
sentence is longer than a window, anywhere.  A partition of the stream costs, per window, its padding
(``limit`` less its length, nothing where the length is a power of two), a fixed price, which keeps
unpadded short windows from being chosen where a full one would do, and the penalty of the cut that
closes it.  With g(i) = cost(i) + position(i) the best predecessor of a cut
is the least g within the last ``limit`` ids, which a monotone queue gives in constant amortised
time; unpadded windows of a power of two are a few extra lookups per cut.

The stream is solved in blocks: all windows but the last ones of a block are final, the rest goes
to the next block, so memory does not grow with the task.  The tail of a task is cut into powers of
two, which need no padding.

Semantics: null text is the empty text (the end id alone); null doc_ids sort first; repeated doc_ids
are separate documents; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.llm import kernel, tokens

LIMIT = 2048
WINDOW_PRICE = 128
SENTENCE_PENALTY = 8
FORCED_PENALTY = 64
BLOCK_WINDOWS = 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def plan_cuts(cuts: np.ndarray, penalty: np.ndarray, limit: int = LIMIT) -> list[int]:
    """Positions of the window ends of the cheapest partition of [0, cuts[-1]).

    ``cuts`` ascend, end where the stream ends, and are at most ``limit`` apart."""
    pos = [0, *cuts.tolist()]
    pen = [0, *penalty.tolist()]
    powers = [1 << k for k in range(5, limit.bit_length()) if 1 << k < limit]
    index = {p: i for i, p in enumerate(pos)}
    n = len(pos)
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        at = pos[j]
        low = at - limit
        while pos[queue[0][1]] < low:
            queue.popleft()
        g, i = queue[0]
        best, via = g + limit - at, i
        for p in powers:
            k = index.get(at - p)
            if k is not None and cost[k] < best:
                best, via = cost[k], k
        best += WINDOW_PRICE + pen[j]
        cost[j], back[j] = best, via
        g = best + at
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, j))
    ends = []
    j = n - 1
    while j:
        ends.append(pos[j])
        j = back[j]
    return ends[::-1]


def with_forced(cuts: np.ndarray, penalty: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Adds forced cuts where two cuts are more than ``limit`` ids apart."""
    gap = np.diff(np.concatenate(([0], cuts)))
    wide = np.flatnonzero(gap > limit)
    if not len(wide):
        return cuts, penalty
    more = np.concatenate([np.arange(cuts[w] - gap[w] + limit, cuts[w], limit) for w in wide])
    at = np.searchsorted(cuts, more)
    return np.insert(cuts, at, more), np.insert(penalty, at, FORCED_PENALTY)


def tail_powers(length: int) -> list[int]:
    """The length as descending powers of two."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


class Stream:
    """Packs documents that arrive in order; ``rows`` takes the finished pieces."""

    def __init__(self, part: int, limit: int):
        self.limit, self.next = limit, part << 33
        self.ids: list[np.ndarray] = []
        self.cuts: list[np.ndarray] = []
        self.pens: list[np.ndarray] = []
        self.docs: list[tuple] = []  # doc_id, begin in the buffer (may be negative), ids
        self.size = 0
        self.rows: list[list] = [[] for _ in range(7)]

    def add(self, doc_ids: list, border: np.ndarray, ids: np.ndarray, stops: np.ndarray) -> None:
        """Documents with their ids; ``stops`` are the sentence ends."""
        stops = np.setdiff1d(stops, border)
        cuts = np.concatenate((border[1:], stops))
        pens = np.concatenate((np.zeros(len(border) - 1, np.int64), np.full(len(stops), SENTENCE_PENALTY)))
        order = np.argsort(cuts, kind="stable")
        self.cuts.append(cuts[order] + self.size)
        self.pens.append(pens[order])
        self.ids.append(ids)
        self.docs += zip(doc_ids, (border[:-1] + self.size).tolist(), np.diff(border).tolist())
        self.size += len(ids)
        if self.size >= BLOCK_WINDOWS * self.limit:
            self.solve(False)

    def solve(self, last: bool) -> None:
        if not self.size:
            return
        ids, cuts, pens = (np.concatenate(x) for x in (self.ids, self.cuts, self.pens))
        dp_cuts, dp_pens = with_forced(cuts, pens, self.limit)
        ends = plan_cuts(dp_cuts, dp_pens, self.limit)
        if last:
            begin = ends[-2] if len(ends) > 1 else 0
            length = ends[-1] - begin
            if length < self.limit:
                ends[-1:] = (begin + np.cumsum(tail_powers(length))).tolist()
        else:
            keep = [e for e in ends if e <= self.size - 2 * self.limit]
            ends = keep or ends[:1]
        self.emit(ids, ends)
        done = ends[-1]
        left = cuts > done
        self.ids, self.cuts, self.pens = [ids[done:]], [cuts[left] - done], [pens[left]]
        self.docs = [(d, b - done, n) for d, b, n in self.docs if b + n > done]
        self.size -= done

    def emit(self, ids: np.ndarray, ends: list[int]) -> None:
        raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
        d, a = 0, 0
        for b in ends:
            first = a
            while a < b:
                doc, begin, n = self.docs[d]
                stop = min(b, begin + n)
                row = (doc, a - begin, stop - a, zlib.crc32(raw[4 * a : 4 * stop]), n, self.next, a - first)
                for col, x in zip(self.rows, row):
                    col.append(x)
                if stop == begin + n:
                    d += 1
                a = stop
            self.next += 1

    def take(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in self.rows], names)
        self.rows = [[] for _ in range(7)]
        return out


def pack(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of the packed windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    No shuffle: every task packs the rows it reads, in ascending id; a window never crosses tasks."""
    vocabulary = vocabulary or tokens.default_vocabulary()
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    ordered = picked.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, stream = tokens.tokenizer(vocabulary), Stream(TaskContext.get().partitionId(), limit)
        for batch in batches:
            for piece in kernel.slices(batch, "text"):
                ids, border, stops = tok.encode(piece.column("text"), sentences=True)
                ids, end_border = tokens.with_end(ids, border)
                stops = stops + np.searchsorted(border[1:], stops, "left")  # the end ids before each
                stream.add(piece.column("doc_id").to_pylist(), end_border, ids, stops)
                if len(stream.rows[0]) >= 8192:
                    yield stream.take()
        stream.solve(True)
        if stream.rows[0]:
            yield stream.take()

    return ordered.mapInArrow(run, SCHEMA)
