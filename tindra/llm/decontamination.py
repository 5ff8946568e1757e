"""Benchmark decontamination: BM25 over test items, block-max WAND, overlap of question and answer.

The test items (long ones in segments, which together cover every word) form an inverted index.  An item's BM25 impacts are divided by
their sum, so a passage that holds every word of an item scores 1 for it.  Every document is cut into
overlapping passages of ``2 * step`` words, wide enough that any segment lies inside one, and every
passage is a query.  All passages of a slice run together, in the three steps of block-max WAND:

1. Terms are split as WAND's pivot does: common terms whose impacts in any one item sum to at most
   ``SLACK`` cannot lift a passage over the threshold alone, so only the other terms open candidates.
2. The largest impacts of a term within blocks of ``ITEMS_PER_BLOCK`` items bound a passage's score in
   a block; blocks under ``THRESHOLD - SLACK`` are skipped.
3. The blocks left are scored exactly, and everything at or over ``THRESHOLD`` is retrieved.

A retrieved pair is verified on word bigrams: of the item's question and of its answer (the last
sentence; without several sentences the last third) the shares found in the passage and its
neighbourhood: a step, or the whole item's length if that is more, on both sides.

Items come to the driver in shards of at most ``SHARD_CHARS`` characters; a larger benchmark takes
more passes, so what a task receives is bounded.

Semantics: null or empty items and documents match nothing; rows that share an id are judged apart and
give a row per text; null ids stay null in the result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.llm import kernel

K1, B = 1.2, 0.75
THRESHOLD, SLACK, ITEMS_PER_BLOCK, SEGMENT = 0.6, 0.2, 16, 96
OVERLAP, PART_OVERLAP = 0.6, 0.4
SHARD_CHARS = 16_000_000
PAIRS = 1 << 22  # cells of a passages x blocks strip
SCHEMA = "doc_id long, item_id long, passage long, score double, question_overlap double, answer_overlap double, overlap double"


def bigrams(h: np.ndarray) -> np.ndarray:
    return np.unique(kernel.shingles(h, 2))


@dataclass
class Index:
    step: int
    terms: np.ndarray  # hashes, ascending
    first: np.ndarray  # per value of a hash's top bits, the first term that has it
    essential: np.ndarray
    cell_start: np.ndarray  # per term, its (term, block) cells
    cell_block: np.ndarray
    cell_max: np.ndarray
    post_start: np.ndarray  # per cell, its postings
    post_item: np.ndarray
    post_impact: np.ndarray
    blocks: int
    item_of: list
    words: list  # per segment, the length of its whole item
    question: list
    answer: list

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for words that no item has."""
        top = (h >> np.uint64(65 - len(self.first).bit_length())).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        out = np.full(len(h), -1, np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            same = self.terms[at[live]] == h[live]
            out[live[same]] = at[live[same]]
            at[live] += 1
            live = live[~same & (at[live] < end[live])]
        return out


def split_item(text: str, h: np.ndarray, ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of question and answer; ``ends`` are the word counts at sentence ends."""
    inner = [e for e in ends if 0 < e < len(h)]
    cut = inner[-1] if inner else max(1, len(h) * 2 // 3)
    return h[:cut], h[cut:]


def build(ids: list, texts: list[str]) -> Index | None:
    """The inverted index of items with words."""
    off, data = kernel.buffers(pa.array(texts, pa.string()))
    s, e, h = kernel.spans(off, data, kernel.WORDS)
    border = kernel.owners(off, s)
    seg_words, item_of, words, question, answer = [], [], [], [], []
    raw = data.tobytes()
    for k in range(len(texts)):
        a, b = int(border[k]), int(border[k + 1])
        if a == b:
            continue
        ends = [j + 1 - a for j in range(a, b) if raw[e[j] : e[j] + 1] in (b".", b"?", b"!")]
        q, r = (bigrams(x) for x in split_item(texts[k], h[a:b], ends))
        for lo in range(a, b, SEGMENT):
            if b - lo < SEGMENT // 4:  # a short rest takes words of the segment before along
                lo = max(a, b - SEGMENT)
            seg_words.append(h[lo : min(b, lo + SEGMENT)])
            item_of.append(ids[k])
            words.append(b - a)
            question.append(q)
            answer.append(r)
    if not seg_words:
        return None
    n = len(seg_words)
    owner = np.repeat(np.arange(n), [len(x) for x in seg_words])
    terms, term = np.unique(np.concatenate(seg_words), return_inverse=True)
    key, tf = np.unique(term * n + owner, return_counts=True)
    term, owner = key // n, key % n
    df = np.bincount(term, minlength=len(terms))
    length = np.array([len(x) for x in seg_words])
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / length.mean()))
    impact = impact / np.bincount(owner, weights=impact, minlength=n)[owner]
    # non-essential terms: commonest first, while no item's sum of their impacts passes SLACK
    essential = np.ones(len(terms), bool)
    held = np.zeros(n)
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    for t in np.argsort(-df, kind="stable"):
        p = slice(first[t], first[t + 1])
        if df[t] < 2 or (held[owner[p]] + impact[p]).max() > SLACK:
            break
        held[owner[p]] += impact[p]
        essential[t] = False
    cell = term * (n // ITEMS_PER_BLOCK + 1) + owner // ITEMS_PER_BLOCK
    start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    top = max(12, (2 * len(terms) - 1).bit_length())  # two slots a term, whatever their number
    slots = np.searchsorted(terms >> np.uint64(64 - top), np.arange((1 << top) + 1, dtype=np.uint64)).astype(np.int32)
    return Index(
        max(64, min(SEGMENT, int(length.max()))), terms, slots, essential, np.searchsorted(term[start], np.arange(len(terms) + 1)), owner[start] // ITEMS_PER_BLOCK,
        np.maximum.reduceat(impact, start), np.append(start, len(cell)), owner, impact, n // ITEMS_PER_BLOCK + 1, item_of, words, question, answer,
    )


def retrieve(ix: Index, h: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage number, segment, score) at or over the threshold; passages are numbered over all
    documents, ``passages`` per document."""
    term = ix.lookup(h)
    hit = np.flatnonzero(term >= 0)
    count = passages(ix, border)
    base = np.concatenate(([0], np.cumsum(count)))
    doc = np.searchsorted(border, hit, "right") - 1
    w = (hit - border[doc]) // ix.step
    both = [(base[doc] + x, term[hit], (x >= 0) & (x < count[doc])) for x in (w, w - 1)]
    win = np.concatenate([x[ok] for x, _, ok in both])
    trm = np.concatenate([t[ok] for _, t, ok in both])
    if not len(win):
        return win, win, np.zeros(0)
    lively = np.zeros(int(base[-1]), bool)
    lively[win[ix.essential[trm]]] = True
    ok = lively[win]
    pair = np.unique(win[ok] * len(ix.terms) + trm[ok])
    win, trm = pair // len(ix.terms), pair % len(ix.terms)
    strip = max(1, PAIRS // ix.blocks)
    out: list[tuple] = []
    lo = 0
    while lo < len(win):
        first = int(win[lo])
        hi = int(np.searchsorted(win, first + strip))
        out.append(_strip(ix, win[lo:hi] - first, trm[lo:hi], first))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (win[:0], win[:0], np.zeros(0))


def _strip(ix: Index, win: np.ndarray, trm: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keep = ix.essential[trm]
    n_cells = ix.cell_start[trm + 1] - ix.cell_start[trm]
    c = kernel.ragged(ix.cell_start[trm[keep]], n_cells[keep])
    key = np.repeat(win[keep], n_cells[keep]) * ix.blocks + ix.cell_block[c]
    bound = np.bincount(key, weights=ix.cell_max[c], minlength=(int(win[-1]) + 1) * ix.blocks)
    alive = bound >= THRESHOLD - SLACK - 1e-9
    wins = np.unique(np.flatnonzero(alive) // ix.blocks)
    here = np.isin(win, wins)
    c = kernel.ragged(ix.cell_start[trm[here]], n_cells[here])
    own = np.repeat(win[here], n_cells[here])
    live = alive[own * ix.blocks + ix.cell_block[c]]
    c, own = c[live], own[live]
    size = ix.post_start[c + 1] - ix.post_start[c]
    p = kernel.ragged(ix.post_start[c], size)
    n = len(ix.item_of)
    key, inv = np.unique(np.repeat(own, size) * n + ix.post_item[p], return_inverse=True)
    score = np.bincount(inv, weights=ix.post_impact[p], minlength=len(key))
    top = score >= THRESHOLD - 1e-9
    return key[top] // n + first, key[top] % n, score[top]


def passages(ix: Index, border: np.ndarray) -> np.ndarray:
    """Passages per document: 2 * step words each, a new one every step words."""
    m = np.diff(border)
    return np.where(m > 0, np.maximum(1, -(-(m - 2 * ix.step) // ix.step) + 1), 0)


def matches(ix: Index, texts: pa.Array) -> list[tuple]:
    """(text, item, passage, score, question, answer and whole overlap), best passage per pair."""
    off, data = kernel.buffers(texts)
    s, _, h = kernel.spans(off, data, kernel.WORDS)
    border = kernel.owners(off, s)
    win, seg, score = retrieve(ix, h, border)
    base = np.concatenate(([0], np.cumsum(passages(ix, border))))
    best: dict[tuple, tuple] = {}
    for w, k, x in zip(win.tolist(), seg.tolist(), score.tolist()):
        d = int(np.searchsorted(base, w, "right")) - 1
        at = border[d] + (w - base[d]) * ix.step
        margin = max(ix.step, ix.words[k])
        around = h[max(border[d], at - margin) : min(border[d + 1], at + 2 * ix.step + margin)]
        near = np.concatenate((bigrams(around), kernel.mix(around)))  # a part of one word is its own gram
        q, a = (float(np.isin(part, near).mean()) if len(part) else 1.0 for part in (ix.question[k], ix.answer[k]))
        n_q, n_a = len(ix.question[k]), len(ix.answer[k])
        whole = (q * n_q + a * n_a) / max(1, n_q + n_a)
        if whole < OVERLAP or min(q, a) < PART_OVERLAP:
            continue
        key = (d, ix.item_of[k])
        row = (w - int(base[d]), x, q, a, whole)
        if key not in best or (row[4], row[1], -row[0]) > (best[key][4], best[key][1], -best[key][0]):
            best[key] = row
    return [(*key, *row) for key, row in best.items()]


def shards(items: DataFrame, id_column: str, text_column: str) -> list[Index]:
    """Indexes of bounded parts of the benchmark."""
    named = items.select(F.col(id_column).cast("long").alias("item_id"), F.col(text_column).cast("string").alias("text")).where("text IS NOT NULL AND length(text) > 0").distinct()
    chars = named.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars * 2 // SHARD_CHARS)) if chars > SHARD_CHARS else 1
    out = []
    for k in range(n):
        part = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        if ix := build(part.column("item_id").to_pylist(), part.column("text").to_pylist()):
            out.append(ix)
    return out


def find_leaks(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document and test item that it holds; narrow passes over the documents."""
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    spark = docs.sparkSession

    def one(ix: Index) -> DataFrame:
        shipped = spark.sparkContext.broadcast(ix)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in kernel.slices(batch, "text"):
                    if rows := matches(shipped.value, piece.column("text")):
                        d, *rest = zip(*rows)
                        cols = [piece.column("doc_id").take(pa.array(d, pa.int64())), pa.array(rest[0], pa.int64()), pa.array(rest[1], pa.int64()), *(pa.array(x, pa.float64()) for x in rest[2:])]
                        yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCHEMA.split(", ")])

        return picked.mapInArrow(run, SCHEMA)

    found = [one(ix) for ix in shards(items, item_id, item_text)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SCHEMA)


def drop_leaks(docs: DataFrame, items: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns; narrow, no shuffle."""
    spark = docs.sparkSession

    def without(kept: DataFrame, ix: Index) -> DataFrame:
        shipped = spark.sparkContext.broadcast(ix)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in kernel.slices(batch, text_column):
                    clean = np.ones(piece.num_rows, bool)
                    clean[[row[0] for row in matches(shipped.value, piece.column(text_column))]] = False
                    yield piece.filter(pa.array(clean))

        return kept.mapInArrow(run, kept.schema)

    return reduce(without, shards(items, item_id, item_text), docs)
