"""Quality: histogram gradient-boosted trees over document statistics.

Every text gives ``len(NAMES)`` statistics, computed for many texts at once from byte classes, word
hashes and lines.  Trees are grown on quantile bins of a bounded sample of labelled rows
(``TRAIN_DOCS``) with logistic loss; gradient histograms come from one ``bincount`` per level.  The
fitted trees are flattened to arrays (feature, threshold, children, value), and all texts of a slice
walk all trees level by level with numpy gathers.

Semantics: null and empty texts have all statistics 0 and are scored like others; a null id is kept;
rows that share an id are scored apart; an id with different labels is left out of the training;
without labels of both kinds every score is the labels' mean (0 without any); extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.llm import kernel, shared, toxicity
from tindra.llm.toxicity import CUT, sigmoid

TRAIN_DOCS = 10_000  # bound of the labelled sample
TREES, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 60, 4, 32, 0.2, 10, 1.0

NAMES = (
    "log_bytes log_words word_bytes lower upper digit space newline stop comma quote_dash exclaim symbol pipe wide "
    "same_next distinct_words distinct_pairs top_word function_words short_words long_words line_bytes capital_words sentence_words"
).split()
_CLASSES = 13


def _byte_classes() -> np.ndarray:
    """0 lower, 1 upper, 2 digit, 3 space, 4 newline, 5 stop, 6 comma, 7 quote or dash, 8 exclaim,
    9 other symbol, 10 pipe, 11 beyond ASCII, 12 control."""
    out = np.full(256, 12, np.uint8)
    for b in range(33, 127):
        c = chr(b)
        out[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 9
    for chars, k in ((" \t", 3), ("\n", 4), (".", 5), (",;:", 6), ("'\"-()", 7), ("!?", 8), ("|", 10)):
        out[[ord(c) for c in chars]] = k
    out[128:] = 11
    return out


CLASSES = _byte_classes()
_function: list[tuple[np.ndarray, np.ndarray]] = []


def statistics(texts: pa.Array) -> np.ndarray:
    """Texts x statistics, float32."""
    off, data = kernel.buffers(texts)
    n = len(off) - 1
    size = np.diff(off)
    per = np.maximum(size, 1)[:, None]
    doc_of_byte = np.repeat(np.arange(n, dtype=np.int64), size)
    counts = np.bincount(doc_of_byte * _CLASSES + CLASSES[data], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(np.float64)
    s, e, h = kernel.spans(off, data, kernel.CHUNKS)
    _, _, words = kernel.spans(off, data, kernel.WORDS)
    border = kernel.owners(off, s)
    m = np.diff(border)
    doc = np.repeat(np.arange(n, dtype=np.int64), m)
    each = np.maximum(m, 1)
    total = lambda flags: np.bincount(doc, weights=flags, minlength=n)
    length = e - s
    inner = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & inner if len(h) else 0

    def distinct(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and the largest count of one, by text."""
        key = kernel.mix(keys ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        u, first, count = np.unique(key, return_index=True, return_counts=True)
        own = owner[first]
        top = np.zeros(n)
        np.maximum.at(top, own, count)
        return np.bincount(own, minlength=n), top

    d1, top = distinct(h, doc)
    pairs = np.flatnonzero(inner)
    d2, _ = distinct(h[pairs] * np.uint64(31) + h[pairs + 1], doc[pairs])
    if not _function:
        _function.append(toxicity._language_table())
    keys, langs = _function[0]
    slot = (words & np.uint64(len(keys) - 1)).astype(np.int64)
    w_border = np.searchsorted(kernel.spans(off, data, kernel.WORDS, hashes=False)[0], off)
    w_doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(w_border))
    function = np.bincount(w_doc, weights=(keys[slot] == words) & (langs[slot] > 0), minlength=n)
    capital = total((CLASSES[data[s]] == 1).astype(float)) if len(s) else np.zeros(n)
    lines = counts[:, 4] + 1
    share = counts / per
    cols = [np.log1p(size), np.log1p(m), total(length.astype(float)) / each, *share.T[:12], total(same) / each, d1 / each, d2 / np.maximum(m - 1, 1), top / each, function / np.maximum(np.diff(w_border), 1), total((length <= 3).astype(float)) / each, total((length >= 15).astype(float)) / each, np.log1p(size / lines), capital / each, np.log1p(m / (counts[:, 5] + counts[:, 8] + 1))]
    return np.stack(cols, axis=1).astype(np.float32)


@dataclass
class Forest:
    """Flattened trees: node arrays of all trees, leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int = DEPTH
    constant: float | None = None
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go_left = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(go_left, self.left[node], self.right[node])
        return self.value[node].sum(axis=1) + self.base

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return sigmoid(self.logits(x) + self.shift)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Forest:
    """Grows the trees on four fifths of the rows and places the threshold on the rest."""
    n = len(y)
    mean = float(y.mean()) if n else 0.0
    none = np.zeros(0)
    if mean in (0.0, 1.0) or n < 10:
        return Forest(none, none, none, none, none, none, 0.0, constant=mean)
    order = np.random.default_rng(seed).permutation(n)
    held, rows = order[: n // 5], order[n // 5 :]
    edges = [np.unique(np.quantile(x[rows, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(edges[f], x[rows, f], "left") for f in range(x.shape[1])], axis=1)
    target = y[rows].astype(np.float64)
    base = float(np.log(mean / (1 - mean)))
    logit = np.full(len(rows), base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(TREES):
        p = sigmoid(logit)
        grad, hess = target - p, p * (1 - p)
        roots.append(len(nodes))
        at = np.full(len(rows), len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        level = [len(nodes) - 1]
        for depth in range(DEPTH + 1):
            nxt = []
            place = {k: i for i, k in enumerate(level)}
            local = np.array([place.get(k, -1) for k in range(roots[-1], len(nodes))])[at - roots[-1]]
            on = local >= 0
            width = x.shape[1]
            key = ((local[on, None] * width + np.arange(width)) * BINS + binned[on]).ravel()
            hist = [np.bincount(key, weights=np.repeat(w[on], width), minlength=len(level) * width * BINS).reshape(len(level), width, BINS) for w in (grad, hess, np.ones(len(rows)))]
            for i, k in enumerate(level):
                g, h, c = (t[i] for t in hist)
                gs, hs, cs = g[0].sum(), h[0].sum(), c[0].sum()
                nodes[k][4] = RATE * gs / (hs + RIDGE)
                if depth == DEPTH or cs < 2 * LEAST_ROWS:
                    continue
                gl, hl, cl = (np.cumsum(t, axis=1) for t in (g, h, c))
                gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
                gain[(cl < LEAST_ROWS) | (cs - cl < LEAST_ROWS)] = -1
                f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                    continue
                left, right = len(nodes), len(nodes) + 1
                nodes += [[0, np.inf, left, left, 0.0], [0, np.inf, right, right, 0.0]]
                nodes[k][:4] = [int(f), float(edges[f][b]), left, right]
                mine = at == k
                at[mine] = np.where(binned[mine, f] <= b, left, right)
                nxt += [left, right]
            level = nxt
            if not level:
                break
        value = np.array([v[4] for v in nodes[roots[-1] :]])
        logit += value[at - roots[-1]]
    cols = list(zip(*nodes))
    forest = Forest(np.array(cols[0]), np.array(cols[1], np.float32), np.array(cols[2]), np.array(cols[3]), np.array(cols[4]), np.array(roots), base)
    if 0 < y[held].sum() < len(held):
        # the positive label is good text here: the middle of the best gap, as for the classifier above
        forest.shift = float(np.log(CUT / (1 - CUT))) - toxicity.best_cut(forest.logits(x[held]), y[held])
    return forest


def train(docs: DataFrame, labels: DataFrame, label_column: str, usable, id_column: str = "doc_id", text_column: str = "text") -> Forest:
    """Fits on at most ``TRAIN_DOCS`` labelled rows for which ``usable`` holds; only their statistics
    come to the driver, as many rows as the bound even where documents share an id."""
    sample = shared.bounded_sample(toxicity.consistent(labels, label_column, usable, id_column), "doc_id", TRAIN_DOCS)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")

    def run(batches):
        for batch in batches:
            for piece in kernel.slices(batch, "text"):
                x = statistics(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "label", "x"])

    stats = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, x array<float>")
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id"), F.xxhash64("x")]
    got = stats.orderBy(*order).limit(TRAIN_DOCS).toArrow()
    x = np.array(got.column("x").to_pylist(), np.float32).reshape(got.num_rows, len(NAMES))
    return fit(x, np.asarray(got.column("label")).astype(np.float64))


def score(docs: DataFrame, forest: Forest, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and score of every row; narrow, no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(forest)  # fixed size
    return toxicity._scored(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")), lambda part: shipped.value.score(statistics(part)))
