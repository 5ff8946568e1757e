"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A word is the sum of two hashed embeddings, one of the whole word and one of its first bytes (so
inflected forms of a stem share it).  Filters of several widths slide over the words of the whole
text, each keeps its largest activation, and a logistic layer reads those.  The loss gradient only
reaches the words under the largest activations, so training is cheap.

All labelled rows are learnt from: executors hash the whole texts to four bytes a word, a fifth of the
rows (by hash) is held for the thresholds, and the rest trains.  Training starts on the driver with a
bounded number of rows (the first in hashed order, at most ``TRAIN_DOCS`` of them and as many as hold
``TRAIN_WORDS`` words together; texts of over a hundredth of that come last), stochastic gradients with
Adam.  From there every task goes over its share of all training rows, and what the tasks have moved is
averaged, a word's embedding over the tasks that met it, ``ROUNDS`` times; sums are whole numbers, so
their order makes no difference.  Where the start had all training rows, no rounds follow.  Activations
are pooled strip by strip, so one very long text takes no more memory than many short ones.

Decision thresholds are calibrated per language on all held rows, counted by logit in steps of
1/``LEVELS``.  The language is guessed from function words in the text, never read from a column.  The
calibration shifts a language's logits so that its threshold lies at ``CUT``: score >= CUT means toxic.

Semantics: null and empty texts get the score of a text without words; a null id is kept (its
held_out is null); rows that share an id are scored apart; an id with different labels is left out of
the training; without labels of both kinds every score is the labels' mean (0 without any); extra
columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.llm import kernel, shared

TRAIN_DOCS, TRAIN_WORDS = 6000, 4_000_000  # bounds of the rows that training starts with
ROUNDS, ROUND_RATE = 2, 0.003  # passes over all training rows after that
BARE_ROUNDS = 8  # as many, at the full rate, where nothing could be learnt from the start
HELD = 5  # one row in so many is held for the thresholds
LEVELS = 1024  # steps of a logit that are counted apart
FIXED = 1 << 20  # moves are summed as whole numbers of 1 / FIXED
BATCH_WORDS = 1 << 20  # words of one batch, one longer text excepted
STRIP = 1 << 15  # words whose activations are held at once
CUT = 0.3
SLOTS, PREFIX_SLOTS, DIM, FILTERS, WIDTHS = 1 << 15, 1 << 14, 16, 8, (1, 2, 3)
PREFIX_BYTES = 4
STEPS, BATCH, RATE = 1100, 64, 0.01  # at most 40 and at least 4 passes over the sample
HASH_KEY = np.uint64(0x5851F42D4C957F2D)

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are as with be at by this an have from or had not but which you were",
    "de": "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei",
    "fr": "le la les des et en un une du que est pour qui dans au sur par pas plus avec ce se il sont ne ou aux mais nous",
    "es": "el los las del que y en un por con no una su para es al lo como más o pero sus le ha este sí porque esta entre",
}


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 12
    keys, lang = np.zeros(size, np.uint64), np.zeros(size, np.int8)
    for k, words in enumerate(FUNCTION_WORDS.values(), 1):
        off, data = kernel.buffers(pa.array([words]))
        for h in kernel.spans(off, data, kernel.WORDS)[2]:
            slot = int(h) & (size - 1)
            if keys[slot] == h:
                lang[slot] = 0  # shared between languages: says nothing
            elif keys[slot] == 0:
                keys[slot], lang[slot] = h, k
    return keys, lang


@dataclass
class Text:
    """Hashed words of some texts: word and prefix slots in one number each, borders, guessed language."""

    code: np.ndarray
    border: np.ndarray
    lang: np.ndarray

    def slots(self, at=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        return self.code[at] & np.uint32(SLOTS - 1), self.code[at] >> np.uint32(16)


_lang_table: list[tuple[np.ndarray, np.ndarray]] = []


def hashed(texts: pa.Array) -> Text:
    off, data = kernel.buffers(texts)
    s, e, h = kernel.spans(off, data, kernel.WORDS)
    border = kernel.owners(off, s)
    folded = kernel.WORDS[data]
    code = np.zeros(len(s), np.uint64)
    for k in range(PREFIX_BYTES):
        at = s + k
        ok = at < e
        code[ok] |= folded[at[ok]].astype(np.uint64) << np.uint64(8 * k)
    if not _lang_table:
        _lang_table.append(_language_table())
    keys, langs = _lang_table[0]
    slot = (h & np.uint64(len(keys) - 1)).astype(np.int64)
    said = np.where(keys[slot] == h, langs[slot], 0)
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(border))
    count = np.bincount(doc * 5 + said, minlength=5 * n).reshape(n, 5)[:, 1:]
    lang = np.where(count.max(axis=1, initial=0) > 0, count.argmax(axis=1) + 1, 0) if n else np.zeros(0, np.int64)
    code = (kernel.mix(code) & np.uint64(PREFIX_SLOTS - 1)) << np.uint64(16) | kernel.mix(h ^ HASH_KEY) & np.uint64(SLOTS - 1)
    return Text(code.astype(np.uint32), border, lang)


@dataclass
class Model:
    word: np.ndarray
    prefix: np.ndarray
    filters: np.ndarray  # DIM x (places of all widths * FILTERS)
    bias: np.ndarray  # len(WIDTHS) x FILTERS
    out: np.ndarray
    base: float
    constant: float | None = None
    shift: np.ndarray = field(default_factory=lambda: np.zeros(5))

    @staticmethod
    def start(rng: np.random.Generator, base: float) -> Model:
        f32 = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        places = sum(WIDTHS)
        # words start near 0, so that a word never trained on says nothing
        return Model(f32(SLOTS, DIM, s=0.01), f32(PREFIX_SLOTS, DIM, s=0.01), f32(DIM, places * FILTERS, s=0.3), np.zeros((len(WIDTHS), FILTERS), np.float32), f32(len(WIDTHS) * FILTERS, s=0.3), base)

    def pooled(self, text: Text, placed: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Per text and filter the largest activation, at least 0, and, if ``placed``, the word it starts
        at (missing words after a text's end count as 0)."""
        size = len(WIDTHS) * FILTERS
        top, place = np.zeros((len(text.border) - 1, size), np.float32), np.zeros((len(text.border) - 1, size), np.int64)
        n = len(text.code)
        for lo in range(0, n, STRIP):
            hi = min(n, lo + STRIP)
            word, prefix = text.slots(slice(lo, min(n, hi + max(WIDTHS) - 1)))
            y = (self.word[word] + self.prefix[prefix]) @ self.filters
            first, last = np.searchsorted(text.border, lo, "right") - 1, np.searchsorted(text.border, hi, "left")
            docs = np.arange(first, last)
            docs = docs[text.border[docs + 1] > text.border[docs]]
            starts = np.maximum(text.border[docs], lo) - lo
            ends = text.border[docs + 1] - lo
            owner = np.repeat(np.arange(len(docs)), np.minimum(ends, hi - lo) - starts)
            col = 0
            for w, width in enumerate(WIDTHS):
                z = y[: hi - lo, col * FILTERS : (col + 1) * FILTERS] + self.bias[w]
                for k in range(1, width):
                    nxt = y[:, (col + k) * FILTERS : (col + k + 1) * FILTERS]
                    z[: len(nxt) - k] += nxt[k : k + len(z)]
                    for j in range(1, k + 1):  # undo what reached over a text's end
                        at = ends - j
                        at = at[(at >= 0) & (at < len(z)) & (at + k < len(nxt))]
                        z[at] -= nxt[at + k]
                col += width
                here = slice(w * FILTERS, (w + 1) * FILTERS)
                most = np.maximum.reduceat(z, starts, axis=0)
                if placed:
                    row, f = np.nonzero(z == most[owner])
                    key, once = np.unique(owner[row] * FILTERS + f, return_index=True)
                    at = np.zeros(most.shape, np.int64)
                    at.ravel()[key] = row[once] + lo
                    place[docs, here] = np.where(most > top[docs, here], at, place[docs, here])
                top[docs, here] = np.maximum(top[docs, here], most)
        return top, place

    def logits(self, text: Text) -> np.ndarray:
        return self.pooled(text)[0] @ self.out + self.base

    def score(self, text: Text) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(text.border) - 1, self.constant)
        return sigmoid(self.logits(text).astype(np.float64) + self.shift[text.lang])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Adam over dense arrays, with rows of large tables touched one batch at a time."""

    def __init__(self, rate: float):
        self.rate, self.state, self.met, self.t = rate, {}, {}, 0

    def step(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        if rows is not None:  # how often each row was moved
            self.met.setdefault(name, np.zeros(len(value), np.int64))[rows] += 1
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        fix1, fix2 = 1 - 0.9**self.t, 1 - 0.99**self.t
        value[at] -= self.rate * (m[at] / fix1) / (np.sqrt(v[at] / fix2) + 1e-7)


def take(text: Text, rows: np.ndarray) -> Text:
    lens = np.diff(text.border)[rows]
    return Text(text.code[kernel.ragged(text.border[:-1][rows], lens)], np.concatenate(([0], np.cumsum(lens))), text.lang[rows])


def fit(text: Text, label: np.ndarray, seed: int = 7) -> Model | None:
    """The model that training starts with; None where so few rows, or one kind alone, say nothing."""
    n = len(label)
    mean = float(label.mean()) if n else 0.0
    if mean in (0.0, 1.0) or n < 10:
        return None
    rng = np.random.default_rng(seed)
    model = Model.start(rng, float(np.log(mean / (1 - mean))))
    adam, base, train = Adam(RATE), np.array([model.base], np.float32), rng.permutation(n)
    for _ in range(min(40, max(4, STEPS * BATCH // n))):
        rng.shuffle(train)
        for rows in _batches(train, np.diff(text.border)):
            _descend(model, base, adam, take(text, rows), label[rows])
    model.base = float(base[0])
    return model


def _batches(rows: np.ndarray, words: np.ndarray) -> Iterator[np.ndarray]:
    total = np.cumsum(words[rows])
    lo = 0
    while lo < len(rows):
        full = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BATCH_WORDS, "right"))
        hi = min(lo + BATCH, max(lo + 1, full))
        yield rows[lo:hi]
        lo = hi


def _dense(model: Model) -> np.ndarray:
    """All that is not an embedding, as rows of ``DIM``."""
    flat = np.concatenate((model.filters.T.ravel(), model.out, model.bias.ravel(), [model.base]))
    return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM).astype(np.float64)


def _unpacked(batch: pa.RecordBatch) -> Text:
    border = np.concatenate(([0], np.cumsum(np.asarray(batch.column("words"))))).astype(np.int64)
    return Text(np.frombuffer(b"".join(batch.column("code").to_pylist()), "<u4"), border, np.asarray(batch.column("lang")).astype(np.int64))


def _moves(start: Model, rate: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What one pass over the rows moves: part (0 words, 1 prefixes, 2 the rest), row, its weight ``n`` and
    the moves times that weight."""
    model, adam, base, seen = copy.deepcopy(start), Adam(rate), np.array([start.base], np.float32), 0
    rng = np.random.default_rng(7)
    for batch in batches:
        text, label = _unpacked(batch), np.asarray(batch.column("label")).astype(np.float32)
        for rows in _batches(rng.permutation(len(label)), np.diff(text.border)):
            _descend(model, base, adam, take(text, rows), label[rows])
            seen += len(rows)
    if not seen:
        return
    model.base = float(base[0])
    parts = [(model.word, start.word, adam.met.get("word")), (model.prefix, start.prefix, adam.met.get("prefix")), (_dense(model), _dense(start), None)]
    for part, (now, before, met) in enumerate(parts):
        at = np.arange(len(now)) if part == 2 else np.flatnonzero(met) if met is not None else np.zeros(0, np.int64)
        n = np.full(len(at), seen, np.int64) if part == 2 else met[at] if met is not None else at
        move = np.rint((now[at].astype(np.float64) - before[at]) * n[:, None] * FIXED).astype(np.int64)
        cols = [pa.array(np.full(len(at), part, np.int32)), pa.array(at.astype(np.int32)), pa.array(n), *(pa.array(move[:, k].copy()) for k in range(DIM))]
        yield pa.RecordBatch.from_arrays(cols, ["part", "row", "n", *(f"m{k}" for k in range(DIM))])


def refine(model: Model, rows: DataFrame, rounds: int, rate: float) -> Model:
    """The model after so many passes over all rows (label, lang, words, code), each task over its share."""
    columns = [f"m{k}" for k in range(DIM)]
    for _ in range(rounds):
        shipped = rows.sparkSession.sparkContext.broadcast(model)  # fixed size
        moved = rows.select("label", "lang", "words", "code").mapInArrow(lambda batches, start=shipped: _moves(start.value, rate, batches), f"part int, row int, n long, {', '.join(f'{c} long' for c in columns)}")
        got = moved.groupBy("part", "row").agg(*(F.sum(c).alias(c) for c in ("n", *columns))).toArrow()  # at most a row per embedding
        part, row = np.asarray(got.column("part")), np.asarray(got.column("row"))
        move = np.stack([np.asarray(got.column(c)).astype(np.float64) for c in columns], axis=1) / (np.maximum(np.asarray(got.column("n")), 1)[:, None] * float(FIXED))
        model = copy.deepcopy(model)
        model.word[row[part == 0]] += move[part == 0].astype(np.float32)
        model.prefix[row[part == 1]] += move[part == 1].astype(np.float32)
        dense = _dense(model)
        dense[row[part == 2]] += move[part == 2]
        flat, size = dense.ravel(), model.filters.size
        model.filters = flat[:size].reshape(model.filters.T.shape).T.astype(np.float32).copy()
        model.out = flat[size : size + len(model.out)].astype(np.float32)
        size += len(model.out)
        model.bias = flat[size : size + model.bias.size].reshape(model.bias.shape).astype(np.float32)
        model.base = float(flat[size + model.bias.size])
        shipped.unpersist()
    return model


def _descend(model: Model, base: np.ndarray, adam: Adam, part: Text, y: np.ndarray) -> None:
    adam.t += 1
    pooled, top = model.pooled(part, placed=True)
    g = ((sigmoid(pooled @ model.out + base[0]) - y) / len(y)).astype(np.float32)
    g_pool = g[:, None] * model.out * (pooled > 0)
    g_out = pooled.T @ g + 1e-5 * model.out
    g_filters, g_bias = np.zeros_like(model.filters), np.zeros_like(model.bias)
    rows, grads, pres = [], [], []
    place = 0
    for w, width in enumerate(WIDTHS):
        d, f = np.nonzero(g_pool[:, w * FILTERS : (w + 1) * FILTERS])
        if len(d):
            gv, pos = g_pool[d, w * FILTERS + f], top[d, w * FILTERS + f]
            np.add.at(g_bias[w], f, gv)
            for k in range(width):
                ok = pos + k < part.border[d + 1]
                word, prefix = part.slots(pos[ok] + k)
                col = (place + k) * FILTERS + f[ok]
                np.add.at(g_filters.T, col, gv[ok, None] * (model.word[word] + model.prefix[prefix]))
                rows.append(word)
                pres.append(prefix)
                grads.append(gv[ok, None] * model.filters[:, col].T)
        place += width
    adam.step("out", model.out, g_out)
    adam.step("base", base, np.array([g.sum()], np.float32))
    adam.step("bias", model.bias, g_bias)
    adam.step("filters", model.filters, g_filters)
    if grads:
        ge = np.concatenate(grads)
        for name, tab, idx in (("word", model.word, np.concatenate(rows)), ("prefix", model.prefix, np.concatenate(pres))):
            u, inv = np.unique(idx, return_inverse=True)
            gu = np.zeros((len(u), DIM), np.float32)
            np.add.at(gu, inv, ge)
            adam.step(name, tab, gu, u)


def best_cut(logit: np.ndarray, y: np.ndarray, count: np.ndarray | None = None, high: np.ndarray | None = None) -> float:
    """The logit between the two groups that gives the best F1, in the middle of its gap.  ``count`` rows
    with ``y`` hits among them can share a place, whose logits lie between ``logit`` and ``high``."""
    order = np.argsort(-logit, kind="stable")
    s, t = logit[order], y[order]
    top = s if high is None else high[order]
    hits = np.cumsum(t)
    f1 = 2 * hits / ((np.arange(1, len(t) + 1) if count is None else np.cumsum(count[order])) + t.sum())
    ends = np.append(top[1:] < s[:-1], True)
    k = int(np.argmax(np.where(ends, f1, -1)))
    below = top[k + 1] if k + 1 < len(s) else s[k] - 1
    return float((s[k] + below) / 2)


def calibrate(model: Model, rows: DataFrame, least: int = 12) -> None:
    """Shifts by language, from all rows (label, lang, words, code); a language with under ``least`` texts of
    a kind takes the common one."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("label"), pa.array(shipped.value.logits(_unpacked(batch)).astype(np.float64))], ["lang", "label", "logit"])

    logits = rows.select("label", "lang", "words", "code").mapInArrow(run, "lang int, label int, logit double")
    level = F.floor(F.least(F.greatest("logit", F.lit(-40.0)), F.lit(40.0)) * LEVELS).alias("level")
    counted = logits.groupBy("lang", level).agg(F.min("logit").alias("low"), F.max("logit").alias("high"), F.count("*").alias("n"), F.sum("label").alias("hits"))
    got = counted.toArrow()  # at most 5 * 80 * LEVELS rows
    lang, at, low, high, n, hits = (np.asarray(got.column(c)) for c in ("lang", "level", "low", "high", "n", "hits"))
    goal = float(np.log(CUT / (1 - CUT)))

    def shift(m: np.ndarray, least: int) -> float | None:
        if not m.any() or min(hits[m].sum(), n[m].sum() - hits[m].sum()) < least:
            return None
        places, inv = np.unique(at[m], return_inverse=True)
        lows, highs, sums = np.full(len(places), np.inf), np.full(len(places), -np.inf), np.zeros((2, len(places)))
        np.minimum.at(lows, inv, low[m])
        np.maximum.at(highs, inv, high[m])
        np.add.at(sums[0], inv, hits[m])
        np.add.at(sums[1], inv, n[m])
        return goal - best_cut(lows, sums[0], sums[1], highs)

    common = shift(np.ones(len(lang), bool), 1) or 0.0
    own = [shift(lang == k, least) for k in range(5)]
    model.shift = np.array([common if x is None else x for x in own])
    shipped.unpersist()


def consistent(labels: DataFrame, label_column: str, usable, id_column: str = "doc_id") -> DataFrame:
    """doc_id and label of the ids that have one label, 0 or 1."""
    named = labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("label")).where(F.col("label").isin(0, 1)).where(usable)
    return named.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_top")).where("label = _top").drop("_top")


def train(docs: DataFrame, labels: DataFrame, label_column: str, usable, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Fits on all labelled rows for which ``usable`` (a condition on the id) holds.  Hashed words, not
    texts, meet the labels."""
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).where(usable)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in kernel.slices(batch, "text"):
                text = hashed(piece.column("text"))
                codes = [text.code[a:b].astype("<u4").tobytes() for a, b in zip(text.border[:-1].tolist(), text.border[1:].tolist())]
                cols = [piece.column("doc_id"), pa.array(text.lang, pa.int32()), pa.array(np.diff(text.border), pa.int64()), pa.array(codes, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "words", "code"])

    rows = texts.mapInArrow(run, f"doc_id {kind}, lang int, words long, code binary").join(consistent(labels, label_column, usable, id_column).hint("merge"), "doc_id")  # labels grow with the texts: no broadcast
    rows = rows.withColumn("hash", F.xxhash64(F.col("doc_id").cast("string"), "code")).sortWithinPartitions("hash", "doc_id")
    stored = shared.settle(rows.withColumn("held", F.pmod("hash", F.lit(HELD)) == 0).withColumn("row", F.monotonically_increasing_id()), "training-words")
    n, hits, learnt = stored.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0)), F.count_if(~F.col("held"))).first()
    if n < 10 or hits in (0, n):
        model = Model.start(np.random.default_rng(7), 0.0)
        model.constant = hits / n if n else 0.0
        return model
    training = stored.where(~F.col("held"))
    # hashed order, no ties; texts that would take much of the room alone come after all others
    place = F.struct((F.col("words") > TRAIN_WORDS // 100).alias("long"), "hash", "row")
    sizes = training.select(place.alias("place"), "words").orderBy("place").limit(TRAIN_DOCS).toArrow()  # four numbers a row
    fits = int((np.cumsum(np.asarray(sizes.column("words"))) <= TRAIN_WORDS).sum())
    chosen = stored.limit(0)
    if fits:
        last = sizes.column("place")[fits - 1].as_py()
        chosen = training.where(place <= F.struct(*(F.lit(last[k]).alias(k) for k in ("long", "hash", "row"))))
    got = chosen.select("doc_id", "row", "label", "lang", "words", "code").toArrow()  # at most TRAIN_WORDS words
    got = got.take(pa.compute.sort_indices(got, [("doc_id", "ascending"), ("row", "ascending")]))
    text, label = _unpacked(got), np.asarray(got.column("label")).astype(np.float32)
    del got
    model = fit(text, label)
    del text
    shared.give_back()
    if model is None:
        model = refine(Model.start(np.random.default_rng(7), float(np.log(hits / (n - hits)))), training, BARE_ROUNDS, RATE)
    elif fits < learnt:
        model = refine(model, training, ROUNDS, ROUND_RATE)
    calibrate(model, stored.where("held"))
    shared.give_back()
    return model


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All of ``docs`` with a column ``toxicity``; narrow, no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    return _scored(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")), lambda part: shipped.value.score(hashed(part)))


def _scored(picked: DataFrame, scorer) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in kernel.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(scorer(piece.column("text")), pa.float64())], ["doc_id", "score"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``CUT``, with all their columns; narrow, no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in kernel.slices(batch, text_column):
                yield piece.filter(pa.array(shipped.value.score(hashed(piece.column(text_column))) < CUT))

    return docs.mapInArrow(run, docs.schema)
