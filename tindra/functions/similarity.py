"""Name similarity: the Gestalt ratio and the best of ratio, word overlap and leading words.

The ratio is not symmetric: the incoming name comes first, the catalogue's second.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tindra.functions import text


def gestalt(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def _common(a: str, b: str) -> int:
    """Characters that both have, each as often as the one that has it less often."""
    return sum([min(a.count(c), b.count(c)) for c in set(a)])


def gestalt_from(a: str | None, b: str | None, least: float, matcher: SequenceMatcher | None = None) -> float:
    """The ratio where it reaches ``least``, else 0.  Stretches are matched from the longest on, and what
    is still open can at most match all characters it has in common; a pair that can no longer reach
    ``least`` is given up.  ``matcher`` may be one that has ``b`` already."""
    if not a or not b:
        return 0.0
    whole = len(a) + len(b)
    need = least * whole / 2 - 1e-9
    if min(len(a), len(b)) < need:
        return 0.0
    may = _common(a, b)
    if may < need:
        return 0.0
    m = matcher or SequenceMatcher(None, "", b)
    m.set_seq1(a)
    matched, parts = 0, [(0, len(a), 0, len(b), may)]
    while parts:
        alo, ahi, blo, bhi, most = parts.pop()
        i, j, n = m.find_longest_match(alo, ahi, blo, bhi)
        may += n - most
        matched += n
        for part in ((alo, i, blo, j), (i + n, ahi, j + n, bhi)) if n else ():
            if part[0] < part[1] and part[2] < part[3] and (most := _common(a[part[0] : part[1]], b[part[2] : part[3]])):
                may += most
                parts.append((*part, most))
        if may < need:
            return 0.0
    ratio = 2 * matched / whole
    return ratio if ratio >= least else 0.0


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    out, last, matcher = [0.0] * len(a), None, SequenceMatcher(None)
    first, second, bounds = a.tolist(), b.tolist(), least.tolist()
    for k in sorted(range(len(out)), key=lambda k: second[k] or ""):  # a matcher is set up once per second name
        if second[k] != last:
            last = second[k]
            matcher.set_seq2(last or "")
        out[k] = gestalt_from(first[k], last, bounds[k], matcher)
    return pd.Series(out, dtype="float64")


def cleaned(name: Column) -> Column:
    """The form in which names are compared: lower case, no outer white space, null as empty."""
    return F.lower(text.strip(text.nonnull(name)))


def ratio(a: Column, b: Column, least: Column | float = 0.0) -> Column:
    """Ratio of cleaned names; 0 where one is empty or the ratio is under ``least``."""
    return _ratio(a, b, least if isinstance(least, Column) else F.lit(least))


def ratio_bound(a: Column, b: Column) -> Column:
    """What the ratio cannot exceed, from the lengths alone; JVM-side, for filters before the UDF."""
    return F.coalesce(2 * F.least(F.length(a), F.length(b)) / F.nullif(F.length(a) + F.length(b), F.lit(0)), F.lit(0.0))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+", -1), lambda x: x != "")


def _leads(a: Column, b: Column) -> Column:
    """Whether the shorter of two word lists leads the longer."""
    n = F.least(F.size(a), F.size(b))
    return (n > 0) & (F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n))


def may_match(a: Column, b: Column, least: float, a_words: Column | None = None, b_words: Column | None = None) -> Column:
    """Whether ``name_match`` can reach ``least``; JVM-side, for filters before it."""
    x, y = words(a) if a_words is None else a_words, words(b) if b_words is None else b_words
    return F.coalesce((ratio_bound(a, b) >= least) | _leads(x, y) | (text.list_jaccard(x, y) >= least), F.lit(False))


def name_match(a: Column, b: Column, least: Column | float = 0.0, a_words: Column | None = None, b_words: Column | None = None) -> Column:
    """1 where the shorter word list leads the longer, else the best of ratio and word overlap; for
    names that are already normalised.  A ratio under ``least`` may count as 0.  The names' words may
    be at hand."""
    least = least if isinstance(least, Column) else F.lit(least)
    x, y = words(a) if a_words is None else a_words, words(b) if b_words is None else b_words
    some = (text.nonnull(a) != "") & (text.nonnull(b) != "")
    return F.when(some, F.when(_leads(x, y), 1.0).otherwise(F.greatest(_ratio(a, b, least), text.list_jaccard(x, y)))).otherwise(0.0)


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All characters of the texts one after the other, each with its text's number and its place there, and the texts' lengths."""
    size = np.array([len(x) for x in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    return code, np.repeat(np.arange(len(texts)), size), np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size), size


SIGNATURE = ("l0", "l1", "l2", "t0", "t1")
LETTERS, TIMES, TWOS = 32, 6, 128  # letters are told modulo 32 and counted up to 6, pairs of letters modulo 128


@F.pandas_udf(StructType([StructField(c, LongType()) for c in SIGNATURE]))
def signature(texts: pd.Series) -> pd.DataFrame:
    """Bits of a text's letters, as many ones per letter as it stands there, and of its pairs of letters."""
    code, row, _, size = _coded([x or "" for x in texts.tolist()])
    count = np.bincount(row * LETTERS + code % LETTERS, minlength=len(size) * LETTERS).reshape(-1, LETTERS)
    bits = np.zeros((len(size), LETTERS * TIMES + TWOS), np.uint8)
    bits[:, : LETTERS * TIMES] = (np.arange(TIMES) < count[:, :, None]).reshape(-1, LETTERS * TIMES)
    inside = row[:-1] == row[1:]
    bits[row[:-1][inside], LETTERS * TIMES + (code[:-1] * 37 + code[1:])[inside] % TWOS] = 1
    return pd.DataFrame(np.packbits(bits, axis=1).view(np.int64), columns=SIGNATURE)


def may_reach(a: Column, b: Column, a_signature: str, b_signature: str, least: float, letters: Column | None = None) -> Column:
    """Whether the ratio can reach ``least`` by both signatures; JVM-side.  How many letters both texts have
    together may be at hand, and a signature may be columns of its own: then its name ends in ``_``.

    Letters that are in one text only are at most (1 - least) of both, each puts one letter and at most
    three pairs of letters more on one side."""
    part = lambda s, n: F.col(f"{s}{n}" if s.endswith("_") else f"{s}.{n}")
    apart = lambda names: reduce(lambda x, y: x + y, (F.bit_count(part(a_signature, n).bitwiseXOR(part(b_signature, n))) for n in names))
    most = (F.length(a) + F.length(b) if letters is None else letters) * (1 - least) + 1e-9
    return (apart(SIGNATURE[:3]) <= most) & (apart(SIGNATURE[3:]) <= most * 3)


# Lists of names against lists of names -------------------------------------------------------------
BITS = 64  # characters of a first text that one number holds
TILE = 1 << 14  # pairs at a time, so few that their numbers stay in a processor's cache


def common_sequence_bounds(first: list[str], second: list[str]) -> np.ndarray:
    """What the longest common subsequence of each first with each second text cannot exceed (exact for
    first texts of up to ``BITS`` characters), for ``TILE`` pairs at once: a bit per character of the first
    text, a step per character of the second."""
    out = np.zeros((len(second), len(first)), np.int32)
    if not out.size:
        return out.T
    a, a_row, a_at, a_size = _coded(first)
    b, b_row, b_at, b_size = _coded(second)
    letters, b = np.unique(b, return_inverse=True)
    chars = np.full((b_size.max(), len(second)), len(letters), np.int64)  # that number: after a text's end
    chars[b_at, b_row] = b
    number = np.searchsorted(letters, a)
    known = number < len(letters)
    known[known] = letters[number[known]] == a[known]
    wide = max(1, TILE // len(first))
    for at in range(0, int(a_size.max()), BITS):
        here = known & (a_at >= at) & (a_at < at + BITS)
        masks = np.zeros((len(letters) + 1, len(first)), np.uint64)
        np.bitwise_or.at(masks, (number[here], a_row[here]), np.uint64(1) << (a_at[here] - at).astype(np.uint64))
        for j in range(0, len(second), wide):
            steps = chars[: b_size[j : j + wide].max(), j : j + wide]
            free = np.full((steps.shape[1], len(first)), ~np.uint64(0))
            taken, kept = np.empty_like(free), np.empty_like(free)
            for step in steps:
                np.take(masks, step, axis=0, out=taken, mode="clip")
                taken &= free
                np.subtract(free, taken, out=kept)
                free += taken
                free |= kept
            out[j : j + wide] += BITS - np.bitwise_count(free).astype(np.int32)
    return np.minimum(out, b_size.astype(np.int32)[:, None]).T


def _sizes(first: list, second: list) -> np.ndarray:
    """The sum of the lengths of each pair."""
    return np.add.outer(*(np.array([len(x) for x in side], np.int32) for side in (first, second)))


def _needed(sizes: np.ndarray, count: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """How many each pair needs by the sum of its lengths: a number for each sum, then looked up."""
    return np.ceil(count(np.arange(sizes.max(initial=0) + 1)) - 1e-9).astype(np.int32)[sizes]


def _reach(first: list[str], second: list[str], least: float) -> np.ndarray:
    """Whether the ratio of each pair may reach ``least``: no more letters match than a common subsequence has."""
    sizes = _sizes(first, second)
    return (common_sequence_bounds(first, second) >= _needed(sizes, lambda n: least * n / 2)) & (sizes > 0)


def ratios(first: list[str], second: list[str], least: float) -> np.ndarray:
    """The ratio of each pair of distinct texts, 0 where it is under ``least``."""
    out, matcher, last = np.zeros((len(first), len(second))), SequenceMatcher(None), -1
    for j, i in np.argwhere(_reach(first, second, least).T).tolist():
        if j != last:  # a matcher is set up once per second name
            matcher.set_seq2(second[j])
            last = j
        out[i, j] = gestalt_from(first[i], second[j], least, matcher)
    return out


def best_of_names(left: list[tuple[str, ...]], right: list[tuple[str, ...]], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both lists of names whose best ratio over all their names reaches ``least``: two places and the ratio."""
    a, b = ({x: k for k, x in enumerate(dict.fromkeys(x for names in side for x in names))} for side in (left, right))
    by_text = ratios(list(a), list(b), least)
    at = [np.array([[index[x] for x in names] for names in side]) for side, index in ((left, a), (right, b))]
    best = np.zeros((len(left), len(right)))
    for i in at[0].T:
        for j in at[1].T:
            best = np.maximum(best, by_text[i[:, None], j])
    i, j = np.nonzero(best >= least)
    return i, j, best[i, j]


def matched(first: list[str], second: list[str], first_words: list[list[str]], second_words: list[list[str]], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of normalised, not empty names whose ``name_match`` reaches ``least``: two places and the score."""
    number = {x: k for k, x in enumerate(dict.fromkeys(x for w in (*first_words, *second_words) for x in w))}
    heads = [np.array([[number[w[k]] if len(w) > k else -1 for k in (0, 1)] for w in side], np.int32).reshape(-1, 2) for side in (first_words, second_words)]
    i, j = np.nonzero(np.equal.outer(heads[0][:, 0], heads[1][:, 0]))
    next_words = heads[0][i, 1], heads[1][j, 1]
    may_lead = (heads[0][i, 0] >= 0) & ((next_words[0] == next_words[1]) | (np.minimum(*next_words) < 0))
    lead = np.zeros((len(first), len(second)), bool)
    for i, j in zip(i[may_lead].tolist(), j[may_lead].tolist()):
        n = min(len(first_words[i]), len(second_words[j]))
        lead[i, j] = first_words[i][:n] == second_words[j][:n]
    # words in common at most: bits in common, and words of the first name that share a bit with another
    sets = [[set(w) for w in side] for side in (first_words, second_words)]
    bits = [np.zeros(len(side), np.uint64) for side in sets]
    for side, out in zip(sets, bits):
        row, bit = np.repeat(np.arange(len(side)), [len(w) for w in side]), np.array([number[x] % BITS for w in side for x in w], np.uint64)
        np.bitwise_or.at(out, row, np.uint64(1) << bit)
    more = np.array([len(w) for w in sets[0]], np.int32) - np.bitwise_count(bits[0])
    common = np.bitwise_count(np.bitwise_and.outer(*bits)) + more[:, None]
    shared = (common >= _needed(_sizes(*sets), lambda n: least * n / (1 + least))) & (common > 0)
    reach = _reach(first, second, least)
    found, matcher, last = [], SequenceMatcher(None), -1
    for j, i in np.argwhere((reach | lead | shared).T).tolist():
        if lead[i, j]:
            score = 1.0
        else:
            union = sets[0][i] | sets[1][j]
            score = len(sets[0][i] & sets[1][j]) / len(union) if union else 0.0
            if reach[i, j] and score < 1:
                if j != last:
                    matcher.set_seq2(second[j])
                    last = j
                score = max(score, gestalt_from(first[i], second[j], least, matcher))
        if score >= least:
            found.append((i, j, score))
    i, j, score = zip(*found) if found else ((), (), ())
    return np.array(i, np.int64), np.array(j, np.int64), np.array(score, np.float64)


def _lists(batch: pa.RecordBatch, *columns: str) -> Iterator[list]:
    """The lists of each row, one row at a time."""
    for k in range(batch.num_rows):
        yield [batch.column(c)[k].as_py() for c in columns]


def score_lists(lists: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, distance_m, score) of lists of rows (``as`` and ``bs``, of id, name, name_eng) of which
    one of both names reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, metres in _lists(batch, "as", "bs", "distance_m"):
                names = [[(r["name"], r["name_eng"]) for r in side] for side in (left, right)]
                i, j, score = best_of_names(*names, least)
                a, b = (np.array([r["id"] for r in side]) for side in (left, right))
                yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[j]), pa.array(np.full(len(i), metres)), pa.array(score)], ["a", "b", "distance_m", "score"])

    kind = lists.schema["as"].dataType.elementType["id"].dataType.simpleString()
    return lists.select("as", "bs", "distance_m").mapInArrow(run, f"a {kind}, b {kind}, distance_m double, score double")


def best_in_lists(lists: DataFrame, least: float) -> DataFrame:
    """Per row a of each list ``as`` (id, name, words) the row b of the list ``bs`` beside it that it matches
    best, if one reaches ``least``: (a, b, distance_m, score); of equal scores the smallest id.  ``words``
    are a name's words, a line each."""
    split = lambda rows: [r["words"].split("\n") if r["words"] else [] for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, metres in _lists(batch, "as", "bs", "distance_m"):
                i, j, score = matched([r["name"] for r in left], [r["name"] for r in right], split(left), split(right), least)
                a, b = (np.array([r["id"] for r in side]) for side in (left, right))
                order = np.lexsort((b[j], -score, i))
                order = order[np.unique(i[order], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([pa.array(a[i[order]]), pa.array(b[j[order]]), pa.array(np.full(len(order), metres)), pa.array(score[order])], ["a", "b", "distance_m", "score"])

    kind = lists.schema["as"].dataType.elementType["id"].dataType.simpleString()
    return lists.select("as", "bs", "distance_m").mapInArrow(run, f"a {kind}, b {kind}, distance_m double, score double")
