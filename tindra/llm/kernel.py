"""Vectorised word hashing over Arrow string buffers.

Every text operator of this subpackage that runs in Python starts from the same three numpy
arrays - the word starts, the word ends and a 64-bit hash of each word - which are computed from
the UTF-8 buffer of an Arrow column without creating a Python object per word.

The hash of a word reads it eight bytes at a time, from its start, so it does not depend on where the
word stands.  Every eight bytes go through a non-linear bit mixer with a key of their own before they
are added up, so no arithmetic relation between the bytes of two words makes them meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15
_KEYS = (np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7))  # of the hash and of the check
_CUT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_NEAR_CHUNKS = 8  # eights of a word that are read one after the other; the rest of longer words at once
BLOCK = 1 << 20  # bytes hashed at once; a longer word makes its block longer
SLICE = 1 << 20  # bytes of text that one slice of a batch holds, one longer text excepted

def word_table() -> np.ndarray:
    """Byte map of words: ASCII letters (folded to lower case), digits and all bytes of non-ASCII
    characters belong to words; 0 marks a separator."""
    lut = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128 or (c.isascii() and c.isalnum()):
            lut[b] = ord(c.lower()) if b < 128 else b
    return lut


def chunk_table() -> np.ndarray:
    """Byte map of white-space separated chunks; only ASCII white space separates.  Capitals are
    folded only in blocks without characters beyond Latin-1, where folding commutes with NFC."""
    lut = np.arange(256).astype(np.uint8)
    lut[[0, 9, 10, 11, 12, 13, 32]] = 0
    return lut


WORDS = word_table()
CHUNKS = chunk_table()
CHUNKS_FOLDED = CHUNKS.copy()
CHUNKS_FOLDED[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray, key: np.uint64 = _KEYS[0]) -> np.ndarray:
    """Hashes of the words [s, e) of a byte buffer."""
    padded = np.concatenate((b, np.zeros(8, np.uint8)))
    eights = np.ndarray(len(b) + 1, "<u8", padded, strides=(1,))
    n = e - s
    out = mix((eights[s] & _CUT[np.minimum(n, 8)]) ^ key) + n.astype(np.uint64) * np.uint64(_P)
    for k in range(1, _NEAR_CHUNKS):
        more = np.flatnonzero(n > 8 * k)
        if not len(more):
            break
        at = s[more] + 8 * k
        out[more] += mix((eights[at] & _CUT[np.minimum(n[more] - 8 * k, 8)]) ^ mix(np.array([key]) + np.uint64(k)))
    far = np.flatnonzero(n > 8 * _NEAR_CHUNKS)
    if len(far):
        count = -(-n[far] // 8) - _NEAR_CHUNKS
        k = ragged(np.full(len(far), _NEAR_CHUNKS), count)
        own = np.repeat(far, count)
        parts = mix((eights[s[own] + 8 * k] & _CUT[np.minimum(n[own] - 8 * k, 8)]) ^ mix(key + k.astype(np.uint64)))
        out[far] += np.add.reduceat(parts, np.cumsum(count) - count)
    return mix(out)


def word_checks(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A second number per word, independent of its hash: the bytes themselves up to eight."""
    padded = np.concatenate((b, np.zeros(8, np.uint8)))
    eights = np.ndarray(len(b) + 1, "<u8", padded, strides=(1,))
    out = eights[s] & _CUT[np.minimum(e - s, 8)]
    long = np.flatnonzero(e - s > 8)
    if len(long):
        out[long] = word_hashes(b, s[long], e[long], _KEYS[1])
    return out


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; null counts as the empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return off - off[0], data


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` bytes of text (or one row)."""
    off, _ = buffers(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def spans(off: np.ndarray, data: np.ndarray, lut: np.ndarray, hashes: bool = True, trim: bool = False, checks: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs that ``lut`` does not map to 0, within texts.

    ``trim`` leaves a closing stop or comma out of a run that has a letter before it; ``checks`` takes
    arrays of the words' second numbers."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    starts, ends, hs = [], [], []
    lo = 0
    while lo < n:
        hi = min(n, lo + BLOCK)
        if hi < n:  # cut where no word is open
            step = BLOCK
            while True:
                seps = np.flatnonzero(lut[data[max(lo, hi - 4096) : hi]] == 0)
                if len(seps):
                    hi = max(lo, hi - 4096) + int(seps[-1]) + 1
                    break
                at = int(np.searchsorted(off, hi, "right")) - 1
                if off[at] > lo:  # a text starts inside: cut there
                    hi = int(off[at])
                    break
                if hi >= n:
                    break
                hi = min(n, hi + step)
        b = lut[data[lo:hi]]
        top = int(b.max()) if len(b) else 0
        if lut is CHUNKS and top < 0xC4:
            b = CHUNKS_FOLDED[data[lo:hi]]
        if top >= 128 and (lut is WORDS or top < 0xC4):  # capital letters of Latin-1 in UTF-8
            lead = np.flatnonzero(b[:-1] == 0xC3)
            nxt = b[lead + 1]
            up = lead[(nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)] + 1
            b[up] |= 0x20
        on = b != 0
        first = np.zeros(hi - lo + 1, bool)
        cut = off[(off >= lo) & (off <= hi)] - lo
        first[cut] = True  # text borders
        s = on.copy()
        s[1:] &= ~on[:-1] | first[1:-1]
        e = on.copy()
        e[:-1] &= ~on[1:] | first[1:-1]
        s, e = np.flatnonzero(s), np.flatnonzero(e) + 1
        if trim:
            e = e - trim_stop(b, s, e)
        if hashes:
            hs.append(word_hashes(b, s, e))
        if checks is not None:
            checks.append(word_checks(b, s, e))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hs) if hashes else np.zeros(0, np.uint64)


def trim_stop(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """1 for runs that end in a letter (ASCII, or Latin-1 in UTF-8) and one stop or comma, else 0."""
    last, before, two = b[e - 1], b[np.maximum(e - 2, 0)], b[np.maximum(e - 3, 0)]
    ascii_letter = ((before | 0x20) >= 97) & ((before | 0x20) <= 122) & (before < 128)
    latin_letter = (two == 0xC3) & (before != 0x97) & (before != 0xB7) & (before >= 128) & (e - s >= 3)
    return ((e - s >= 2) & ((last == 46) | (last == 44)) & (ascii_letter | latin_letter)).astype(np.int64)


def owners(off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First word of each text in ``starts``, and one past the last: len(off) borders."""
    return np.searchsorted(starts, off, "left")


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + len)."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - np.concatenate(([0], np.cumsum(lens)[:-1]))
    return np.repeat(shift, lens) + np.arange(total)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words of one text; a shorter text is one shingle of all its
    words, an empty one has none."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = (out << np.uint64(13) | out >> np.uint64(51)) * np.uint64(_P) + h[k : len(h) - n + 1 + k]
    return mix(out)
