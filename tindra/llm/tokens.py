"""Token ids by the tokenizers library, one library call per distinct chunk of text.

Text is cut at ASCII white space.  The vocabulary's normaliser and pre-tokeniser never look across
white space and drop it, so the ids of a text are the ids of its chunks in order.  Distinct chunks
are encoded by the library once per worker and kept by their 64-bit hash; a hit must agree in a second
number too (the bytes themselves up to eight, an independent hash beyond).  All other work is numpy.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from tindra.llm import kernel

END_ID = 1  # the id that closes a document
CACHE_CHUNKS = 1_500_000  # distinct chunks kept by a worker; it starts anew beyond that


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


FRONT = 1 << 21  # slots of the direct-mapped front of the cache


class ChunkTokenizer:
    """``encode`` gives flat ids, the border of each text in them, and the ends of sentences."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.bytes = _byte_letters()
        self.stops = {c: self.tok.encode(chr(c), add_special_tokens=False).ids for c in (46, 44)}
        assert all(len(x) == 1 for x in self.stops.values())
        self.epoch = 0
        self.clear()

    def clear(self) -> None:
        self.epoch += 1
        self.keys = np.zeros(1, np.uint64)  # entry 0 is no chunk
        self.checks = np.zeros(1, np.uint64)
        self.at = np.zeros(1, np.int64)
        self.len = np.zeros(1, np.int64)
        self.n = 1
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.sorted = np.zeros(0, np.uint64)
        self.entry = np.zeros(0, np.int32)
        self.front = np.zeros(FRONT, np.int32)

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks and their counts: chunks of lower-case Latin-1 letters are one word to
        the pre-tokeniser and go straight to the library's model, the others through its pipeline."""
        out: list[list[int]] = [[]] * len(chunks)
        others = []
        tokenize, letters = self.model.tokenize, self.bytes
        for i, c in enumerate(chunks):
            if c.isalpha() and c.islower() and max(c) < "\u0100":
                out[i] = [t.id for t in tokenize(c if c.isascii() else "".join([letters[b] for b in c.encode()]))]
            else:
                others.append(i)
        for lo in range(0, len(others), 2000):
            part = others[lo : lo + 2000]
            enc = self.tok.encode("\n".join([chunks[i] for i in part]), add_special_tokens=False)
            begin = np.fromiter((o[0] for o in enc.offsets), np.int64, len(enc.ids))
            first = np.cumsum([0, *(len(chunks[i]) + 1 for i in part)])
            cut = np.searchsorted(begin, first, "left").tolist()
            ids = enc.ids
            for k, i in enumerate(part):
                out[i] = ids[cut[k] : cut[k + 1]]
        lens = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((x for o in out for x in o), np.uint32, int(lens.sum()))
        return flat, lens

    def _learn(self, keys: np.ndarray, checks: np.ndarray, chunks: list[str]) -> None:
        ids, lens = self._encode_chunks(chunks)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while self.n + len(keys) > len(self.keys):
            self.keys, self.checks, self.at, self.len = (np.concatenate((x, np.zeros_like(x))) for x in (self.keys, self.checks, self.at, self.len))
        self.pool[self.used : self.used + len(ids)] = ids
        new = slice(self.n, self.n + len(keys))
        self.keys[new], self.checks[new] = keys, checks
        self.at[new] = self.used + np.concatenate(([0], np.cumsum(lens)[:-1]))
        self.len[new] = lens
        pos = np.searchsorted(self.sorted, keys)
        self.sorted = np.insert(self.sorted, pos, keys)
        self.entry = np.insert(self.entry, pos, np.arange(new.start, new.stop, dtype=np.int32))
        self.n, self.used = new.stop, self.used + len(ids)

    def _entries(self, h: np.ndarray, check: np.ndarray, text_of) -> np.ndarray:
        """The cache entry of each chunk; chunks that are not there yet are encoded."""
        got = self._places(h, check, text_of)
        wrong = np.flatnonzero(self.checks[got] != check)
        if len(wrong):  # another chunk with the same hash holds the place: these go under the check's hash
            got, epoch = got.copy(), self.epoch
            got[wrong] = self._entries(kernel.mix(h[wrong] ^ kernel.mix(check[wrong])), check[wrong], lambda which: text_of(wrong[which]))
            if self.epoch != epoch:  # the cache was emptied on the way
                return self._entries(h, check, text_of)
        return got

    def _places(self, h: np.ndarray, check: np.ndarray, text_of) -> np.ndarray:
        slot = (h & np.uint64(FRONT - 1)).astype(np.int64)
        got = self.front[slot]
        miss = np.flatnonzero(self.keys[got] != h)
        if not len(miss):
            return got
        u, first, inv = np.unique(h[miss], return_index=True, return_inverse=True)
        if self.n + len(u) > CACHE_CHUNKS and self.n > 1:
            self.clear()
            return self._places(h, check, text_of)
        pos = np.searchsorted(self.sorted, u)
        known = np.zeros(len(u), bool)
        inside = pos < len(self.sorted)
        known[inside] = self.sorted[pos[inside]] == u[inside]
        if not known.all():
            self._learn(u[~known], check[miss[first[~known]]], text_of(miss[first[~known]]))
            pos = np.searchsorted(self.sorted, u)
        entry = self.entry[pos]
        self.front[(u & np.uint64(FRONT - 1)).astype(np.int64)] = entry
        got = got.copy()
        got[miss] = entry[inv]
        return got

    def encode(self, texts: pa.Array, sentences: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        off, data = kernel.buffers(texts)
        checks: list[np.ndarray] = []
        s, e, h = kernel.spans(off, data, kernel.CHUNKS, trim=True, checks=checks)
        border = kernel.owners(off, s)
        raw: list[bytes] = []

        def text_of(which: np.ndarray) -> list[str]:
            raw[:] = raw or [data.tobytes()]
            return [c.lower() if (c := raw[0][a:b].decode("utf-8", "replace")).isascii() or max(c) < "\u0100" else c for a, b in zip(s[which].tolist(), e[which].tolist())]

        got = self._entries(h, np.concatenate(checks) if checks else h, text_of)
        # a stop or comma that was left out follows its chunk as one id
        nxt = data[np.minimum(e, len(data) - 1)] if len(data) else e
        limit = off[np.searchsorted(off, s, "right")] if len(s) else e
        stop = (e < limit) & ((nxt == 46) | (nxt == 44))
        lens = self.len[got]
        ends = np.concatenate(([0], np.cumsum(lens + stop)))
        main = self.pool[kernel.ragged(self.at[got], lens)]
        at_stop = ends[1:][stop] - 1
        if len(at_stop):
            ids = np.empty(int(ends[-1]), np.uint32)
            here = np.ones(len(ids), bool)
            here[at_stop] = False
            ids[here] = main
            ids[at_stop] = np.where(nxt[stop] == 46, self.stops[46][0], self.stops[44][0])
        else:
            ids = main
        stops = np.zeros(0, np.int64)
        if sentences and len(e):
            last = data[e - 1]
            stops = ends[1:][(stop & (nxt == 46)) | (~stop & ((last == 46) | (last == 33) | (last == 63)))]
        return ids, ends[border], stops


_cached: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """The worker's tokenizer for this vocabulary file, kept between tasks."""
    if path not in _cached:
        _cached[path] = ChunkTokenizer(path)
    return _cached[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def with_end(ids: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The flat ids with END_ID closing every text, and the new borders."""
    out = np.insert(ids, border[1:], END_ID)
    return out, border + np.arange(len(border))
