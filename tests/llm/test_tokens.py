"""Token ids, files and packing against the tokenizers library itself."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tindra.llm import kernel, packing, token_files, tokens

TEXTS = ["", "a<|endoftext|>b", "Don't \x01 J̌ ǰ ΣΑΣ İstanbul  x\x1cy 　z 12,5% ...", "Öl, ÄRGER. l'été!", "é" * 10, "x" * 3000, "a.\nb? c! " * 900, "µ ª, º. ×. ÷,", " \n\t", "".join("ab"[bin(k).count("1") % 2] for k in range(1024)), "".join("ba"[bin(k).count("1") % 2] for k in range(1024))]
ROWS = [(3, "b c."), (1, None), (2, ""), (2, ""), (None, "null id"), (9, "a.\nb? c! " * 900), *((10 + i, t) for i, t in enumerate(TEXTS))]


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_are_the_librarys(library):
    ids, border, _ = tokens.tokenizer(tokens.default_vocabulary()).encode(pa.array(TEXTS))
    assert [ids[a:b].tolist() for a, b in zip(border, border[1:])] == [library(t) for t in TEXTS]


def thue_morse(n):
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[k] for k in bits), "".join("ba"[k] for k in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_self_similar_words_keep_their_ids(library, n):
    texts = [*thue_morse(n), f"{thue_morse(n)[1]} {thue_morse(n)[0]}"]
    ids, border, _ = tokens.ChunkTokenizer(tokens.default_vocabulary()).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(border, border[1:])] == [library(t) for t in texts]


def test_chunks_under_one_hash_keep_their_ids(library, monkeypatch):
    true = kernel.word_hashes
    monkeypatch.setattr(kernel, "word_hashes", lambda b, s, e, key=kernel._KEYS[0]: true(b, s, e, key) if key != kernel._KEYS[0] else true(b, s, e) % np.uint64(5))
    texts = [" ".join(TEXTS), "one two three four five six seven eight nine ten and a considerably longer one"]
    tok = tokens.ChunkTokenizer(tokens.default_vocabulary())
    for _ in range(2):
        ids, border, _ = tok.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(border, border[1:])] == [library(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é.,'sÄ\n1J̌Σ中", max_size=30), max_size=6))
def test_ids_of_any_text(texts):
    tok = tokens.tokenizer(tokens.default_vocabulary())
    ids, border, _ = tok.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(border, border[1:])] == [tok.tok.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 1 << 31)), max_size=20), max_size=5))
def test_file_round_trip(docs):
    counts = np.array([len(d) for d in docs], np.int64)
    raw = token_files.pack(np.arange(len(docs)), np.ones(len(docs), bool), counts, np.array([x for d in docs for x in d], np.uint32))
    doc_ids, known, back, ids = token_files.unpack(raw)
    assert back.tolist() == counts.tolist() and ids.tolist() == [x for d in docs for x in d] and known.all() and doc_ids.tolist() == list(range(len(docs)))


def test_files(spark, library):
    df = spark.createDataFrame([(a, b, 0, "p") for a, b in ROWS], "doc_id long, text string, start long, path string").repartition(3)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.encode(df).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))
    want = sorted((-1 if a is None else a, len(library(t)) + 1, crc([*library(t), 1])) for a, t in ROWS)
    assert sorted((-1 if r[0] is None else r[0], r[2], r[3]) for r in got) == want
    assert [r[1] for r in got] == np.concatenate(([0], np.cumsum([r[2] for r in got])[:-1])).tolist()
    assert token_files.encode(df.limit(0)).count() == 0


def test_cheapest_cuts():
    rng = np.random.default_rng(0)
    for _ in range(20):
        cuts = np.cumsum(rng.integers(1, 30, 25))
        pens = rng.integers(0, 2, 25) * 5
        cost = {0: 0.0}
        for j, c in enumerate(cuts.tolist()):
            best = []
            for p, k in cost.items():
                if c - p <= 64:
                    size = c - p
                    best.append(k + (0 if size == 32 else 64 - size) + packing.WINDOW_PRICE + pens[j])
            cost[c] = min(best)
        ends = packing.plan_cuts(cuts, pens, 64)
        total, last = 0, 0
        for e in ends:
            size = e - last
            total += (0 if size == 32 else 64 - size) + packing.WINDOW_PRICE + pens[cuts.tolist().index(e)]
            last = e
        assert last == cuts[-1] and total == cost[int(cuts[-1])]


def test_packing(spark, library):
    df = spark.createDataFrame([(a, b, "x") for a, b in ROWS], "doc_id long, text string, offset string").repartition(2)
    pieces = packing.pack(df).collect()
    spans, fill = {}, {}
    for p in pieces:
        assert p.length > 0
        spans.setdefault(p.doc_id, []).append(p)
        fill.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LIMIT
    for doc, text in ROWS:
        ids = [*library(text), 1]
        parts = sorted({(p.start, p.length, p.ids_crc32) for p in spans[doc] if p.doc_tokens == len(ids)})
        assert sum(n for _, n, _ in parts) == len(ids)
        assert all(crc(ids[s : s + n]) == c for s, n, c in parts)
    sizes = [sum(n for _, n in parts) for parts in fill.values()]
    padding = sum(0 if s & (s - 1) == 0 else packing.LIMIT - s for s in sizes)
    assert padding <= 0.02 * sum(sizes)
    assert packing.pack(df.limit(0)).count() == 0


def test_windows_are_few_and_full(library):
    rng = np.random.default_rng(5)
    stream, total = packing.Stream(0, packing.LIMIT), 0
    for k in range(300):
        n = int(rng.integers(30, 3000))
        stops = np.unique(rng.integers(1, n, n // 15))
        stream.add([k], np.array([0, n]), np.zeros(n, np.uint32), stops)
        total += n
    stream.solve(True)
    rows = stream.take()
    sizes = np.bincount(np.asarray(rows.column("sequence_id")), weights=np.asarray(rows.column("length"))).astype(int)
    assert sizes.sum() == total and len(sizes) - 11 <= 1.03 * total / packing.LIMIT  # up to 11 powers of two close a task
    assert np.where(sizes & (sizes - 1) == 0, 0, packing.LIMIT - sizes).sum() <= 0.02 * total
