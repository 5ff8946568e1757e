"""Fingerprints against plain sets and loops."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tindra.llm import fingerprints, kernel, near_copies, registry, shared


def plain_print(shingles):
    """Bins, densification and packing of one set of 64-bit hashes, one step after the other."""
    bins = {}
    for x in shingles:
        bins[x >> 56] = min(x, bins.get(x >> 56, x))
    if not bins:
        return b""
    value = [bins[next(p for p in ([b] if b in bins else fingerprints._ORDER[b].tolist()) if p in bins)] for b in range(256)]
    low = kernel.mix(np.array(value, np.uint64)).astype(np.uint8) & 15
    bits = "".join(format(int(x), "04b")[::-1] for x in low)
    return int(bits, 2).to_bytes(128, "big")


def texts_of(rng, n):
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    return [" ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 9, 20, 25, 60, 200, 900]))) for _ in range(n)]


def test_against_one_step_after_the_other():
    texts = [*texts_of(random.Random(1), 200), "", None, " .. ", "Ein Wort", "ein WORT!"]
    sets = near_copies.shingle_sets(pa.array(texts))
    got = fingerprints.fingerprints(pa.array(texts))
    assert got == [plain_print(x.tolist()) for x in sets]
    assert got[-2] == got[-1] and got[-5:-2] == [b"", b"", b""]


def test_likeness_follows_similarity():
    """Unbiased, sparse and dense sets alike, within what 256 bins allow."""
    rng = random.Random(2)
    for words in (12, 40, 300, 2000):
        for share in (0.1, 0.5, 0.9):
            off = []
            for _ in range(60):
                a = [str(rng.random()) for _ in range(words)]
                b = a[: int(words * share)] + [str(rng.random()) for _ in range(words - int(words * share))]
                pair = pa.array([" ".join(a), " ".join(b)])
                x, y = (set(s.tolist()) for s in near_copies.shingle_sets(pair))
                one, two = fingerprints.fingerprints(pair)
                off.append(fingerprints.likeness([one], [two])[0] - len(x & y) / len(x | y))
            assert abs(np.mean(off)) < 0.035 and np.sqrt(np.mean(np.square(off))) < (0.2 if words == 12 else 0.09), (words, share)


def plain_rows(rows):
    """Rows (id, text): next in descending order, nulls last."""
    rows = sorted(((i, x or "") for i, x in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for k, (i, x) in enumerate(rows):
        y = rows[(k + 1) % len(rows)][1]
        n = len(x)
        edited = x[: n - n // 3] + y[: n // 3]
        a, b, c = fingerprints.fingerprints(pa.array([x, edited, y]))
        near = fingerprints.likeness([a, a], [b, c]).tolist()
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), *near))
    return sorted(out, key=str)


def got_rows(df, id_column="doc_id"):
    return sorted(((r[id_column], r.n_chars, bytes(r.edited_sha256).hex(), bytes(r.fingerprint).hex(), bytes(r.edited_fingerprint).hex(), r.near_edited, r.near_next) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 150])
def test_next_in_order(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(10**9) * 10 + k % 10, x) for k, x in enumerate(texts_of(rng, n))]
    if n > 5:
        rows += [(-5, None), (-4, ""), (-3, "þæ 漢字 " * 3000), (None, "no id"), (-2, "word " * 50_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, x, 1, "b") for i, x in rows], "doc_id long, text string, part int, edge string")
    assert got_rows(fingerprints.with_next(df)) == plain_rows(rows)


def test_repeated_rows(spark):
    rows = [(7, "one two three four five six")] * 40 + [(8, "other words here")]
    got = got_rows(fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain_rows(rows)


def test_columns_are_kept(spark):
    df = spark.createDataFrame([("a", "one two", 3), (None, None, None)], "key string, body string, fingerprint int")
    out = fingerprints.fingerprint(df, "body", "mark")
    assert out.columns == ["key", "body", "fingerprint", "mark"] and sorted(bytes(r.mark) for r in out.collect())[0] == b""


def test_query_against_a_loop(spark, sf_dir):
    rows = [tuple(r) for r in shared.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    found = registry.op13_fingerprints(spark, sf_dir)
    assert sorted((tuple(r) for r in found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()), key=str) == plain_rows(rows)
