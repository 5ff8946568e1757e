"""Snapshot differences against a plain loop."""

import hashlib
import random
from collections import defaultdict

import pytest

from tindra.llm import registry, shared, snapshots

SCHEMA = "k long, text string, lang string, source string, parts int, rank int, key string"


def plain(earlier, later):
    """Rows of (key, text, lang, source): what ``difference`` returns."""
    sha = lambda r: hashlib.sha256("\n".join("~" if x is None else x for x in r[1:]).encode()).hexdigest()
    content = lambda r: tuple((x is not None, x or "") for x in r[1:])
    size = lambda r: (r[0] is not None, r[0] or 0)
    by_key, out, left = defaultdict(lambda: ([], [])), [], ([], [])
    for side, rows in enumerate((earlier, later)):
        for r in rows:
            by_key[r[0]][side].append(r)
    for old, new in by_key.values():
        # several rows of a key: the order is that of a hash, so only rows that all agree are planted
        pairs = min(len(old), len(new))
        for a, b in zip(old[:pairs], new[:pairs]):
            differs = [c for c, x, y in zip(("text", "lang", "source"), a[1:], b[1:]) if x != y]
            out.append((b[0], a[0], "update" if differs else "same", tuple(differs), sha(b)))
        left[0].extend(old[pairs:])
        left[1].extend(new[pairs:])
    contents = defaultdict(lambda: ([], []))
    for side in (0, 1):
        for r in left[side]:
            contents[content(r)][side].append(r)
    for old, new in contents.values():
        old, new = sorted(old, key=size), sorted(new, key=size, reverse=True)
        pairs = min(len(old), len(new))
        out += [(b[0], a[0], "rekey", (), sha(b)) for a, b in zip(old, new)]
        out += [(a[0], a[0], "delete", (), None) for a in old[pairs:]]
        out += [(b[0], None, "insert", (), sha(b)) for b in new[pairs:]]
    return sorted(out, key=str)


def run(spark, earlier, later):
    frames = [spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA) for rows in (earlier, later)]
    return sorted(((r.key, r.old_key, r.op, tuple(r.changed), r.row_sha256) for r in snapshots.difference(*frames, "k", ("text", "lang", "source")).collect()), key=str)


def test_against_a_loop(spark):
    rng = random.Random(3)
    earlier, later = [], []
    for k in range(600):
        row = (k, rng.choice(["a", "b", "~", None, "", "long " * 500]), rng.choice(["en", None, "~"]), rng.choice(["s", "t"]))
        move = rng.randrange(6)
        earlier.append(row)
        if move == 1:
            later.append((k, (row[1] or "") + "+", row[2], None))
        elif move == 2:
            later.append((-1 - k, *row[1:]))
        elif move == 3:
            later += [row, (-1 - k, *row[1:])]
        elif move > 3:
            later.append(row)
    got = run(spark, earlier, later)
    assert got == plain(earlier, later)
    assert {r[2] for r in got} == {"same", "update", "rekey", "insert", "delete"}


@pytest.mark.parametrize("copies", [(400, 300), (300, 400)])
def test_one_content_over_many_tasks(spark, copies):
    """All rows of one content, and of few keys: runs cross every border."""
    old, new = copies
    earlier, later = [(k, "same", "en", None) for k in range(old)], [(10_000 + 3 * k, "same", "en", None) for k in range(new)]
    assert run(spark, earlier, later) == plain(earlier, later)


def test_repeated_and_null_keys(spark):
    earlier = [(1, "a", "en", "s")] * 3 + [(None, "b", "en", "s")] * 40 + [(2, "c", "en", "s"), (3, None, None, None)]
    later = [(1, "a", "en", "s")] * 2 + [(None, "b", "en", "s")] * 50 + [(3, None, None, None), (9, "c", "en", "s"), (8, "a", "en", "s")]
    assert run(spark, earlier, later) == plain(earlier, later)


def test_empty_tables(spark):
    rows = [(1, "a", None, "s"), (2, "a", None, "s")]
    assert run(spark, [], []) == []
    assert [r[2] for r in run(spark, rows, [])] == ["delete"] * 2
    assert [r[2] for r in run(spark, [], rows)] == ["insert"] * 2


def test_query_against_a_loop(spark, sf_dir):
    import zlib

    docs = shared.table(spark, sf_dir, "documents")
    earlier = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    later = []
    for k, text, lang, source in earlier:
        m = zlib.crc32(str(k).encode()) % 10
        row = {1: (k, (text or "") + "+", lang, source), 2: (k, text, source, lang), 3: (-1 - k, text, lang, source), 4: (-1 - k, text, lang, None)}.get(m, (k, text, lang, source))
        later += [row] * (m != 0) + [(-1 - k, text, lang, source)] * (m == 5)
    found = registry.op12_snapshot_difference(spark, sf_dir)
    assert found.columns == ["key", "old_key", "op", "changed", "row_sha256"]
    got = sorted(((r.key, r.old_key, r.op, tuple(filter(None, r.changed.split(","))), r.row_sha256) for r in found.collect()), key=str)
    assert got == plain(earlier, later)
