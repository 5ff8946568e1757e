"""Near copies of texts and vectors against all pairs."""

import itertools
import random

import numpy as np
import pytest

from tindra.llm import embeddings, graph, near_copies, shared, units


def groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(60)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = groups(500, pairs)
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [[word() for _ in range(80)] for _ in range(6)]
    rows = []
    for k, words in enumerate(base):
        for v in range(14):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                copy[rng.randrange(80)] = word()
            rows.append((100 * k + v, " ".join(copy)))
    rows += [(900 + i, " ".join(word() for _ in range(80))) for i in range(20)]
    rows += [(950, "Just four short words"), (951, "just FOUR short, words!"), (952, "one"), (953, ""), (954, None), (955, ""), (956, "  ..  ")]
    return rows


def jaccard_links(rows):
    import re

    sets = {}
    for k, (_, t) in enumerate(rows):
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b])]


@pytest.mark.parametrize("block", [512, 5])
def test_near_copies_are_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "LEAST_BLOCK", min(block, near_copies.LEAST_BLOCK))
    rows = corpus()
    links = jaccard_links(rows)
    want = groups(len(rows), links)
    degree = [sum(k in p for p in links) for k in range(len(rows))]
    df = spark.createDataFrame([(a, b, 1, "c") for a, b in rows], "doc_id long, text string, node int, copies string").repartition(3)
    got = {r.doc_id: r for r in near_copies.near_copies(df).collect()}
    for k, (doc, _) in enumerate(rows):
        smallest = min(rows[j][0] for j in range(len(rows)) if want[j] == want[k])
        assert (got[doc].n_links, got[doc].component_id, got[doc].kept) == (degree[k], smallest, smallest == doc), doc


def test_near_copies_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "z" * 200_000)]
    got = sorted(near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_links, r.component_id, r.kept))
    assert by == {None: [(0, None, True)], 1: [(1, 1, True)] * 2, 2: [(0, 2, True)]}
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_of_the_documents_are_all_pairs(spark, sf_dir):
    """Every link of the synthetic documents, by an inverted index of their shingles."""
    import collections
    import os

    folder = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    docs = spark.read.parquet(f"{folder if os.path.isdir(folder) else sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    import pyarrow as pa

    sets = [set(x.tolist()) for x in near_copies.shingle_sets(pa.array([t for _, t in rows], pa.string()))]
    index = collections.defaultdict(list)
    for k, x in enumerate(sets):
        for gram in x:
            index[gram].append(k)
    both = collections.Counter(p for own in index.values() for p in itertools.combinations(own, 2))
    links = [(a, b) for (a, b), n in both.items() if n * 10 >= 8 * (len(sets[a]) + len(sets[b]) - n)]
    degree = collections.Counter(x for p in links for x in p)
    got = {r.doc_id: r.n_links for r in near_copies.near_copies(docs).collect()}
    assert len(links) > 20 and sum(got.values()) >= 0.98 * 2 * len(links)
    assert all(got[d] <= degree[k] for k, (d, _) in enumerate(rows))


def test_repeated_ids_and_very_long_copies(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", 4000)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    long = [word() for _ in range(60_000)]
    near = list(long)
    near[100] = "other"
    bits = lambda x: "".join(x[bin(k).count("1") % 2] for k in range(4096))
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:30_000])), (4, bits("ab")), (5, bits("ba")), (4, bits("ab")), (9, "one of many under one name")]
    rows += [(9, " ".join(word() for _ in range(30))) for _ in range(50)]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r.doc_id: (r.n_links, r.component_id) for r in got}
    assert len(got) == len(rows) and by[1] == by[2] == (1, 1) and by[3] == (0, 3) and by[4] == (1, 4) and by[5] == (0, 5)
    assert all(r.n_links == 0 for r in got if r.doc_id == 9)


def test_prefixes_shorten_to_the_recall():
    d = near_copies.stop_depth({})
    assert near_copies.expected(d) >= near_copies.RECALL > near_copies.expected(d + 1)
    assert near_copies.stop_depth({near_copies.DEPTH: 10**9}) == near_copies.DEPTH  # all pairs seen meet at the whole path
    assert near_copies.stop_depth({3: 10**6, near_copies.DEPTH: 10**6}) == 3  # half of them only at three minima


def test_probes_are_at_the_least_similarity():
    sets = [np.unique(np.random.default_rng(k).integers(1, 1 << 62, n, np.uint64)) for k, n in enumerate((3, 9, 90, 900))]
    codes = near_copies.probe(sets, near_copies.signatures(sets), np.array([0, 1, 2, 3]))
    counts = [[c >> 4 * d & 15 for d in range(near_copies.DEPTH + 1)] for c in codes]
    assert all(sum(c) == near_copies.PARTNERS for c in counts)
    assert counts[0][near_copies.DEPTH] == near_copies.PARTNERS  # no set of three has a partner but itself


def test_runs_that_cross_tasks_are_one(spark):
    rows = [(0, 7 << 40, k) for k in range(500)] + [(1, k << 20, k) for k in range(300)]
    df = spark.createDataFrame(rows, "tree int, path long, node long").repartitionByRange(9, "tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    found = near_copies._matched(df, 6).collect()
    pairs = [(r.a, r.b) for r in found if r.b is not None]
    by = {}
    for r in found:
        if r.b is None:
            by.setdefault((r.tree, r.level, r.key), []).append(r.a)
    pairs += [(x, min(v)) for v in by.values() for x in v]
    assert len(set(groups(500, pairs))) == 1
    assert not [p for p in by if p[0] == 1 and len(by[p]) > 1 and p[1] > 6]  # the other tree's paths all differ


def vectors():
    rng = np.random.default_rng(6)
    rows = []
    for k in range(40):
        center = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), (center + rng.standard_normal(16) * 0.12).astype(float).tolist(), k % 3))
    odd = [None, [], [0.0] * 16, [1.0] * 15 + [float("nan")], [1.0] * 15 + [None], [float("inf")] * 16]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(1010, rows[0][1], None), (1011, rows[0][1], 0), (1012, [2 * x for x in rows[0][1]], 0), (1013, [1.0, 2.0], 0), (1014, [2.0, 4.0], 0), (1015, [2.0, 4.0], 1)]
    return rows


@pytest.mark.parametrize("block", [512, 3])
def test_near_vectors_are_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", block * 128)
    monkeypatch.setattr(embeddings, "LEAST_BLOCK", block)
    rows = vectors()

    def linked(a, b):
        if a[2] is None or a[2] != b[2] or any(not x[1] or None in x[1] or not np.isfinite(x[1]).all() or not any(x[1]) for x in (a, b)) or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1]), np.array(b[1])
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93

    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if linked(rows[a], rows[b])]
    want = groups(len(rows), links)
    df = spark.createDataFrame([(*r, "e") for r in rows], "vec_id long, embedding array<double>, label int, unit string").repartition(3)
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    found = sum(r.n_links for r in got.values())
    assert 0.99 * 2 * len(links) <= found <= 2 * len(links)
    exact = 0
    for k, row in enumerate(rows):
        exact += got[row[0]].component_id == rows[want[k]][0]
        assert got[row[0]].kept == (got[row[0]].component_id == row[0])
    assert exact >= 0.98 * len(rows)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)


def clouds():
    rng = np.random.default_rng(17)
    for offset in (0, 1, 2, 3):
        x = rng.standard_normal((1500, 24)) + offset
        yield f"offset {offset}", np.vstack((x, x[:500] + rng.standard_normal((500, 24)) * 0.33 * np.linalg.norm(x[:500], axis=1, keepdims=True) / 24**0.5))
    x = rng.standard_normal((2000, 32)) * 0.8 ** np.arange(32)
    yield "skewed axes", np.vstack((x, x[:500] + rng.standard_normal((500, 32)) * 0.05))
    yield "few dimensions", rng.standard_normal((2500, 6))


@pytest.mark.parametrize("name, x", list(clouds()), ids=lambda v: v if isinstance(v, str) else "")
def test_recall_on_all_kinds_of_clouds(name, x):
    x = unit(x)
    a, b = np.nonzero(np.triu(x @ x.T >= embeddings.COSINE, 1))
    assert len(a) > 200
    index = embeddings.learn(x[np.random.default_rng(1).permutation(len(x))[:1000]], {12})
    keys = np.stack(index.keys(x, np.zeros(len(x), np.int64), np.full(len(x), 12)))
    met = (keys[a] == keys[b]).any(axis=1).mean()
    print(name, index.plans, met)
    assert met >= 0.99


@pytest.mark.parametrize("dim", [8, 64])
def test_recall_at_the_threshold_in_large_labels(dim):
    rng = np.random.default_rng(dim)
    a, v = (unit(rng.standard_normal((3000, dim))) for _ in range(2))
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * unit(v - (v * a).sum(axis=1, keepdims=True) * a)
    index = embeddings.learn(unit(rng.standard_normal((4096, dim))), {17})
    keys = [np.stack(index.keys(x, np.zeros(3000, np.int64), np.full(3000, 17))) for x in (a, b)]
    assert (keys[0] == keys[1]).any(axis=1).mean() >= 0.99
    assert index.plans[17][0] >= 8  # a real code, not one bucket


def test_vectors_with_a_common_offset_link_as_all_pairs(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1200, 16)) + 2
    x = np.vstack((x, x[:100], x[:1].repeat(50, axis=0)))
    near = unit(x) @ unit(x).T >= 0.93
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(x)]
    label = np.arange(len(x)) % 2
    want = (near & (label[:, None] == label[None, :])).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect()}
    got = np.array([got[k] for k in range(len(x))])
    assert abs(got - want).sum() <= 0.02 * want.sum() and (got <= want + 1).all()


def test_runs_cross_batches():
    import pyarrow as pa

    table = pa.table({"k": [1, 1, 2, 2, 2, 3], "v": [0, 1, 2, 3, 4, 5]})
    got = [t.column("v").to_pylist() for t in units.runs(iter(table.to_batches(max_chunksize=2)), ("k",))]
    assert got == [[0, 1], [2, 3, 4], [5]]


def test_lookup_is_a_left_join(spark):
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else "hot" if k % 2 else f"k{k % 40}") for k in range(400)], "i int, key string")
    table = rows.where("key IS NOT NULL").groupBy("key").count().where("key <> 'k2'").withColumnRenamed("count", "n")
    for total in (0, 400, 10**6):
        got = sorted(map(tuple, shared.lookup(rows, table, ["key"], "n", total).select("i", "key", "n").collect()))
        assert got == sorted(map(tuple, rows.join(table, "key", "left").select("i", "key", "n").collect()))


def test_sweep_removes_the_sessions_tables(spark):
    import os

    shared.settle(spark.range(3), "to-go").count()
    assert os.listdir(shared.session_folder(spark))
    shared.sweep(spark)
    assert not os.path.exists(shared.session_folder(spark))


def test_clashing_contents_get_nodes_of_their_own(spark):
    rows = [(1, 7, 70), (2, 7, 71), (3, 7, 70), (4, 8, 1), (5, None, None)]
    got = {r.i: r.node for r in units.one_content(spark.createDataFrame(rows, "i int, node long, node2 long"), "t").collect()}
    assert got[1] == got[3] == 7 and got[2] not in (7, 8, None) and got[4] == 8 and got[5] is None
