"""Near-duplicate texts: a MinHash LSH forest over word shingles, then exact verification.

Texts with equal shingle sets (five words, folded case) are one node.  A node's signature is ``TREES``
paths of ``DEPTH`` minima, a byte each, so a path is one number and a trie is a sorted table: all paths
are range-sorted by tree, path and node, and a matched prefix is a run of neighbours.  The order puts
rows of one common prefix in several tasks; runs that cross a task's border are joined by their ends.

From the whole path prefixes are shortened level by level until the target recall: in one of
``PROBE_EVERY`` nodes the feature pass makes partners at exactly the least similarity, from the node's
own shingle set, and notes the longest prefix that any tree shares with them.  Matching stops at the
deepest level at which these found pairs, with ``PRIOR`` pairs of the expected shares, reach ``RECALL``.
Every node is linked to the first node of its run on each level down to that one, which is linear in
the run, and a link stays if the signatures estimate at least ``NEAR``.  Components of those links are
the candidate groups, and all pairs inside a group are verified on the shingle sets, block by block.

Result: a row per document with its direct links (documents with Jaccard >= the threshold, copies
included), its component's smallest doc_id, and whether it is that document.

Semantics: null and empty texts (no words) link with nothing; texts under five words are one shingle
of all their words; a null doc_id takes no part (0 links, null component, kept); rows that share a
doc_id are separate texts under one name; an empty table gives no rows; extra columns are ignored.
Equal sets are told by 128 bits of hash, equal shingles inside a unit by 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.llm import graph, kernel, shared, units

SHINGLE, JACCARD = 5, 0.8
TREES, DEPTH, RECALL, NEAR = 32, 8, 0.9999, 0.6
PROBE_EVERY, PARTNERS, PRIOR = 64, 8, 2000
BLOCK, BLOCK_SHINGLES = 512, 1 << 20  # members of a candidate group, and their shingles, in one side of a unit
LEAST_BLOCK, SHARES = 128, 16  # smaller groups are cut in up to SHARES blocks of at least so many
_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 1 << 32, TREES * DEPTH, np.uint32)
_MUL = _RNG.integers(0, 1 << 31, TREES * DEPTH, np.uint32) * np.uint32(2) + np.uint32(1)


def expected(depth: int, similarity: float = JACCARD, trees: int = TREES) -> float:
    """The share of pairs of a similarity that agree in the first ``depth`` minima of some tree."""
    return 1 - (1 - similarity**depth) ** trees


def stop_depth(probed: dict[int, int], recall: float = RECALL) -> int:
    """The longest prefix with the target recall; ``probed`` counts pairs by the longest prefix shared."""
    n = sum(probed.values())
    for depth in range(DEPTH, 1, -1):
        found = sum(c for d, c in probed.items() if d >= depth)
        if (found + PRIOR * expected(depth)) / (n + PRIOR) >= recall:
            return depth
    return 1


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    off, data = kernel.buffers(texts)
    s, _, h = kernel.spans(off, data, kernel.WORDS)
    border = kernel.owners(off, s)
    return [np.unique(kernel.shingles(h[a:b], n)) for a, b in zip(border[:-1].tolist(), border[1:].tolist())]


def set_nodes(sets: list[np.ndarray], key: int = 0xA5A5A5A5) -> np.ndarray:
    """One signed 64-bit number per set."""
    sums = np.array([kernel.mix(x ^ np.uint64(key)).sum(dtype=np.uint64) + np.uint64(len(x)) for x in sets], np.uint64)
    return kernel.mix(sums).view(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Texts x (TREES * DEPTH) minima, a byte of each; the rows of empty sets are undefined."""
    full = [k for k, x in enumerate(sets) if len(x)]
    out = np.zeros((len(sets), TREES * DEPTH), np.uint8)
    if full:
        flat = (np.concatenate([sets[k] for k in full]) >> np.uint64(32)).astype(np.uint32)
        begin = np.cumsum([0, *(len(sets[k]) for k in full[:-1])])
        for k in range(TREES * DEPTH):
            out[full, k] = kernel.mix(np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], begin).astype(np.uint64)).astype(np.uint8)
    return out


def probe(sets: list[np.ndarray], sig: np.ndarray, which: np.ndarray) -> list[int | None]:
    """For the sets ``which`` the code ``sum(pairs << 4 * prefix)`` of partners at the least similarity
    by the longest prefix that some tree shares; None for the others."""
    out: list = [None] * len(sets)
    for k in which.tolist():
        x = sets[k]
        swap = int(len(x) * (1 - JACCARD) / (1 + JACCARD) + 1e-9)
        rng = np.random.default_rng(int(x[0] >> np.uint64(1)))
        part = []
        for _ in range(PARTNERS):
            new = rng.integers(0, 1 << 63, swap, np.uint64) * np.uint64(2) + np.uint64(1)
            part.append(np.concatenate((x[rng.permutation(len(x))[swap:]], new)))
        same = (signatures(part) == sig[k]).reshape(PARTNERS, TREES, DEPTH)
        longest = np.cumprod(same, axis=2).sum(axis=2).max(axis=1)
        out[k] = sum(int((longest == d).sum()) << 4 * d for d in range(DEPTH + 1))
    return out


def features(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, digest (of the text), node and node2 (hashes of the shingle set, null without words),
    size (shingles), sketch (a byte per minimum, tree by tree), probed (see ``probe``)."""
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in kernel.slices(batch, "text", 1 << 18):
                sets = shingle_sets(piece.column("text"))
                none = np.array([not len(x) for x in sets])
                sig, node = signatures(sets), set_nodes(sets)
                probed = probe(sets, sig, np.flatnonzero(~none & (node % PROBE_EVERY == 0)))
                cols = [
                    piece.column("doc_id"), piece.column("digest"), pa.array(node, mask=none), pa.array(set_nodes(sets, 0x5C5C5C5C), mask=none),
                    pa.array([len(x) for x in sets], pa.int64()), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array(probed, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "digest", "node", "node2", "size", "sketch", "probed"])

    return picked.mapInArrow(run, "doc_id long, digest long, node long, node2 long, size long, sketch binary, probed long")


def probed_prefixes(found: DataFrame) -> dict[int, int]:
    """Pairs by the longest prefix shared."""
    sums = [F.sum(F.shiftright("probed", 4 * d).bitwiseAND(15)).alias(str(d)) for d in range(DEPTH + 1)]
    return {int(d): c or 0 for d, c in found.where("probed IS NOT NULL").agg(*sums).first().asDict().items()}


def tries(named: DataFrame) -> DataFrame:
    """tree, path and node of all trees; a path is its minima's bytes, the first one highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                path = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), f">u{DEPTH}").astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), pa.array(path), pa.array(np.repeat(np.asarray(batch.column("node")), TREES))], ["tree", "path", "node"])

    return named.select("node", "sketch").mapInArrow(run, "tree int, path long, node long")


def _matched(sorted_tries: DataFrame, depth: int) -> DataFrame:
    """Links (a, b) of nodes to the first node of their run on every level from DEPTH to ``depth``; the
    runs at a task's two ends are returned with their prefix (b null, level and key of the prefix)."""
    levels = range(DEPTH, depth - 1, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: dict[int, tuple] = {}  # per level, the run that is open: tree, key and first node
        for batch in batches:
            if not batch.num_rows:
                continue
            trees, path, node = (np.asarray(batch.column(c)) for c in ("tree", "path", "node"))
            a, b, opened = [], [], dict(lead)
            for d in levels:
                key = path.view(np.uint64) >> np.uint64(8 * (DEPTH - d))
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (trees[1:] != trees[:-1])
                at = np.flatnonzero(new)
                first = node[at]
                if d in opened and opened[d][:2] == (int(trees[0]), int(key[0])):
                    first[0] = opened[d][2]
                first = np.repeat(first, np.diff(np.append(at, len(key))))
                if not opened:
                    lead[d] = (int(trees[0]), int(key[0]), int(first[0]))
                    yield _ends({d: lead[d]})
                lead[d] = (int(trees[-1]), int(key[-1]), int(first[-1]))
                linked = node != first
                a.append(node[linked])
                b.append(first[linked])
            pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *(pa.nulls(len(pairs), k) for k in (pa.int32(), pa.int32(), pa.int64()))], _EDGE)
        if lead:
            yield _ends(lead)

    return sorted_tries.mapInArrow(run, "a long, b long, tree int, level int, key long")


_EDGE = ["a", "b", "tree", "level", "key"]


def _ends(runs: dict[int, tuple]) -> pa.RecordBatch:
    tree, key, first = zip(*runs.values())
    cols = [pa.array(first, pa.int64()), pa.nulls(len(runs), pa.int64()), pa.array(tree, pa.int32()), pa.array(list(runs), pa.int32()), pa.array(np.array(key, np.uint64).view(np.int64))]
    return pa.RecordBatch.from_arrays(cols, _EDGE)


def _candidates(classes: DataFrame, depth: int) -> DataFrame:
    """Edges (a, b): a node and the first node of a run that it is in."""
    rows = shared.settle(tries(classes), "tries")
    ordered = rows.repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    found = shared.settle(_matched(ordered, depth), "matched")
    inner = found.where("b IS NOT NULL").select("a", "b")
    ends = found.where("b IS NULL").select("tree", "level", "key", "a").distinct()  # two runs a task and level
    least = ends.groupBy("tree", "level", "key").agg(F.min("a").alias("b"))
    crossing = ends.join(least, ["tree", "level", "key"]).where("a <> b").select("a", "b")
    return inner.unionByName(crossing).distinct()


def _estimated(edges: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """The edges whose signatures agree in at least ``NEAR`` of their minima."""
    sketches = classes.select("node", "sketch")
    firsts = shared.settle(edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("degree")).join(sketches, "node").select(F.col("node").alias("b"), "degree", F.col("sketch").alias("y")), "firsts")
    both = shared.lookup(edges, firsts, ["b"], "degree", total * TREES * DEPTH).join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= NEAR))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of membership matrices in column strips."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, inv, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared_ = count[inv] > 1
    own, col = owner[shared_], inv[shared_]
    order = np.argsort(col, kind="stable")
    own, col = own[order], col[order]
    new = np.concatenate(([True], col[1:] != col[:-1])) if len(col) else np.zeros(0, bool)
    col = np.cumsum(new) - 1
    out = np.zeros((n, n))
    width = max(64, (1 << 22) // max(n, 1))
    lo = 0
    top = int(col[-1]) + 1 if len(col) else 0
    for left in range(0, top, width):
        hi = int(np.searchsorted(col, left + width))
        m = np.zeros((n, min(width, top - left)), np.float32)
        m[own[lo:hi], col[lo:hi] - left] = 1
        out += m @ m.T
        lo = hi
    return out


def _link(unit: pa.Table) -> dict[str, np.ndarray]:
    """Verified links inside a unit; a cross unit only compares its two blocks with each other."""
    sets = shingle_sets(unit.column("text").combine_chunks())
    node, weight, block = (np.asarray(unit.column(c)) for c in ("node", "copies", "b"))
    size = np.array([len(x) for x in sets], np.int64)
    if len(sets) < 2:
        return units.summarise(node[:0], weight[:0], np.zeros((0, 0), bool))
    both = overlaps(sets)
    adj = both * 10 >= (size[:, None] + size[None, :] - both) * round(JACCARD * 10)  # whole numbers in doubles
    np.fill_diagonal(adj, False)
    if unit.column("i")[0].as_py() != unit.column("j")[0].as_py():
        adj &= block[:, None] != block[None, :]
    return units.summarise(node, weight, adj)


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_links, component_id, kept, n_copies (rows with the same shingle set)."""
    found = units.one_content(shared.settle(features(docs, id_column, text_column), "signatures"), "sets")
    total = found.count()
    named = found.where("doc_id IS NOT NULL AND node IS NOT NULL")
    first = F.min(F.struct("doc_id", "digest")).alias("first")
    classes = named.groupBy("node").agg(first, F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    classes = shared.settle(classes.select("node", F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("digest"), "copies", "size", "sketch"), "classes")
    edges = shared.settle(_candidates(classes, stop_depth(probed_prefixes(found))), "candidates")
    groups = shared.settle(graph.components(_estimated(edges, classes, total)), "groups")
    members = groups.join(classes.drop("sketch"), "node")
    block = F.least(F.greatest(F.count("*") / SHARES, F.lit(LEAST_BLOCK)), F.lit(BLOCK))
    sizes = shared.settle(members.groupBy("component").agg(F.count("*").alias("members"), F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks")), "group-sizes")
    members = shared.settle(shared.lookup(members, sizes, ["component"], "members", total), "members")
    dealt = units.deal(members, "component", "node", "blocks").select("component", "blocks", "i", "j", "b", "node", "copies", F.col("first_id").alias("doc_id"), "digest")
    full = dealt.join(_texts_of(docs, members, total, id_column, text_column), ["doc_id", "digest"])
    links = shared.settle(units.in_units(full.select("component", "blocks", "i", "j", "b", "node", "copies", "text"), "component", _link), "links")
    return units.resolve(found.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), classes, links, "doc_id", total)


def _texts_of(docs: DataFrame, members: DataFrame, total: int, id_column: str, text_column: str) -> DataFrame:
    """doc_id, digest and text of the members' first documents, once each."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
    wanted = members.select(F.col("first_id").alias("doc_id"), "digest", "copies")
    got = shared.lookup(texts.where("doc_id IS NOT NULL AND text IS NOT NULL"), wanted, ["doc_id", "digest"], "copies", total).where("copies IS NOT NULL")
    return got.dropDuplicates(["doc_id", "digest"]).drop("copies")
