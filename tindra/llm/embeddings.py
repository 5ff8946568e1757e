"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank.

Iterative quantisation learns, from a bounded sample (``TRAIN_ROWS``), rotations of the principal axes
under which the signs, cut at the sample's medians, are balanced binary codes that lose little.  The
codes of as many rotations as needed stand one after the other.  The multi-index cuts them into disjoint
substrings, a table each; vectors of one label that agree in a whole substring meet in its bucket, and
those of a bucket are compared by cosine of the original vectors in double precision.  A pair counts in
the first table where it meets.  Buckets are dealt to pairs of blocks; ids and blocks are dealt first,
vectors join last.

Substring length and number of tables are measured, not assumed (``Planner``).  From the sample pairs
are made at exactly the threshold, towards other vectors of the sample and in random directions, and
real links of the sample are added.  For a length, tables are added until ``RECALL`` of each of these
kinds meet; of all lengths the one with the least work is taken, work being the rows dealt and the
comparisons that buckets of the sample ask for.  Length 0, one bucket of the whole label in blocks, is
for vectors so alike that no code tells links from others: it is taken where all codes ask for over
``WHOLE`` times its work.
Plans hang on the label's size in powers of two; labels of under ``1 / shared.HOT_SHARES`` of all rows
share the plan of the largest such label.

Equal vectors of a label are one node with a weight before any of this.

Semantics: vectors that are null, empty, zero or hold null or non-finite components, and rows without
a label or id, link with nothing (component_id is their own id); rows that share a vec_id are separate
vectors under one name; vectors of another dimension than the sample's commonest are compared within
label and dimension; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.llm import kernel, shared, units

COSINE, TRAIN_ROWS, RECALL, STEPS = 0.93, 4096, 0.998, 30
PAIRS = 1024  # sampled pairs of each kind
BLOCK, BLOCK_BYTES = 2048, 1 << 21  # vectors, and bytes of doubles, in one side of a unit
LEAST_BLOCK, SHARES = 256, 16  # smaller buckets are cut in up to SHARES blocks of at least so many
DEALING = 64  # comparisons that take as long as dealing one row to a bucket
WHOLE = 4


@dataclass
class Index:
    """Projection to code bits, their thresholds, and per size class of labels its bits and tables."""

    projection: np.ndarray
    middle: np.ndarray
    plans: dict[int, tuple[int, int]]

    def code(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.projection > self.middle).astype(np.uint64)

    def keys(self, unit: np.ndarray, label: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Per vector its bucket numbers; ``size`` is the size class of its label."""
        code = self.code(unit)
        out: list = [None] * len(unit)
        for s in np.unique(size).tolist():
            rows = np.flatnonzero(size == s)
            for k, keys in zip(rows.tolist(), bucket_keys(code[rows], label[rows], *self.plans[s])):
                out[k] = keys
        return out


def bucket_keys(code: np.ndarray, label: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Vectors x tables: hashes of the disjoint substrings, distinct between labels and tables."""
    base = kernel.mix(label.astype(np.int64).view(np.uint64) + np.uint64(0x1234567))
    out = np.empty((len(code), tables), np.uint64)
    for t in range(tables):
        out[:, t] = kernel.mix(_substring(code, bits, t) ^ kernel.mix(base + np.uint64(t)))
    return out.view(np.int64)


def _substring(code: np.ndarray, bits: int, t: int) -> np.ndarray:
    return (code[:, t * bits : (t + 1) * bits].astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class Planner:
    """Learns rotations as they are asked for, and measures codes on sampled pairs."""

    def __init__(self, sample: np.ndarray, cosine: float = COSINE, recall: float = RECALL, seed: int = 5):
        self.rng = np.random.default_rng(seed)
        cut = len(sample) // 4 if len(sample) >= 400 else 0  # pairs come from rows that the rotations do not fit
        self.apart = sample[:cut] if cut else sample
        self.sample, self.recall = sample[cut:], recall
        sample = self.sample
        self.axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
        self.projections: list[np.ndarray] = []
        self.middles: list[np.ndarray] = []
        self.codes: list[list[np.ndarray]] = []  # per rotation: of the sample, of the pairs' two sides
        self.pairs(cosine)

    def pairs(self, cosine: float) -> None:
        n, dim = self.apart.shape
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        a = self.apart[self.rng.integers(0, n, 2 * PAIRS)]
        ways = np.vstack((self.apart[self.rng.integers(0, n, PAIRS)], self.rng.standard_normal((PAIRS, dim))))
        ways = ways - (ways * a).sum(axis=1, keepdims=True) * a
        ways[np.linalg.norm(ways, axis=1) < 1e-9] = self.rng.standard_normal(dim)
        ways = unit(ways - (ways * a).sum(axis=1, keepdims=True) * a)
        b = cosine * a + np.sqrt(1 - cosine * cosine) * ways
        near = self.apart @ self.sample.T
        i, j = np.nonzero((near >= cosine) & (near < cosine + (1 - cosine) / 2))  # links near the threshold
        some = self.rng.permutation(len(i))[:PAIRS] if len(i) >= 50 else np.zeros(0, np.int64)
        self.a, self.b = np.vstack((a, self.apart[i[some]])), np.vstack((b, self.sample[j[some]]))
        self.kind = np.repeat([0, 1, 2], [PAIRS, PAIRS, len(some)])

    def turn(self) -> None:
        """One more rotation by iterative quantisation."""
        dim = self.sample.shape[1]
        turn = np.linalg.qr(self.rng.standard_normal((dim, dim)))[0]
        v = self.sample @ self.axes
        v = v - v.mean(axis=0)
        for _ in range(STEPS):
            u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = w.T @ u.T
        projection = self.axes @ turn
        middle = np.median(self.sample @ projection, axis=0)
        self.projections.append(projection)
        self.middles.append(middle)
        self.codes.append([(x @ projection > middle).astype(np.uint64) for x in (self.sample, self.a, self.b)])

    def code(self, bits: int) -> list[np.ndarray]:
        """At least ``bits`` bits of sample and pairs."""
        while len(self.projections) * self.sample.shape[1] < bits:
            self.turn()
        return [np.hstack(x) for x in zip(*self.codes)]

    def plan(self, size: int) -> tuple[int, int]:
        """Bits and tables for a label of ``size`` vectors."""
        best = (WHOLE * (DEALING * (1 + size / BLOCK) + size), 0, 1)
        kinds = [k for k in (0, 1, 2) if (self.kind == k).any()]
        for bits in range(1, max(2, int(np.ceil(np.log2(max(size, 2)))) + 2)):
            met, work, t = np.zeros(len(self.kind), bool), 0.0, 0
            codes = self.code(8 * bits)
            while min(met[self.kind == k].mean() for k in kinds) < self.recall and work < best[0]:
                if (t + 1) * bits > codes[0].shape[1]:
                    codes = self.code(2 * codes[0].shape[1])
                own, a, b = (_substring(x, bits, t) for x in codes)
                met |= a == b
                count = np.unique(own, return_counts=True)[1]
                work += DEALING + size * float((count * (count - 1.0)).sum() / max(1, len(own) * (len(own) - 1)))
                t += 1
            if work < best[0]:
                best = (work, bits, t)
        return best[1:]


def learn(sample: np.ndarray, sizes: set[int], cosine: float = COSINE, recall: float = RECALL, seed: int = 5) -> Index:
    """Fits the rotations and plans all size classes (a class s holds labels of up to ``2 ** s``)."""
    planner = Planner(sample, cosine, recall, seed)
    plans = {s: planner.plan(1 << s) for s in sorted(sizes)}
    need = max(1, max(bits * tables for bits, tables in plans.values()))
    planner.code(need)
    return Index(np.hstack(planner.projections)[:, :need], np.concatenate(planner.middles)[:need], plans)


def usable(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which rows can link; where each row's vector starts and ends in the flat values; these values,
    as doubles."""
    col = batch.column("embedding")
    n = len(col)
    off = np.asarray(col.offsets).astype(np.int64)
    flat = col.values
    values = np.asarray(flat.fill_null(float("nan")).cast(pa.float64()))
    start, end = off[:-1], off[1:]
    ok = np.ones(n, bool)
    for valid in (col, batch.column("label"), batch.column("vec_id")):
        ok &= np.asarray(valid.is_valid().to_numpy(zero_copy_only=False)).astype(bool)
    ok &= end > start
    rows = np.flatnonzero(ok)
    if len(rows):
        at = kernel.ragged(start[rows], (end - start)[rows])
        begin = np.cumsum((end - start)[rows]) - (end - start)[rows]
        size = np.abs(values[at])
        finite = np.logical_and.reduceat(np.isfinite(size), begin)
        ok[rows] = finite & (np.maximum.reduceat(size, begin) > 0)
    return ok, start, end, values


def units_of(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors, whatever their scale."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vectors(rows: DataFrame, width: int) -> DataFrame:
    """vec_id, label, dim, node and node2 (hashes of label and vector), vector (bytes of its components,
    ``width`` each); all but the first two null where a vector cannot link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, start, end, values = usable(batch)
            raw = np.ascontiguousarray(values + 0.0).view(np.uint8)  # -0.0 is 0.0
            label = np.asarray(batch.column("label").fill_null(0)).astype(np.int64).view(np.uint64)
            two = [kernel.mix(kernel.word_hashes(raw, 8 * start, 8 * end, key) ^ kernel.mix(label + key)).view(np.int64) for key in kernel._KEYS]
            data = values.astype(f"<f{width}").tobytes()
            vector = [data[width * a : width * b] if good else None for good, a, b in zip(ok.tolist(), start.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(end - start, mask=~ok), *(pa.array(h, mask=~ok) for h in two), pa.array(vector, pa.binary())], ["vec_id", "label", "dim", "node", "node2", "vector"])

    return rows.mapInArrow(run, "vec_id long, label long, dim long, node long, node2 long, vector binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in doubles."""
    data = b"".join(column.to_pylist())
    width = len(data) // max(1, len(column) * dim) or 8
    return units_of(np.frombuffer(data, f"<f{width}").reshape(-1, dim).astype(np.float64))


def _keyed(classes: DataFrame, index: Index | None, dim: int, sizes: dict[int, int], rest: int) -> DataFrame:
    """node, keys, bits and code (packed) of ``classes`` (node, label, dim, vector); ``sizes`` has the
    size class of the largest labels, ``rest`` that of all others."""
    names = np.array(sorted(sizes), np.int64)
    shipped = classes.sparkSession.sparkContext.broadcast((index, names, np.array([sizes[k] for k in names.tolist()], np.int64)))  # HOT_SHARES labels at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, names, of = shipped.value
        for batch in batches:
            label, dims = np.asarray(batch.column("label")).astype(np.int64), np.asarray(batch.column("dim"))
            keys: list = [None] * batch.num_rows
            bits, code = np.zeros(batch.num_rows, np.int32), [b""] * batch.num_rows
            fits = np.flatnonzero(dims == dim) if ix else np.zeros(0, np.int64)
            if len(fits):
                at = np.searchsorted(names, label[fits])
                known = at < len(names)
                known[known] = names[at[known]] == label[fits][known]
                size = np.full(len(fits), rest)
                size[known] = of[at[known]]
                for lo in range(0, len(fits), units.STRIP):
                    rows, of_rows = fits[lo : lo + units.STRIP], size[lo : lo + units.STRIP]
                    unit = _matrix(batch.column("vector").take(pa.array(rows)), dim)
                    packed = np.packbits(ix.code(unit).astype(bool), axis=1)
                    for k, s, r, c in zip(rows.tolist(), of_rows.tolist(), ix.keys(unit, label[rows], of_rows), packed):
                        keys[k], bits[k], code[k] = r, ix.plans[s][0], c.tobytes()
            other = np.flatnonzero(np.array([k is None for k in keys], bool))  # another dimension: one bucket
            far = kernel.mix(kernel.mix(label.view(np.uint64)) + dims.view(np.uint64)).view(np.int64)
            for k in other.tolist():
                keys[k] = far[k : k + 1]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(keys, pa.list_(pa.int64())), pa.array(bits), pa.array(code, pa.binary())], ["node", "keys", "bits", "code"])

    return classes.select("node", "label", "dim", "vector").mapInArrow(run, "node long, keys array<long>, bits int, code binary")


def _substrings(unit: pa.Table, rows: np.ndarray, tables: int) -> np.ndarray:
    """Rows x the substrings of the first tables."""
    bits = unit.column("bits")[int(rows[0])].as_py()
    packed = np.frombuffer(b"".join(unit.column("code").combine_chunks().take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
    code = np.unpackbits(packed, axis=1, count=tables * bits)
    return np.stack([_substring(code, bits, k) for k in range(tables)], axis=1)


def _linker(cosine: float):
    def link(unit: pa.Table) -> dict[str, np.ndarray]:
        """Links of a unit; only vectors of one label and dimension are compared, and a pair that met
        in an earlier table is left out."""
        node, block, weight, label, dims = (np.asarray(unit.column(c)) for c in ("node", "b", "copies", "label", "dim"))
        t, cross = unit.column("t")[0].as_py(), unit.column("i")[0].as_py() != unit.column("j")[0].as_py()
        adj = np.zeros((len(node), len(node)), bool)
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            x = _matrix(unit.column("vector").combine_chunks().take(pa.array(rows)), dim)
            for lo in range(0, len(rows), units.STRIP):
                s = rows[lo : lo + units.STRIP]
                near = (x[lo : lo + units.STRIP] @ x.T >= cosine) & (s[:, None] < rows[None, :]) & (label[s][:, None] == label[rows][None, :])
                if cross:
                    near &= block[s][:, None] != block[rows][None, :]
                a, b = np.nonzero(near)
                if t and len(a):
                    ends, at = np.unique(np.concatenate((lo + a, b)), return_inverse=True)
                    early = _substrings(unit, rows[ends], t)
                    late = (early[at[: len(a)]] == early[at[len(a) :]]).any(axis=1)
                    a, b = a[~late], b[~late]
                adj[s[a], rows[b]] = True
        adj |= adj.T
        return units.summarise(node, weight, adj)

    return link


def near_vectors(rows: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept, n_copies (rows of the label with the same vector)."""
    width = 4 if rows.schema[vector_column].dataType.simpleString() == "array<float>" else 8
    picked = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding"), F.col(label_column).cast("long").alias("label"))
    found = units.one_content(shared.settle(vectors(picked, width), "vectors"), "vectors")
    total = found.count()
    classes = found.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    classes = shared.settle(classes, "vector-classes")
    counts = classes.groupBy("label").agg(F.count("*").alias("n"))
    bound = total // shared.HOT_SHARES
    large = {r.label: r.n for r in counts.where(F.col("n") > bound).collect()}  # at most HOT_SHARES labels
    power = lambda n: max(1, int(n - 1).bit_length())
    rest = power(min(bound, counts.where(F.col("n") <= bound).agg(F.max("n")).first()[0] or 1) or 1)
    sizes = {k: power(n) for k, n in large.items()}
    dim, index = 0, None
    if dims := classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect():
        dim = dims[0].dim
        sample = shared.bounded_sample(classes.where(F.col("dim") == dim).select("node", "vector"), "node", TRAIN_ROWS).toArrow()
        index = learn(_matrix(sample.column("vector").combine_chunks(), dim), {rest, *sizes.values()}, cosine)
    keyed = shared.settle(_keyed(classes, index, dim, sizes, rest), "vector-keys")
    tables = keyed.select("node", F.posexplode("keys").alias("t", "key"))
    crowd = tables.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    block = F.least(F.greatest(F.col("size") / SHARES, F.lit(LEAST_BLOCK)), F.lit(max(2, min(BLOCK, BLOCK_BYTES // (8 * max(dim, 1))))))
    crowd = shared.settle(crowd.withColumn("blocks", F.ceil(F.col("size") / block)), "vector-buckets")
    met = shared.lookup(tables, crowd, ["key"], "size", total).where("size IS NOT NULL")
    dealt = units.deal(met, "key", "node", "blocks").select("key", "blocks", "i", "j", "b", "t", "node")
    full = dealt.join(classes.select("node", "copies", "label", "dim", "vector").join(keyed.drop("keys"), "node"), "node")
    links = shared.settle(units.in_units(full, "key", _linker(cosine)), "vector-links")
    return units.resolve(found.select("vec_id", "node"), classes.select("node", "first_id", "copies"), links, "vec_id", total)
