"""WARC archives: written with revisit records, read back by boundary-chain verification.

Writing: each task appends the records of the rows it reads to files of about ``FILE_BYTES``, one gzip
member per record.  Of the records with equal payloads the one with the smallest id is the response,
the others are revisits that name it and carry no payload.  Payloads are never shuffled: a first pass
takes ids and digests, digests meet in an aggregation, and what is decided goes to one small table per
partition of the input, which the task that writes the partition reads back.  An input that is not a
plain scan is stored first, so both passes see the same partitions; should they differ all the same, the
task fails with an error that says so.

Reading: files are cut into byte ranges, one task each.  A task looks for member starts in its range,
also where bytes inside a payload only look like one, and emits every candidate with the offset of its
successor.  Candidates of a range are first followed to the point where their chain leaves the range;
then pointer jumping over the ranges' exits, doubling the distance each round, finds what is reachable
from the file's start.  Only reachable records are decoded.  A chain that does not end at its file's
end - a damaged or cut file - is an error that names the file and the offset.

Semantics: null html is the empty payload; rows with a null id get the id text ``-``, read back as null,
and are revisits of the record with the smallest id where one has their payload, else responses; rows
that repeat an id with its payload are records of the same kind; extra columns are ignored; an empty
table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.llm import shared

FILE_BYTES = 32 << 20
RANGE_BYTES = 4 << 20
MAGIC = b"\x1f\x8b\x08"
HEAD = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member without time stamp; level 0 stores the bytes as they are."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers: int | None, level: int = 6) -> bytes:
    """A response record, or a revisit of the record of ``refers``."""
    name = lambda x: f"<urn:tindra:page:{'-' if x is None else x}>"
    uri = "".join(c for c in (url or "about:blank") if c > " ")
    lines = [f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}"]
    body = payload
    if refers is not None:
        lines += [f"WARC-Refers-To: {name(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return member(HEAD + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", level)


def parse(data: bytes) -> dict | None:
    """The fields of a decoded record; None where it is not a whole one."""
    stop = data.find(b"\r\n\r\n")
    if not data.startswith(HEAD) or stop < 0:
        return None
    fields = {}
    for line in data[len(HEAD) : stop].split(b"\r\n"):
        key, _, value = line.partition(b":")
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isdigit() or len(data) != stop + 8 + int(length) or not data.endswith(b"\r\n\r\n"):
        return None
    fields["body"] = data[stop + 4 : stop + 4 + int(length)]
    return fields


def page_of(name: str) -> int | None:
    text = name.rpartition(":")[2].rstrip(">")
    return int(text) if text.lstrip("-").isdigit() else None


def decisions(picked: DataFrame, least: int) -> DataFrame:
    """part, page_id, sha and refers_to of every row of ``picked`` (page_id, payload), where part is the
    number of the input's partition and refers_to the smallest id with the payload, null in responses."""
    rows = shared.settle(picked.select(F.spark_partition_id().alias("part"), "page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size")), "digests")
    first = rows.where(F.col("size") >= least).groupBy("sha").agg(F.min("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1 AND leader IS NOT NULL")
    named = shared.lookup(rows, shared.settle(first, "leaders"), ["sha"], "n", rows.count())
    return named.select("part", "page_id", "sha", F.when(F.coalesce(F.col("page_id") > F.col("leader"), F.col("leader").isNotNull()), F.col("leader")).alias("refers_to"))


def _decided(paths: list[str], part: int) -> dict[tuple, int | None]:
    """The decisions for one partition of the input, from the row groups that hold some."""
    import pyarrow.parquet as pq

    out: dict[tuple, int | None] = {}
    for path in paths:
        with shared.open_shared(path, "r") as f:
            cols = pq.read_table(f, columns=["page_id", "sha", "refers_to"], filters=[("part", "=", part)]).to_pydict()
        out.update(zip(zip(cols["page_id"], cols["sha"]), cols["refers_to"]))
    return out


def write(pages: DataFrame, folder: str, least: int = 0, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", level: int = 6) -> DataFrame:
    """Writes the archives; the manifest has a row per file: path, bytes."""
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit("")).cast("binary")
    picked = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"))
    if not shared.is_scan(picked):
        picked = shared.settle(picked, "pages")
    decided = shared.fresh(picked.sparkSession, "decisions")
    # as many files as tasks, whatever the number of partitions; a partition is bounded by the reader
    n = int(picked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = decisions(picked, least).repartitionById(n, F.pmod("part", F.lit(n)).cast("int")).sortWithinPartitions("part")
    dealt.write.option("parquet.block.size", 1 << 20).parquet(decided)
    files: dict[int, list[str]] = {}
    for path in shared.files_in(decided, ".parquet"):
        files.setdefault(int(path.rsplit("/", 1)[1].split("-")[1]), []).append(path)  # n names
    rows = picked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        known = None

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            path = f"{folder}/part-{part:06d}-{number:06d}.warc.gz"
            shared.publish(path, b"".join(held))
            out = pa.RecordBatch.from_pydict({"path": [path], "bytes": [size]})
            number, held, size = number + 1, [], 0
            return out

        for batch in batches:
            known = _decided(files.get(part % n, []), part) if known is None else known
            for page, url, payload in zip(*(batch.column(c) for c in ("page_id", "url", "payload"))):
                page, payload = page.as_py(), payload.as_py()
                key = (page, hashlib.sha1(payload).hexdigest())
                if key not in known:
                    raise RuntimeError(f"partition {part} of the pages changed between two reads; store the table first")
                held.append(record(page, url.as_py(), payload, known[key], level))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(run, "path string, bytes long")


def _member_end(f, at: int, size: int) -> tuple[bytes, int] | None:
    """The decoded member at ``at`` and the offset after it; None where there is none."""
    z, parts, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            chunk = f.read_at(min(1 << 16, size - pos), pos)
            if not chunk:
                return None
            parts.append(z.decompress(chunk))
            pos += len(chunk)
            if len(parts) == 1 and len(parts[0]) >= len(HEAD) and not parts[0].startswith(HEAD):
                return None
    except zlib.error:
        return None
    return b"".join(parts), pos - len(z.unused_data)


def scan(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Candidates of all byte ranges: path, at, leaves (where its chain leaves the range).

    A range's candidates are all offsets in it where a whole record decodes, chained or not."""
    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("low"))
    n = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, low in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "low"))):
                with shared.open_shared(path, "r") as f:
                    high = min(low + range_bytes, size)
                    raw = f.read_at(min(high + len(MAGIC) - 1, size) - low, low)
                    nxt: dict[int, int] = {}
                    at = raw.find(MAGIC)
                    while at >= 0:
                        if (got := _member_end(f, low + at, size)) and parse(got[0]) is not None:
                            nxt[low + at] = got[1]
                        at = raw.find(MAGIC, at + 1)
                leaves = dict(nxt)
                for at in sorted(nxt, reverse=True):
                    leaves[at] = leaves.get(nxt[at], nxt[at])
                if nxt:
                    yield pa.RecordBatch.from_pydict({"path": [path] * len(nxt), "low": [low] * len(nxt), "at": list(nxt), "next": list(nxt.values()), "leaves": [leaves[k] for k in nxt]})

    return ranges.repartition(n, "path", "low").mapInArrow(run, "path string, low long, at long, next long, leaves long")


def entries(candidates: DataFrame) -> DataFrame:
    """Per range of a file, the offset at which the chain from the file's start enters it.

    Pointer jumping: a round reaches twice as many ranges as all before it."""
    jump = candidates.select("path", F.col("at").alias("here"), F.col("leaves").alias("there"))
    reached = candidates.where("at = 0").select("path", "at")
    count = -1
    while True:
        ahead = reached.join(jump, (reached["path"] == jump["path"]) & (reached["at"] == jump["here"])).select(reached["path"], F.col("there").alias("at"))
        grown = shared.settle(reached.unionByName(ahead).distinct(), "reached")
        if (size := grown.count()) == count:
            return grown
        reached, count = grown, size
        a, b = jump.alias("a"), jump.alias("b")
        jump = shared.settle(a.join(b, (F.col("a.path") == F.col("b.path")) & (F.col("a.there") == F.col("b.here")), "left").select("a.path", "a.here", F.coalesce("b.there", "a.there").alias("there")), "jumps")


def read(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    payload (null in revisits)."""
    candidates = shared.settle(scan(manifest, range_bytes), "candidates")
    starts = entries(candidates)
    reached = starts.groupBy("path").agg(F.max("at").alias("at"))
    broken = manifest.join(reached, "path", "left").where("bytes > 0 AND coalesce(at, 0) <> bytes").orderBy("path")
    if cut := broken.limit(5).collect():
        raise ValueError("records end before the file does: " + ", ".join(f"{r.path} at byte {r['at'] or 0} of {r.bytes}" for r in cut))
    todo = starts.join(candidates.select("path", "low", "at"), ["path", "at"])
    n = int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = todo.join(manifest, "path").repartition(n, "path", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, low, at, size in zip(*(batch.column(c).to_pylist() for c in ("path", "low", "at", "bytes"))):
                rows: list[tuple] = []
                held = 0
                with shared.open_shared(path, "r") as f:
                    while at < min(low + range_bytes, size):
                        got = _member_end(f, at, size)
                        x = parse(got[0]) if got else None
                        if x is None:
                            raise ValueError(f"no whole record in {path} at byte {at}")
                        data, at = got
                        refers = x.get("warc-refers-to")
                        rows.append((page_of(x["warc-record-id"]), x["warc-target-uri"], None if refers else x["body"], int(x["warc-payload-length"]) if refers else len(x["body"]), x["warc-payload-digest"].partition(":")[2] if refers else digest(x["body"]), x["warc-type"], page_of(refers) if refers else None))
                        held += len(data)
                        if held > 1 << 23:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return sized.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = "page_id url payload payload_bytes payload_digest record_type refers_to".split()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back."""
    folder = shared.fresh(pages.sparkSession, "warc")
    return read(shared.settle(write(pages, folder, least), "warc-manifest"))
