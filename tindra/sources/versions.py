"""Tables whose changes are written: data files that never change, and a manifest per version.

A version is a manifest file that names, per partition, the folders its rows are in.  A change writes new
folders first; they belong to nothing until the next manifest names them, which is renamed into place and
fails if another writer was there first.  So a reader sees a version whole or not at all, and a writer
that dies leaves files that ``vacuum`` takes away.

Who loses the race looks at what came between: if it touched other partitions than this change read or
wrote, the change goes on top of it; else ``Conflict`` is raised and the caller decides anew.

Partitions are the values of one column (``replace_by_tag`` replaces one of them), or ``buckets`` hash
buckets of the key, so an upsert or delete rewrites only buckets that hold its keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tindra.operators import changes

PARTITION = "_partition"
TRIES = 20


class Conflict(RuntimeError):
    """Another writer changed partitions that this change read or wrote."""


class VersionedTable:
    """A table at ``path``; ``partition`` is an SQL expression over its columns that gives text."""

    def __init__(self, spark: SparkSession, path: str, partition: str = "'all'"):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition

    @classmethod
    def by_value(cls, spark: SparkSession, path: str, column: str) -> VersionedTable:
        return cls(spark, path, f"coalesce('=' || cast(`{column}` AS string), 'null')")

    @classmethod
    def by_bucket(cls, spark: SparkSession, path: str, key: str = "id", buckets: int = 64) -> VersionedTable:
        return cls(spark, path, f"cast(pmod(xxhash64(`{key}`), {buckets}) AS string)")

    # files ------------------------------------------------------------------------------------------
    def _at(self, inner: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{inner}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, inner: str) -> list[str]:
        path, store = self._at(inner)
        return sorted(x.getPath().getName() for x in store.listStatus(path)) if store.exists(path) else []

    def version(self) -> int:
        """The number of the last version; 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "parts": {}, "touched": []}
        path, store = self._at(f"versions/{version:012d}.json")
        stream = store.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Puts the manifest in its place; False if there is one already."""
        temp, store = self._at(f"versions/.{uuid.uuid4().hex}")
        target, _ = self._at(f"versions/{manifest['version']:012d}.json")
        out = store.create(temp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.makeQualified(temp).toUri(), self.spark._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # never over another file
        try:
            context.rename(store.makeQualified(temp), store.makeQualified(target), keep)
            return True
        except Exception as error:  # a Java exception: tell a lost race from other failures
            if store.exists(target):
                store.delete(temp, False)
                return False
            raise error

    # rows -------------------------------------------------------------------------------------------
    def read(self, version: int | None = None, partitions: set[str] | None = None) -> DataFrame:
        """The rows of a version, or of some of its partitions."""
        held = self.manifest(version)
        return self._rows(held, partitions)

    def _rows(self, held: dict, partitions: set[str] | None = None) -> DataFrame:
        if held["schema"] is None:
            raise ValueError(f"nothing was written to {self.path} yet")
        schema = StructType.fromJson(held["schema"])
        folders = [f for p, fs in sorted(held["parts"].items()) if partitions is None or p in partitions for f in fs]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _write(self, rows: DataFrame) -> tuple[dict[str, list[str]], int]:
        """New folders by partition, and how many rows went there."""
        folder = f"data/{uuid.uuid4().hex}"
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).withColumn(PARTITION, F.hex(F.encode(F.expr(self.partition), "UTF-8"))).write.partitionBy(PARTITION).parquet(f"{self.path}/{folder}")
        found = [n for n in self._names(folder) if n.startswith(f"{PARTITION}=")]
        return {bytes.fromhex(n.split("=", 1)[1]).decode(): [f"{folder}/{n}"] for n in found}, seen.get["n"]

    def _schema(self, held: dict, rows: DataFrame) -> dict:
        return held["schema"] or json.loads(rows.schema.json())

    def commit(self, change: Callable[[dict], tuple[dict[str, list[str]], set[str], dict]]) -> int:
        """Writes a version.  ``change`` takes the manifest it builds on and returns the new partitions,
        the names of those it read or wrote, and the schema."""
        base = self.manifest()
        parts, touched, schema = change(base)
        for _ in range(TRIES):
            if self._publish({"version": base["version"] + 1, "schema": schema, "parts": parts, "touched": sorted(touched)}):
                return base["version"] + 1
            latest = self.manifest()
            between = {p for v in range(base["version"] + 1, latest["version"] + 1) for p in self.manifest(v)["touched"]}
            if between & touched or "*" in between | touched:
                raise Conflict(f"version {latest['version']} of {self.path} changed the same partitions")
            mine = {p: fs for p, fs in parts.items() if p in touched}
            parts = {p: fs for p, fs in latest["parts"].items() if p not in touched} | mine
            base = latest
        raise Conflict(f"{self.path} is changed faster than this writer can follow")

    # changes ----------------------------------------------------------------------------------------
    def overwrite(self, rows: DataFrame) -> int:
        """All rows replaced."""
        new, _ = self._write(rows)
        return self.commit(lambda held: (new, {"*"}, json.loads(rows.schema.json())))

    def append(self, rows: DataFrame) -> int:
        """Rows added to what is there."""
        new, _ = self._write(rows)

        def change(held: dict):
            return {p: held["parts"].get(p, []) + new.get(p, []) for p in {*held["parts"], *new}}, set(new), self._schema(held, rows)

        return self.commit(change)

    def replace(self, partitions: set[str], rows: DataFrame) -> int:
        """Whole partitions replaced; rows of other partitions among ``rows`` are an error."""
        new, _ = self._write(rows)
        if set(new) - partitions:
            raise ValueError(f"rows of other partitions: {sorted(set(new) - partitions)[:5]}")
        return self.commit(lambda held: ({p: fs for p, fs in held["parts"].items() if p not in partitions} | new, set(partitions), self._schema(held, rows)))

    def replace_by_value(self, value: str | None, rows: DataFrame) -> int:
        """The rows of one value of the partition column replaced, of a table ``by_value``."""
        return self.replace({"null" if value is None else f"={value}"}, rows)

    def rewrite(self, touched: DataFrame, new_rows: Callable[[DataFrame], DataFrame]) -> int:
        """Rewrites the partitions of ``touched`` (rows with the columns that the partition hangs on):
        ``new_rows`` takes their present rows and returns what they are to be."""
        names = {r.p for r in touched.select(F.expr(self.partition).alias("p")).distinct().collect()}  # partition names

        def change(held: dict):
            new, _ = self._write(new_rows(self._rows(held, names)))
            return {p: fs for p, fs in held["parts"].items() if p not in names} | new, names | set(new), held["schema"]

        return self.commit(change)

    def upsert(self, incoming: DataFrame, key: str = "id", kept: tuple[str, ...] = ()) -> int:
        """``changes.upsert``, written; every incoming row has a key."""
        return self.rewrite(incoming, lambda rows: changes.upsert(rows, incoming, key, kept))

    def delete(self, ids: DataFrame, key: str = "id") -> int:
        return self.rewrite(ids, lambda rows: rows.join(ids.select(key), key, "left_anti").select(*rows.columns))

    def update(self, sets: DataFrame, key: str = "id") -> int:
        """``changes.update_columns``, written."""
        return self.rewrite(sets, lambda rows: changes.update_columns(rows, sets, key))

    def migrate(self, source: DataFrame) -> tuple[int, int]:
        """One-time copy: all rows replaced, keys kept.  What was written is counted again from its files
        before it counts as written; returns both numbers."""
        new, read = self._write(source)
        held = {"schema": json.loads(source.schema.json()), "parts": new}
        written = self._rows(held).count()
        if written != read:
            raise RuntimeError(f"{read} rows were read and {written} written; the table is as it was")
        self.commit(lambda _: (new, {"*"}, held["schema"]))
        return read, written

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes versions but for the last ``keep``, and folders that none of these names; not while
        writers are at work.  Returns the folders that went."""
        last = self.version()
        kept = [self.manifest(v) for v in range(max(1, last - keep + 1), last + 1)]
        named = {f.split("/")[1] for m in kept for fs in m["parts"].values() for f in fs}
        gone = [n for n in self._names("data") if n not in named]
        for name in gone:
            path, store = self._at(f"data/{name}")
            store.delete(path, True)
        for name in self._names("versions"):
            if not name.endswith(".json") or int(name.removesuffix(".json")) <= last - keep:
                path, store = self._at(f"versions/{name}")
                store.delete(path, False)
        return gone
