"""SQLite files (GeoPackages too) as a Spark source, read-only, in ranges of the row id.

Options: ``path`` (a file that all executors reach), ``table``, ``schema`` (DDL), ``where`` (SQL, pushed to
the file), ``parts``.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tindra_sqlite"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.columns = options, schema.fieldNames()

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def _quoted(self, name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self._quoted(self.options['table'])}").fetchone()
        if low is None:
            return []
        step = max(1, -(-(high - low + 1) // int(self.options.get("parts", 1))))
        return [InputPartition((k, min(high, k + step - 1))) for k in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        low, high = partition.value
        columns = ", ".join(map(self._quoted, self.columns))
        also = f" AND ({self.options['where']})" if self.options.get("where") else ""
        with self._open() as db:
            for row in db.execute(f"SELECT {columns} FROM {self._quoted(self.options['table'])} WHERE rowid BETWEEN ? AND ?{also}", (low, high)):
                yield tuple(bytearray(x) if isinstance(x, bytes) else x for x in row)


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, where: str = "", parts: int = 1) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("tindra_sqlite").options(path=path, table=table, schema=schema, where=where, parts=parts).load()
