"""Remote services as Spark sources: paged, batched and per-point reads behind injectable functions.

A service is a callable that the caller gives; nothing here opens a connection by itself, so plans can
be tested with a stub.  Calls retry with growing pauses; a call that fails for good gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tindra.functions.lineage import settle
from tindra.operators.order import batches

PAGE_ROWS, MOST_PAGES, BATCH_IDS = 100, 99, 20


def retried(call: Callable, tries: int = 3, pause: Callable[[int], float] = lambda k: 2.0 * k, default=None):
    """The call's result; after ``tries`` failures the default.  ``pause(k)`` is slept after failure k."""
    for k in range(1, tries + 1):
        try:
            return call()
        except Exception:  # noqa: BLE001 - any failure of a remote service counts as one
            if k < tries:
                time.sleep(pause(k))
    return default


class PagedSource(DataSource):
    """Pages 1..n of a service, one partition per ``pages_per_task`` pages.

    The option ``fetch`` names an importable function ``module:function`` of a page number that returns
    a list of tuples; an empty or failing page ends its partition's run."""

    @classmethod
    def name(cls) -> str:
        return "tindra_pages"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        most, step = int(self.options.get("pages", MOST_PAGES)), int(self.options.get("pagespertask", MOST_PAGES))
        return [InputPartition((lo, min(most, lo + step - 1))) for lo in range(1, most + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, function = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), function)
        low, high = partition.value
        for page in range(low, high + 1):
            rows = retried(lambda page=page: fetch(page), tries=1)
            if not rows:
                return
            yield from (tuple(r) for r in rows)


def per_point(points: DataFrame, search: Callable[[float, float], Iterable[tuple]], schema: str) -> DataFrame:
    """A search around every point (lat, lon); rows carry the point's columns and the hit's place."""
    names = points.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*p, k, *hit) for p in batch.itertuples(index=False) for k, hit in enumerate(retried(lambda p=p: list(search(p.lat, p.lon)), tries=1, default=[]))]
            yield pd.DataFrame(rows, columns=[*names, "hit", *(x.split()[0] for x in schema.split(", "))])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInPandas(run, f"{kinds}, hit int, {schema}")


def pages(spark: SparkSession, fetch: Callable[[int], list[tuple]], schema: str, first: int = 1, most: int = MOST_PAGES, wave: int = 16) -> tuple[DataFrame, int]:
    """Rows (page and ``schema``) of the pages from ``first`` on, up to the first that is empty or fails, and
    the number of that page, from which a later read goes on.

    Pages are fetched in waves of ``wave`` at once, a task each, and a wave's rows are settled; the end
    holds over all tasks, and at most ``wave`` - 1 pages behind it are asked for."""
    found, at, names = None, first, [x.split()[0] for x in schema.split(", ")]
    while at <= most:
        n = min(wave, most - at + 1)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for page in batch["page"].tolist():
                    rows = retried(lambda page=page: list(fetch(page)), tries=1, default=[])
                    yield pd.DataFrame([(page, True, *r) for r in rows] or [(page, False, *[None] * len(names))], columns=["page", "full", *names])

        got = settle(spark.range(at, at + n, 1, n).withColumnRenamed("id", "page").mapInPandas(run, f"page long, full boolean, {schema}"))
        empty = got.where("NOT full").agg(F.min("page")).first()[0]
        rows = got.where(F.col("full") & (F.col("page") < (empty if empty is not None else at + n))).drop("full")
        found = rows if found is None else found.unionByName(rows)
        if empty is not None:
            return found, empty
        at += n
    return found if found is not None else spark.createDataFrame([], f"page long, {schema}"), at


def in_batches(ids: DataFrame, key: str, order: str, fetch: Callable[[list], dict], size: int = BATCH_IDS) -> DataFrame:
    """Contents of ids, ``size`` ids a call, in batches of the whole order; ids without content get the
    empty text.  The numbers come from a range sort and one row per task (``order.batches``)."""
    numbered = batches(ids, [], [F.asc(order)], size)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        got = retried(lambda: fetch(pdf[key].tolist()), default={}) or {}
        return pd.DataFrame({key: pdf[key], "content": [got.get(k, "") for k in pdf[key]]})

    kind = ids.schema[key].dataType.simpleString()
    return numbered.groupBy("batch").applyInPandas(run, f"{key} {kind}, content string")


def external_stage(df: DataFrame, columns: list[str], call: Callable[..., str], result: str = "result") -> DataFrame:
    """A column computed by an external function of other columns (translation, summary, comparison)."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{result} string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{result: [retried(lambda a=args: call(*a)) for args in zip(*(batch[c] for c in columns))]})

    return df.mapInPandas(run, schema)


def rendered(df: DataFrame, render: Callable[[int, str], bytes], key: str = "id", text: str = "text") -> DataFrame:
    """Audio or other bytes of each row's text, rendered in as many tasks as the table has partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "data": [render(k, t) for k, t in zip(batch[key], batch[text])]})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, data binary")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
