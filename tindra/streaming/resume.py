"""Resumable loading as a stream with state: a record whose key was processed is not processed again.

The keys that are finished are the stream's state, kept by its checkpoint (RocksDB), so a batch looks up
its own keys only and the output is not read again, however long it gets.  A stream with a new checkpoint
starts from the keys that other runs have in the output: they are read once, as its first state.

Semantics: of the records of a key the first batch that brings any counts, and in it the smallest as JSON
text; all others are repeats, early or late, and left out.  With ``forget_ms`` a key is forgotten so long
after it was processed, which bounds the state; a record that comes later is new again.  Records without a
key are one key.  A batch is written under its own number before its keys count as finished, so a batch
that runs twice, after a crash or a restart, leaves one copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.utils import AnalysisException

# without batches of no data, which a state with an end of time would ask for on and on
_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
_ORDER = "_order_of_record"


class _Once(StatefulProcessor):
    """Lets one record of a key through, ever or until the key is forgotten."""

    def __init__(self, names: list[str], forget_ms: int | None):
        self.names, self.forget_ms = names, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "yes boolean", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            return
        best = None
        for part in rows:
            if len(part):
                part = part.set_axis(self.names, axis=1)  # beside a first state, batches do not keep all names
                first = part.sort_values(_ORDER, kind="stable").head(1)
                best = first if best is None or first[_ORDER].iloc[0] < best[_ORDER].iloc[0] else best
        self.done.update((True,))
        if best is not None:
            yield best

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.done.update((True,))

    def close(self) -> None:
        pass


def load_stream(arriving: DataFrame, output: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], key: str = "id", available_now: bool = True, forget_ms: int | None = None) -> StreamingQuery:
    """Runs ``process`` on the records of ``arriving`` whose key is not finished yet, into ``output``."""
    spark = arriving.sparkSession
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]  # batch numbers start anew with a checkpoint
    kind = arriving.schema[key].dataType
    try:  # only a new checkpoint's first batch reads this
        known = spark.read.parquet(output).where(F.col("_run") != run).select(F.col(key).cast(kind).alias(key)).distinct()
    except AnalysisException:  # nothing was written yet
        known = spark.createDataFrame([], arriving.select(key).schema)
    ordered = arriving.withColumn(_ORDER, F.to_json(F.struct(*arriving.columns)))
    stateful = ordered.groupBy(key).transformWithStateInPandas(_Once(ordered.columns, forget_ms), ordered.schema, "Update", "ProcessingTime" if forget_ms else "None", known.groupBy(key))

    def batch(rows: DataFrame, number: int) -> None:
        process(rows.drop(_ORDER)).write.mode("overwrite").parquet(f"{output}/_run={run}/_batch={number}")

    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():  # a stream takes the session's settings as it starts
        spark.conf.set(k, v)
    try:
        writer = stateful.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
