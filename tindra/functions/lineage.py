"""Cutting lineage in iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of our own where none is set on one machine.  On a
    cluster it must be set: executors would write to disks of their own."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if not folder:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = folder or _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="tindra-"))
        context.setCheckpointDir(folder)
    return folder


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
