"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder; a local run without one gets a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read again: its plan is a scan, however it was made, and a lost executor costs no recomputation of what led to it."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task whose work is Python's for each row (milliseconds a row).
EACH = 2_000


def spread(df: DataFrame, each: int | None = None) -> DataFrame:
    """``df`` dealt evenly to tasks of ``each`` rows (``EACH``) at most: files are split by their bytes, so small rows with much work behind each would lie in few tasks, however many
    there are. The rows are counted for it; streams and what one task does stay as they are."""
    n = 1 if df.isStreaming else -(-df.count() // (each or EACH))
    return df.repartition(n) if n > 1 else df
