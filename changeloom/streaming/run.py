"""Running streams (STM-19)."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import shared_dir


def start(df: DataFrame, writer: Callable[[DataFrame, int], Any], checkpoint: str,
          mode: str = "append", trigger: dict[str, Any] | None = None):
    """STM-19: start a stream whose progress and state live in ``checkpoint``.

    ``writer(batch, batch_id)`` must be idempotent per batch id: after a failure the
    last batch is given again.
    """
    return df.writeStream.outputMode(mode).foreachBatch(writer) \
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})) \
        .start()


def drain(df: DataFrame, mode: str = "append", checkpoint: str | None = None,
          out: str | None = None, through=None) -> DataFrame:
    """Run a stream over all input there is; the output is a table in the shared folder.

    Each micro-batch replaces its own sub-folder, so a repeated batch does not double
    rows.  ``_batch`` is the micro-batch number.  ``through(batch, batch_id)`` makes the rows
    to write out of each batch and names their ``schema``, as
    :class:`changeloom.streaming.totals.ChangingTotals` does.
    """
    spark = df.sparkSession
    out = out or shared_dir(spark, "stream-out")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if through is None else through(batch, batch_id)
        rows.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    query = start(df, write, checkpoint or shared_dir(spark, "stream-checkpoint"), mode)
    query.awaitTermination()
    # add() changes a schema in place
    schema = T.StructType([*(df if through is None else through).schema.fields,
                           T.StructField("_batch", T.LongType())])
    try:
        return spark.read.schema(schema).option("basePath", out).parquet(f"{out}/_batch=*")
    except AnalysisException:       # no input, so no batch was written
        return spark.createDataFrame([], schema)


def run_to_idle(df: DataFrame, checkpoint: str, mode: str = "append", seconds: float = 1,
                patience: float = 600) -> tuple[DataFrame, int]:
    """Run a stream by the clock until a trigger after its rows finds no more of them.

    For streams with clock timers, which never end an ``availableNow`` run.  Gives the rows of
    this run (with ``_batch``) and the number of the last batch that read input.  A stream
    that reads nothing for ``patience`` seconds is an error.
    """
    spark = df.sparkSession
    out = shared_dir(spark, "stream-out")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    query = start(df, write, checkpoint, mode, {"processingTime": f"{seconds} seconds"})
    began, last_read = time.monotonic(), None
    try:
        while query.isActive:
            for p in query.recentProgress:
                if p.numInputRows:
                    last_read = max(p.batchId, -1 if last_read is None else last_read)
            newest = query.lastProgress
            if last_read is not None and newest.batchId >= last_read and not newest.numInputRows:
                break
            if last_read is None and time.monotonic() - began > patience:
                raise TimeoutError(f"no input within {patience} seconds")
            time.sleep(0.2)
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
    schema = T.StructType([*df.schema.fields, T.StructField("_batch", T.LongType())])
    rows = spark.read.schema(schema).option("basePath", out).parquet(f"{out}/_batch=*")
    return rows.filter(F.col("_batch") <= last_read), last_read
