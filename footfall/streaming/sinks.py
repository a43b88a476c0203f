"""Idempotent micro-batch output and stream runs.

Every micro-batch owns its folders, so a batch repeated after a failure replaces
its own output and nothing else.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.sources.folders import write_filters
from footfall.sources.tables import remove, with_day

VIEW_FLUSH = "15 seconds"
EVENT_FLUSH = "10 seconds"
ATTEMPTS, WAIT = 3, 1.0  # of a batch that fails, and seconds before the second one


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_facts(df: DataFrame, path: str, batch_id: int, *, ts: str = "created_at", filters: bool = True) -> None:
    """The batch's part of a fact table by site and day, the table that reports read, and
    the filters of its visitors. Every task writes the rows it has; a repeated batch
    replaces its own folders."""
    rows = with_day(df, ts).withColumn("batch_id", F.lit(batch_id))
    if filters:
        write_filters(rows, path, batch_id)
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("site_id", "event_date", "batch_id").parquet(path)
    )


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_state(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What the batch before left behind, None for the first batch. A later batch
    whose state is missing raises: going on would count everything from the start."""
    return None if batch_id == 0 else spark.read.parquet(f"{path}/batch_id={batch_id - 1}")


def write_state(df: DataFrame, path: str, batch_id: int) -> None:
    """State after the batch. That of the batch before stays, in case this one is
    repeated; the one before that is needed no more."""
    write_batch(df, path, batch_id)
    if batch_id >= 2:
        remove(df.sparkSession, f"{path}/batch_id={batch_id - 2}")


def retried(write: Callable[[DataFrame, int], None], attempts: int = ATTEMPTS, wait: float = WAIT) -> Callable[[DataFrame, int], None]:
    """``write``, tried again after a failure: after ``wait`` seconds, then twice that, and
    so on. The last failure goes on and ends the stream, which takes the batch up again
    when it is restarted. Every batch owns its folders, so nothing is written twice."""

    def attempt(batch: DataFrame, batch_id: int) -> None:
        for turn in range(attempts):
            try:
                return write(batch, batch_id)
            except Exception:
                if turn + 1 == attempts:
                    raise
                time.sleep(wait * 2**turn)

    return attempt


def run_batches(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    *,
    every: str | None = None,
    output_mode: str = "append",
    attempts: int = ATTEMPTS,
    wait: float = WAIT,
) -> StreamingQuery:
    """Start a stream: at a fixed interval, or once over everything available."""
    writer = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(retried(write, attempts, wait))
    )
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
