"""The correlator as a stream of prints: every micro-batch sweeps the stored facts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.functions.predicates import ago, at, within
from footfall.plans.correlate import (
    NO_EVENT_MAX_SECONDS,
    NO_EVENT_MIN_SECONDS,
    PRINT_SECONDS,
    sweep_stored,
)
from footfall.sources.tables import exists, remove
from footfall.streaming.sinks import read_state, run_batches, write_batch, write_state

SWEEP = "2 minutes"


def start_sweeps(
    prints: DataFrame,
    views_path: str,
    events_path: str,
    path: str,
    *,
    window_seconds: int = PRINT_SECONDS,
    min_seconds: int = NO_EVENT_MIN_SECONDS,
    max_seconds: int = NO_EVENT_MAX_SECONDS,
    every: str | None = SWEEP,
) -> StreamingQuery:
    """Raise the stored rows of clustered and of quiet visitors, batch by batch.

    The newest print is the time of a sweep; prints of the last ``window_seconds`` are
    carried on. ``path``/markers gets the confirmed addresses (ip_hash, kind, ts), which
    the ingest jobs take as their markers. A sweep that is repeated changes nothing more.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_state(spark, f"{path}/recent", batch_id)
        seen = batch if before is None else before.unionByName(batch)
        newest = seen.agg(F.max("ts")).first()[0]
        if newest is not None:
            seen = seen.filter(F.col("ts") >= at(ago(newest, seconds=window_seconds)))
        write_state(seen, f"{path}/recent", batch_id)
        if newest is None:
            return
        markers = sweep_stored(
            spark, views_path, events_path, spark.read.schema(seen.schema).parquet(f"{path}/recent/batch_id={batch_id}"),
            stage_dir=f"{path}/stage", as_of=newest, window_seconds=window_seconds,
            min_seconds=min_seconds, max_seconds=max_seconds,
        )
        write_batch(markers, f"{path}/markers", batch_id)

    return run_batches(prints, write, f"{path}/checkpoint", every=every)


def read_markers(spark: SparkSession, *paths: str, since: datetime | None = None) -> DataFrame:
    """The markers that these streams (of sweeps: confirmed addresses; of pageviews:
    suspected ones) have written, as the dimensions of the ingest jobs want them.
    ``since``: only those from then on, which files of older ones are not opened for."""
    found = spark.createDataFrame([], "ip_hash string, kind string, ts timestamp_ntz")
    for path in paths:
        if exists(spark, f"{path}/markers"):
            found = found.unionByName(spark.read.parquet(f"{path}/markers").select("ip_hash", "kind", "ts"))
    return within(found, since, ts="ts") if since is not None else found


def expire_markers(spark: SparkSession, path: str, before: datetime) -> int:
    """Delete the folders of micro-batches whose markers are all older than ``before``,
    and count them. A marker has no effect an hour after it; streams may go on."""
    if not exists(spark, f"{path}/markers"):
        return 0
    newest = spark.read.parquet(f"{path}/markers").groupBy("batch_id").agg(F.max("ts").alias("ts"))
    over = [r.batch_id for r in newest.where(F.col("ts") < at(before)).collect()]
    for batch in over:
        remove(spark, f"{path}/markers/batch_id={batch}")
    return len(over)
