"""Time-ordered operators that stay parallel when one key dominates.

All of them cut a key's timeline into buckets of time, so no task ever needs the
whole history of a key. Times are compared as microseconds (UTC session).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

SECOND = 1_000_000


def micros(ts: str | Column) -> Column:
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def _bucket(time: Column, length: int) -> Column:
    return F.floor(time / F.lit(length)).cast("bigint")


def _own_and_before(
    summaries: DataFrame, keys: Sequence[str], own: str, before: str
) -> DataFrame:
    """Per key and bucket: ``own`` of that bucket and ``before`` of the previous one."""
    none = F.lit(None).cast("bigint")
    places = F.array(
        F.struct(
            F.col("_bucket").alias("_bucket"), F.col(own).alias("_own"), none.alias("_before")
        ),
        F.struct(
            (F.col("_bucket") + 1).alias("_bucket"), none.alias("_own"), F.col(before).alias("_before")
        ),
    )
    return (
        summaries.select(*keys, F.inline(places))
        .groupBy(*keys, "_bucket")
        .agg(F.max("_own").alias("_own"), F.max("_before").alias("_before"))
    )


# --- presence of a marker shortly before ----------------------------------------


def seen_within(
    probes: DataFrame,
    markers: DataFrame,
    *,
    keys: Sequence[str],
    probe_ts: str,
    marker_ts: str,
    seconds: int,
    name: str,
) -> DataFrame:
    """Flag probes that have a marker of the same key at most ``seconds`` earlier.

    With buckets as long as the period, the earliest marker of the own bucket and
    the latest of the bucket before decide, so the markers shrink to one row per
    key and bucket before they meet the probes.
    """
    length = seconds * SECOND
    marks = (
        markers.select(*keys, micros(marker_ts).alias("_at"))
        .withColumn("_bucket", _bucket(F.col("_at"), length))
        .groupBy(*keys, "_bucket")
        .agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    )
    time = micros(probe_ts)
    seen = (F.col("_own") <= time) | (F.col("_before") >= time - length)
    return (
        probes.withColumn("_bucket", _bucket(time, length))
        .join(_own_and_before(marks, keys, "_first", "_last"), [*keys, "_bucket"], "left")
        .select(*probes.columns, F.coalesce(seen, F.lit(False)).alias(name))
    )


# --- last value before a row ------------------------------------------------------


def last_before(
    rows: DataFrame,
    value: Column,
    name: str,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    include_current: bool,
    seconds: int = 86_400,
) -> DataFrame:
    """The last non-NULL value of the key before each row (or up to it). A row with a
    NULL key is nobody's: before it there is nothing, up to it there is its own value.

    Inside a bucket of time this is a window; across buckets only one row per
    key and bucket is looked at. ``order`` starts with the time column.
    """
    rows = rows.withColumn("_bucket", _bucket(micros(order[0]), seconds * SECOND)).withColumn(
        "_value", value
    )
    keyed = F.lit(True)
    for key in keys:
        keyed = keyed & F.col(key).isNotNull()
    nobody = rows.filter(~keyed).withColumn(
        name, F.col("_value") if include_current else F.lit(None).cast(rows.schema["_value"].dataType)
    ).drop("_bucket", "_value")
    rows = rows.filter(keyed)
    until = 0 if include_current else -1
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, until)
    )
    place = F.when(F.col("_value").isNotNull(), F.struct(*order))
    earlier = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.max_by("_value", place).alias("_closing"))
        .select(
            *keys, "_bucket", F.last("_closing", ignorenulls=True).over(earlier).alias("_carried")
        )
        .filter(F.col("_carried").isNotNull())
    )
    found = (
        rows.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
        .join(carried, [*keys, "_bucket"], "left")
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_bucket", "_value", "_inside", "_carried")
    )
    return found.unionByName(nobody)


def latest_within(
    probes: DataFrame,
    facts: DataFrame,
    value: str,
    *,
    keys: Sequence[str],
    probe_ts: str,
    fact_ts: str,
    seconds: int,
    name: str,
) -> DataFrame:
    """The value of the last fact of the key at or before each probe, if it is at
    most ``seconds`` old. Facts are repeated in the following bucket only."""
    length = seconds * SECOND
    time = micros(fact_ts)
    known = facts.select(
        *keys,
        time.alias("_at"),
        F.struct(time.alias("at"), F.col(value).alias("value")).alias("_fact"),
        F.explode(F.array(_bucket(time, length), _bucket(time, length) + 1)).alias("_bucket"),
        F.lit(0).alias("_kind"),
    )
    asked = (
        probes.withColumn("_at", micros(probe_ts))
        .withColumn("_bucket", _bucket(F.col("_at"), length))
        .withColumn("_kind", F.lit(1))
    )
    upto = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy("_at", "_kind", F.col("_fact")["value"])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = F.col("_found")
    return (
        asked.unionByName(known, allowMissingColumns=True)
        .withColumn("_found", F.last("_fact", ignorenulls=True).over(upto))
        .filter(F.col("_kind") == 1)
        .withColumn(name, F.when(F.col("_at") - found["at"] <= length, found["value"]))
        .drop("_at", "_bucket", "_kind", "_fact", "_found")
    )


# --- anchored fixed windows -----------------------------------------------------------
#
# A window of a key starts at its first hit and restarts at the first hit more
# than W later, so each start depends on all earlier ones. Time is cut into chunks
# of some W. Each chunk of a key is summarised by how it moves an incoming start
# to an outgoing one; the summaries, one row per chunk, are chained per key; then
# every chunk lists its own starts. All keys go the same way, many in one batch.


def _final_starts(times: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Index of the last start in its row for a chain starting at each hit. ``times``
    are ascending over all rows, with more than W between rows; ``ends`` are where
    each hit's row ends."""
    here = np.arange(len(times))
    jump = np.searchsorted(times, times + length, side="right")
    reach = np.where(jump < ends, jump, here)
    while True:
        further = reach[reach]
        if np.array_equal(further, reach):
            return reach
        reach = further


def _summarise(length: int, chunk: int):
    """Rows (keys, _chunk, _times) to (keys, _chunk, _bounds, _outcome)."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_times")
            sizes = np.asarray(lists.value_lengths())
            times = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            ends = np.cumsum(sizes)
            within = times - batch.column("_chunk").to_numpy()[row] * chunk
            final = _final_starts(within + row * (chunk + 2 * length), ends[row], length)
            # an incoming window ends before chunk start + W: only hits up to the
            # first one after that can be its next start
            first_late = np.append(True, within[:-1] < length) & (within >= length)
            entry = (within < length) | first_late | np.isin(np.arange(len(row)), ends - sizes)
            entry_row, bounds, outcome = row[entry], times[entry], times[final][entry]
            # entries next to each other with the same outcome need one row only
            last = np.append((outcome[1:] != outcome[:-1]) | (entry_row[1:] != entry_row[:-1]), True)[: len(bounds)]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(entry_row[last], minlength=len(sizes)))]).astype(np.int32)
            found = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[last])) for v in (bounds, outcome)]
            names = [n for n in batch.schema.names if n != "_times"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *found], names=[*names, "_bounds", "_outcome"])

    return summary


def _chain(length: int, keys: list[str]):
    """Summaries in order of key and chunk to (keys, _chunk, _incoming)."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = None, None
        for batch in batches:
            incoming = []
            columns = [batch.column(k).to_pylist() for k in keys]
            for key, bounds, outcome in zip(zip(*columns), batch.column("_bounds").to_pylist(), batch.column("_outcome").to_pylist()):
                if key != known:
                    known, start = key, None
                incoming.append(start)
                step = 0 if start is None else bisect_right(bounds, start + length)
                if step < len(bounds):
                    start = outcome[step]
            kept = [batch.column(n) for n in (*keys, "_chunk")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(incoming, pa.int64())], names=[*keys, "_chunk", "_incoming"])

    return chain


def _list_starts(length: int, keys: list[str]):
    """Rows (keys, _times, _incoming) to (keys, _start)."""

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, (times, incoming) in enumerate(zip(batch.column("_times"), batch.column("_incoming").to_pylist())):
                times = times.values.to_numpy()
                at = 0 if incoming is None else int(np.searchsorted(times, incoming + length, side="right"))
                while at < len(times):
                    rows.append(row)
                    found.append(int(times[at]))
                    at = int(np.searchsorted(times, found[-1] + length, side="right"))
            taken = [batch.column(k).take(pa.array(rows, pa.int32())) for k in keys]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(found, pa.int64())], names=[*keys, "_start"])

    return starts


def window_starts(
    hits: DataFrame, *, keys: Sequence[str], ts: str, seconds: int, chunk_seconds: int | None = None
) -> DataFrame:
    """Starts (``_start``, microseconds) of the anchored windows of every key.

    ``chunk_seconds`` (16 windows unless given, never less than one) is the stretch
    of one key's time that a row holds, whatever share of all hits the key has.
    """
    keys, length = list(keys), seconds * SECOND
    chunk = max(chunk_seconds or 16 * seconds, seconds) * SECOND
    chunks = (
        hits.select(*keys, micros(ts).alias("_t")).dropna()
        .groupBy(*keys, _bucket(F.col("_t"), chunk).alias("_chunk"))
        .agg(F.array_sort(F.collect_set("_t")).alias("_times"))
    )
    times_list = ArrayType(LongType())
    key_fields = [hits.schema[k] for k in keys]
    chunked = [*key_fields, StructField("_chunk", LongType())]
    moves = chunks.mapInArrow(
        _summarise(length, chunk), StructType([*chunked]).add("_bounds", times_list).add("_outcome", times_list)
    )
    incoming = (
        moves.repartition(*keys).sortWithinPartitions(*keys, "_chunk")
        .mapInArrow(_chain(length, keys), StructType([*chunked]).add("_incoming", LongType()))
    )
    return chunks.join(incoming, [*keys, "_chunk"]).mapInArrow(
        _list_starts(length, keys), StructType([*key_fields]).add("_start", LongType())
    )


def anchored_count(
    hits: DataFrame,
    *,
    keys: Sequence[str],
    ts: str,
    tiebreak: str,
    seconds: int,
    name: str,
    chunk_seconds: int | None = None,
) -> DataFrame:
    """Number of each hit within its anchored window, and the window's start.

    A bucket of length W holds at most one start, so the start of a hit's window
    lies in its own bucket or the one before: an equi join, split by time.
    """
    keys, length = list(keys), seconds * SECOND
    starts = window_starts(hits, keys=keys, ts=ts, seconds=seconds, chunk_seconds=chunk_seconds).withColumn(
        "_bucket", _bucket(F.col("_start"), length)
    )
    near = _own_and_before(starts, keys, "_start", "_start")
    start = F.when(F.col("_own") <= F.col("_t"), F.col("_own")).otherwise(F.col("_before"))
    # hits without a key or time have no window: each stands alone, not all in one task
    alone = F.when(F.col("_start").isNull(), F.col(tiebreak))
    inside = Window.partitionBy(*keys, "_start", alone).orderBy(ts, tiebreak)
    time = micros(ts)
    return (
        hits.withColumns({"_t": time, "_bucket": _bucket(time, length)})
        .join(near, [*keys, "_bucket"], "left")
        .withColumn("_start", start)
        .select(
            *hits.columns,
            F.row_number().over(inside).alias(name),
            F.timestamp_micros("_start").cast("timestamp_ntz").alias("window_start"),
        )
    )


def continue_windows(
    hits: DataFrame,
    open_windows: DataFrame | None,
    *,
    keys: Sequence[str],
    ts: str,
    tiebreak: str,
    seconds: int,
    name: str,
) -> DataFrame:
    """``anchored_count`` of hits whose keys may have windows open already (keys,
    window_start, count). A carried window comes back as one row at its start."""
    rows = hits.withColumn("_carried", F.lit(None).cast("bigint"))
    if open_windows is not None:
        carried = open_windows.select(
            *keys, F.col("window_start").alias(ts), F.col("count").alias("_carried")
        )
        rows = rows.unionByName(carried, allowMissingColumns=True)
    counted = anchored_count(
        rows, keys=keys, ts=ts, tiebreak=tiebreak, seconds=seconds, name="_number"
    )
    if open_windows is None:
        return counted.withColumn(name, F.col("_number").cast("bigint")).drop("_carried", "_number")
    # the carried row stands for all its hits, wherever in its window it is
    known = counted.filter(F.col("_carried").isNotNull()).groupBy(*keys, "window_start").agg(
        F.sum(F.col("_carried") - 1).alias("_offset")
    )
    return (
        counted.filter(F.col("_carried").isNull())
        .join(known, [*keys, "window_start"], "left")
        .withColumn(name, F.col("_number") + F.coalesce("_offset", F.lit(0)))
        .drop("_carried", "_number", "_offset")
    )


def open_after(
    counted: DataFrame,
    before: DataFrame | None,
    *,
    keys: Sequence[str],
    ts: str,
    seconds: int,
    name: str,
    late: int,
) -> DataFrame:
    """Windows (keys, window_start, count, newest) that hits up to ``late`` seconds
    behind the newest one may still fall into; of each key also the one it is in."""
    windows = counted.filter(F.col("window_start").isNotNull()).groupBy(*keys, "window_start").agg(F.max(name).alias("count"))
    newest = counted.agg(F.max(ts).alias("newest"))
    if before is not None:
        windows = (
            windows.unionByName(before.select(*keys, "window_start", "count"))
            .groupBy(*keys, "window_start").agg(F.max("count").alias("count"))
        )
        newest = newest.unionByName(before.agg(F.max("newest").alias("newest"))).agg(F.max("newest").alias("newest"))
    end = newest.first()["newest"]
    if end is None:
        return windows.withColumn("newest", F.lit(None).cast("timestamp_ntz"))
    kept = micros("window_start") >= micros(F.lit(end).cast("timestamp_ntz")) - (seconds + late) * SECOND
    return windows.filter(kept).withColumn("newest", F.lit(end).cast("timestamp_ntz"))
