"""Performance metrics and request-log statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.predicates import ago, at, since, where_equal, within
from footfall.operators.ranks import nearest_ranks


def query_metrics(
    metrics: DataFrame,
    *,
    category: str | None = None,
    metric: str | None = None,
    since: datetime | None = None,
    limit: int = 1000,
) -> DataFrame:
    rows = where_equal(metrics, category=category, metric=metric)
    if since is not None:
        rows = rows.filter(F.col("recorded_at") >= at(since))
    return rows.orderBy(F.desc("recorded_at"), "id").limit(limit)


def metric_trends(
    metrics: DataFrame, *, limit: int = 30, since: datetime | None = None
) -> DataFrame:
    """The last ``limit`` values of every metric, oldest first. The rank filter is
    applied in each task before the shuffle, so a dominant metric stays small."""
    rows = metrics if since is None else metrics.filter(F.col("recorded_at") >= at(since))
    newest = Window.partitionBy("category", "metric").orderBy(F.desc("recorded_at"), "id")
    return (
        rows.withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= limit)
        .withColumn("key", F.concat("category", F.lit("/"), "metric"))
        .drop("rn")
        .orderBy("key", "recorded_at", F.desc("id"))
    )


def request_stats(
    requests: DataFrame, *, as_of: datetime | None = None, minutes: int = 5
) -> DataFrame:
    """Counters over the whole log, latency over the last minutes.

    Percentiles are exact nearest ranks of the durations inside the window.
    """
    recent = since("ts", as_of, minutes=minutes)
    rows = requests.select("status", F.when(recent, F.col("duration_ms")).alias("duration"))
    inside = within(requests, ago(as_of, minutes=minutes), ts="ts")
    ranks = nearest_ranks(inside, "duration_ms", (0.5, 0.95, 0.99))
    errors = F.count_if(F.col("status") >= 500)
    counted = rows.agg(
        F.count("*").alias("total_requests"),
        errors.alias("total_errors"),
        F.count("duration").alias("recent_requests"),
        F.coalesce(F.round(F.avg("duration"), 2), F.lit(0.0)).alias("avg_response_ms"),
        F.coalesce(F.max("duration"), F.lit(0.0)).alias("max_ms"),
        F.round(F.count("duration") / F.lit(minutes * 60.0), 2).alias("rps"),
        F.coalesce(
            F.round(errors * 100.0 / F.nullif(F.count("*"), F.lit(0)), 2), F.lit(0.0)
        ).alias("error_rate"),
    )
    # one row each
    percentiles = [F.coalesce(f"p{i}", F.lit(0.0)).alias(n) for i, n in enumerate(("p50_ms", "p95_ms", "p99_ms"))]
    return (
        counted.withColumn("_one", F.lit(1)).join(ranks.select(*percentiles, F.lit(1).alias("_one")), "_one")
        .select(
            "total_requests", "total_errors", "recent_requests", "avg_response_ms",
            "p50_ms", "p95_ms", "p99_ms", "max_ms", "rps", "error_rate",
        )
    )


def slow_paths(
    requests: DataFrame, *, as_of: datetime | None = None, minutes: int = 5
) -> DataFrame:
    return (
        within(requests, ago(as_of, minutes=minutes), ts="ts")
        .groupBy("path")
        .agg(
            F.floor(F.sum("duration_ms") / F.count("*") + 0.5).cast("bigint").alias("avg_ms"),
            F.count("*").alias("count"),
        )
        .orderBy(F.desc("avg_ms"), "path")
        .limit(5)
    )
