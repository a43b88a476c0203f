"""Reports from stored sketches: distinct visitors that others can be taken from, and
latency percentiles over any span of minutes.

A stored row has a bounded size whatever it stands for, and rows merge in any order and
number. Every task sketches its own rows before anything is shuffled, so one segment or
path may have any share of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.predicates import ago, within
from footfall.plans.rollup import SEGMENT, countable_views

LG_K = 14  # entries of a visitor sketch, as a power of two
RANKS_K = 800  # of a latency sketch: ranks are right to about 0.4 % of the rows


def _beside(rows: DataFrame, other: DataFrame) -> DataFrame:
    """``rows`` beside the one row of ``other``."""
    return rows.withColumn("_one", F.lit(1)).join(other.withColumn("_one", F.lit(1)), "_one").drop("_one")


# --- visitors ---------------------------------------------------------------------------


def rollup_visitors(views: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """Views and a Theta sketch of the visitors per day and segment. Excluded visitors are
    in it: they are taken out when it is read, so a change of the list holds for all
    stored days."""
    return countable_views(views, first, last).groupBy(*SEGMENT).agg(
        F.count("*").alias("views"), F.theta_sketch_agg("visitor_id", LG_K).alias("visitors")
    )


def _union(where: Column | None = None) -> Column:
    column = F.col("visitors") if where is None else F.when(where, F.col("visitors"))
    return F.theta_union_agg(column, LG_K)


def remaining_visitors(sketches: DataFrame, excluded: DataFrame, *by: str) -> DataFrame:
    """Unique visitors of any coarser grouping of ``rollup_visitors`` that are not
    excluded, and what is needed to tell how good the number is.

    Columns: ``unique_visitors`` (all less the excluded), ``all_visitors``,
    ``error`` (one standard error of the former). Up to 2 ** LG_K visitors are exact; beyond
    that the error of a difference goes with the root of what it is taken from.
    """
    gone = excluded.agg(F.theta_sketch_agg("visitor_id", LG_K).alias("_gone"))
    merged = _beside(sketches.groupBy(*by).agg(_union().alias("_all")), gone)
    counted = merged.select(
        *by,
        F.theta_sketch_estimate(F.theta_difference("_all", "_gone")).alias("unique_visitors"),
        F.theta_sketch_estimate("_all").alias("all_visitors"),
        F.theta_sketch_estimate("_gone").alias("_out"),
    )
    largest = F.greatest("all_visitors", "_out")
    error = F.sqrt(F.col("unique_visitors") * largest / F.lit(float(1 << LG_K)))
    return counted.withColumn("error", F.when(largest > (1 << LG_K), error).otherwise(0.0)).drop("_out")


def visitor_kinds(sketches: DataFrame, excluded: DataFrame, *by: str) -> DataFrame:
    """Visitors of any grouping that are not excluded, as ``only_new``, ``only_returning``
    and ``came_back`` (seen as new and as returning in the span)."""
    gone = excluded.agg(F.theta_sketch_agg("visitor_id", LG_K).alias("_gone"))
    merged = sketches.groupBy(*by).agg(
        _union(F.col("is_returning") == 0).alias("_new"), _union(F.col("is_returning") == 1).alias("_old")
    )
    left = _beside(merged, gone).withColumns(
        {"_new": F.theta_difference("_new", "_gone"), "_old": F.theta_difference("_old", "_gone")}
    )
    return left.select(
        *by,
        F.theta_sketch_estimate(F.theta_difference("_new", "_old")).alias("only_new"),
        F.theta_sketch_estimate(F.theta_difference("_old", "_new")).alias("only_returning"),
        F.theta_sketch_estimate(F.theta_intersection("_new", "_old")).alias("came_back"),
    )


# --- latency ----------------------------------------------------------------------------


def latency_parts(requests: DataFrame, length: str = "1 minute") -> DataFrame:
    """Per path and minute: requests, errors, sum, largest value and a KLL sketch of the
    durations. Rows without a duration count as requests only."""
    duration = F.col("duration_ms").cast("double")
    return (
        requests.groupBy("path", F.window("ts", length).alias("w"))
        .agg(
            F.count("*").alias("requests"),
            F.count_if(F.col("status") >= 500).alias("errors"),
            F.count(duration).alias("timed"),
            F.sum(duration).alias("total_ms"),
            F.max(duration).alias("max_ms"),
            F.kll_sketch_agg_double(duration, RANKS_K).alias("durations"),
        )
        .select("path", F.col("w.start").alias("start"), "requests", "errors", "timed", "total_ms", "max_ms", "durations")
    )


def latency(
    parts: DataFrame,
    *by: str,
    as_of: datetime | None = None,
    minutes: int | None = None,
    shares: Sequence[float] = (0.5, 0.95, 0.99),
) -> DataFrame:
    """Requests, errors, mean, largest and percentiles (p50_ms, ...) of stored
    ``latency_parts``, per ``by`` (none: one row).

    ``minutes``: those parts only that start within the last minutes before ``as_of``;
    None takes all. Without durations the numbers are 0. Means and counts are exact;
    ``plans.performance.request_stats`` has exact percentiles.
    """
    rows = parts if minutes is None else within(parts, ago(as_of, minutes=minutes), ts="start")
    merged = rows.groupBy(*by).agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
        F.coalesce(F.sum("timed"), F.lit(0)).alias("timed"),
        F.sum("total_ms").alias("_total"),
        F.max("max_ms").alias("_max"),
        F.kll_merge_agg_double("durations", RANKS_K).alias("_sketch"),
    )
    values = F.when(
        F.col("timed") > 0,  # an empty sketch has no quantiles
        F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(float(s)) for s in shares])),
    )
    zero = F.lit(0.0)
    return merged.withColumn("_values", values).select(
        *by, "requests", "errors", "timed",
        F.coalesce(F.round(F.try_divide("_total", "timed"), 2), zero).alias("avg_ms"),
        F.coalesce("_max", zero).alias("max_ms"),
        *[F.coalesce(F.col("_values")[i], zero).alias(f"p{s * 100:g}_ms") for i, s in enumerate(shares)],
    )
