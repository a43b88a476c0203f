"""Daily rollup of pageviews, and its variant with mergeable distinct counts."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.predicates import is_clean, within

SEGMENT = ["site_id", "date", "device_type", "country_code", "is_returning"]


def _check(day: date | str) -> date:
    return day if isinstance(day, date) else date.fromisoformat(day)


def countable_views(
    views: DataFrame, first: date | None = None, last: date | None = None
) -> DataFrame:
    """Clean views of the given days, with their rollup segment."""
    end = None if last is None else last + timedelta(days=1)
    return within(views, first, end).filter(is_clean()).select(
        "site_id",
        F.to_date("created_at").alias("date"),
        F.coalesce("device_type", F.lit("unknown")).alias("device_type"),
        F.coalesce("country_code", F.lit("unknown")).alias("country_code"),
        "is_returning",
        "visitor_id",
        F.when(F.col("interaction_ms") > 0, F.col("interaction_ms")).alias("ms"),
    )


def _per_visitor(
    views: DataFrame,
    excluded: DataFrame,
    first: date | str | None,
    last: date | str | None,
) -> DataFrame:
    """One row per segment and visitor, excluded visitors removed.

    The views shrink before the exclusion list is looked at: a visitor with a
    third of the traffic is then a handful of rows in the anti join.
    """
    first = None if first is None else _check(first)
    last = None if last is None else _check(last)
    visitors = (
        countable_views(views, first, last)
        .groupBy(*SEGMENT, "visitor_id")
        .agg(
            F.count("*").alias("visits"),
            F.sum("ms").alias("ms_sum"),
            F.count("ms").alias("ms_count"),
        )
    )
    return visitors.join(excluded.select("visitor_id"), "visitor_id", "left_anti")


def rollup_days(
    views: DataFrame,
    excluded: DataFrame,
    first: date | str | None = None,
    last: date | str | None = None,
) -> DataFrame:
    """The rollup of every day in the range. With one row per segment and
    visitor the distinct count is a plain count."""
    mean = (F.sum("ms_sum") / F.nullif(F.sum("ms_count"), F.lit(0))).cast("bigint")
    return (
        _per_visitor(views, excluded, first, last)
        .groupBy(*SEGMENT)
        .agg(
            F.sum("visits").alias("visits"),
            F.count("visitor_id").alias("unique_visitors"),
            F.coalesce(mean, F.lit(0).cast("bigint")).alias("avg_interaction_ms"),
        )
    )


def daily_rollup(views: DataFrame, excluded: DataFrame, day: date | str) -> DataFrame:
    """The rollup of one UTC day; a malformed day raises ValueError."""
    return rollup_days(views, excluded, day, day)


def rollup_sketches(
    views: DataFrame,
    excluded: DataFrame,
    first: date | str | None = None,
    last: date | str | None = None,
) -> DataFrame:
    """Rollup rows with a visitor sketch, so that uniques merge over days. The sketch
    takes the clean rows as they come: it is what makes a distinct step needless."""
    first = None if first is None else _check(first)
    last = None if last is None else _check(last)
    rows = countable_views(views, first, last)
    return (
        rows.join(excluded.select("visitor_id").distinct(), "visitor_id", "left_anti")
        .groupBy(*SEGMENT)
        .agg(
            F.count("*").alias("visits"),
            F.hll_sketch_agg("visitor_id", 14).alias("visitors_sketch"),
        )
    )


def approx_uniques(sketches: DataFrame, *by: str) -> DataFrame:
    """Approximate unique visitors of any coarser grouping of sketch rows."""
    return sketches.groupBy(*by).agg(
        F.sum("visits").alias("visits"),
        F.hll_sketch_estimate(F.hll_union_agg("visitors_sketch")).alias("approx_visitors"),
    )
