"""Site overview: rollup history plus today's raw rows, and raw breakdowns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.labels import resolution_label
from footfall.functions.predicates import days_back, is_clean, now_utc, within


def _history(daily: DataFrame, site: str, days: int, as_of: datetime | None) -> DataFrame:
    first = days_back(as_of, days)
    return daily.filter((F.col("site_id") == site) & (F.col("date") >= F.lit(first)))


def _closed_days(daily: DataFrame, site: str, days: int, as_of: datetime | None) -> DataFrame:
    today = now_utc(as_of).date()
    return _history(daily, site, days, as_of).filter(F.col("date") < F.lit(today))


def _today(views: DataFrame, site: str, as_of: datetime | None) -> DataFrame:
    today = now_utc(as_of).date()
    return within(views, today).filter((F.col("site_id") == site) & is_clean())


def _recent(views: DataFrame, site: str, days: int, as_of: datetime | None) -> DataFrame:
    first = days_back(as_of, days)
    return within(views, first).filter((F.col("site_id") == site) & is_clean())


def overview_visits(
    views: DataFrame, daily: DataFrame, *, site: str, days: int = 30, as_of: datetime | None = None
) -> DataFrame:
    closed = _closed_days(daily, site, days, as_of).agg(F.sum("visits").alias("visits"))
    fresh = _today(views, site, as_of).agg(F.count("*").alias("visits"))
    return closed.unionByName(fresh).agg(F.coalesce(F.sum("visits"), F.lit(0)).alias("visits"))


def overview_unique_visitors(
    views: DataFrame, daily: DataFrame, *, site: str, days: int = 30, as_of: datetime | None = None
) -> DataFrame:
    """Per closed day the largest segment (distinct counts do not add up), plus today."""
    closed = (
        _closed_days(daily, site, days, as_of)
        .groupBy("date")
        .agg(F.max("unique_visitors").alias("uv"))
        .agg(F.sum("uv").alias("unique_visitors"))
    )
    fresh = _today(views, site, as_of).agg(
        F.countDistinct("visitor_id").alias("unique_visitors")
    )
    return closed.unionByName(fresh).agg(
        F.coalesce(F.sum("unique_visitors"), F.lit(0)).alias("unique_visitors")
    )


def overview_avg_interaction(
    daily: DataFrame, *, site: str, days: int = 30, as_of: datetime | None = None
) -> DataFrame:
    """Unweighted mean of the rollup rows' means, truncated."""
    mean = F.avg("avg_interaction_ms").cast("bigint")
    return _closed_days(daily, site, days, as_of).agg(
        F.coalesce(mean, F.lit(0).cast("bigint")).alias("avg_interaction_ms")
    )


def _views_and_visitors(rows: DataFrame, key: Column, name: str, limit: int) -> DataFrame:
    return (
        rows.groupBy(key.alias(name))
        .agg(F.count("*").alias("views"), F.countDistinct("visitor_id").alias("visitors"))
        .orderBy(F.desc("views"), name)
        .limit(limit)
    )


def top_paths(
    views: DataFrame, *, site: str, days: int = 30, as_of: datetime | None = None
) -> DataFrame:
    return _views_and_visitors(_recent(views, site, days, as_of), F.col("path"), "path", 20)


def devices(
    daily: DataFrame, *, site: str, days: int = 30, as_of: datetime | None = None
) -> DataFrame:
    return (
        _history(daily, site, days, as_of)
        .groupBy("device_type")
        .agg(F.sum("visits").alias("visits"))
        .orderBy(F.desc("visits"), "device_type")
    )


def countries(
    daily: DataFrame, *, site: str, days: int = 30, as_of: datetime | None = None
) -> DataFrame:
    return (
        _history(daily, site, days, as_of)
        .filter(F.col("country_code") != "unknown")
        .groupBy("country_code")
        .agg(F.sum("visits").alias("visits"), F.sum("unique_visitors").alias("visitors"))
        .orderBy(F.desc("visits"), "country_code")
        .limit(10)
    )


def referrers(
    views: DataFrame, *, site: str, days: int = 30, as_of: datetime | None = None
) -> DataFrame:
    return (
        _recent(views, site, days, as_of)
        .groupBy("referrer_type")
        .agg(F.count("*").alias("views"))
        .orderBy(F.desc("views"), "referrer_type")
    )


def os_systems(
    views: DataFrame, *, site: str, days: int = 30, as_of: datetime | None = None
) -> DataFrame:
    """Grouped on the stored name; a missing one is only labelled afterwards."""
    top = _views_and_visitors(_recent(views, site, days, as_of), F.col("os_name"), "os_name", 20)
    return top.withColumn("os_name", F.coalesce("os_name", F.lit("Unknown")))


def browsers(
    views: DataFrame, *, site: str, days: int = 30, as_of: datetime | None = None
) -> DataFrame:
    browser = F.coalesce(
        F.concat("browser_name", F.lit(" "), "browser_version"),
        F.col("browser_name"),
        F.lit("Unknown"),
    )
    return _views_and_visitors(_recent(views, site, days, as_of), browser, "browser", 20)


def resolutions(
    views: DataFrame, *, site: str, days: int = 30, as_of: datetime | None = None
) -> DataFrame:
    size = F.concat(
        F.coalesce("screen_width", F.lit(0)).cast("string"),
        F.lit("x"),
        F.coalesce("screen_height", F.lit(0)).cast("string"),
    )
    top = _views_and_visitors(_recent(views, site, days, as_of), size, "resolution", 20)
    return top.withColumn("resolution", resolution_label(F.col("resolution")))


def daily_trend(
    daily: DataFrame, *, site: str, days: int = 30, as_of: datetime | None = None
) -> DataFrame:
    return (
        _history(daily, site, days, as_of)
        .groupBy("date")
        .agg(F.sum("visits").alias("visits"), F.sum("unique_visitors").alias("visitors"))
        .orderBy("date")
    )


def overview(
    views: DataFrame, daily: DataFrame, *, site: str, days: int = 30, as_of: datetime | None = None
) -> dict[str, DataFrame]:
    """Every section of the overview page, one DataFrame each."""
    window = dict(site=site, days=days, as_of=as_of)
    return {
        "visits": overview_visits(views, daily, **window),
        "unique_visitors": overview_unique_visitors(views, daily, **window),
        "avg_interaction_ms": overview_avg_interaction(daily, **window),
        "top_paths": top_paths(views, **window),
        "devices": devices(daily, **window),
        "countries": countries(daily, **window),
        "referrers": referrers(views, **window),
        "os_systems": os_systems(views, **window),
        "browsers": browsers(views, **window),
        "resolutions": resolutions(views, **window),
        "daily_trend": daily_trend(daily, **window),
    }
