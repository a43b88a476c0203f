"""What is happening now: realtime panel, dashboard and header counters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.labels import hour_text, minute_text
from footfall.functions.predicates import ago, is_bot, is_clean, within


def _site_since(df: DataFrame, site: str, as_of: datetime | None, **span: int) -> DataFrame:
    return within(df, ago(as_of, **span)).filter(F.col("site_id") == site)


def realtime_active(
    views: DataFrame, *, site: str, as_of: datetime | None = None, minutes: int = 5
) -> DataFrame:
    return (
        _site_since(views, site, as_of, minutes=minutes)
        .filter(is_clean())
        .agg(
            F.countDistinct("visitor_id").alias("active_visitors"),
            F.count("*").alias("pageviews"),
        )
    )


def realtime_paths(
    views: DataFrame, *, site: str, as_of: datetime | None = None, minutes: int = 5
) -> DataFrame:
    return (
        _site_since(views, site, as_of, minutes=minutes)
        .filter(is_clean())
        .groupBy("path")
        .agg(F.count("*").alias("views"))
        .orderBy(F.desc("views"), "path")
        .limit(10)
    )


def dashboard_now(
    views: DataFrame, *, site: str, as_of: datetime | None = None, minutes: int = 5
) -> DataFrame:
    """Active visitors, bots and pageviews in one scan.

    Rows are first reduced to one per visitor, so the two distinct counts need
    no row expansion and a busy visitor costs one row per map task.
    """
    visitors = (
        _site_since(views, site, as_of, minutes=minutes)
        .groupBy("visitor_id")
        .agg(F.count_if(is_clean()).alias("clean"), F.count_if(is_bot()).alias("bot"))
    )
    known = F.col("visitor_id").isNotNull()
    return visitors.agg(
        F.count_if(known & (F.col("clean") > 0)).alias("active_visitors"),
        F.count_if(known & (F.col("bot") > 0)).alias("estimated_bots"),
        F.coalesce(F.sum("clean"), F.lit(0)).alias("pageviews"),
    )


def _trend(rows: DataFrame, label: Column, name: str) -> DataFrame:
    return (
        rows.filter(is_clean())
        .groupBy(label.alias(name))
        .agg(F.count("*").alias("count"))
        .orderBy(name)
    )


def minute_trend(
    rows: DataFrame, *, site: str, as_of: datetime | None = None, minutes: int = 60
) -> DataFrame:
    """Clean rows per HH:MM; works on pageviews and on events."""
    recent = _site_since(rows, site, as_of, minutes=minutes)
    return _trend(recent, minute_text(F.col("created_at")), "minute")


def hour_trend(
    rows: DataFrame, *, site: str, as_of: datetime | None = None, hours: int = 24
) -> DataFrame:
    """Clean rows per HH:00; the oldest and the newest hour may share a label."""
    recent = _site_since(rows, site, as_of, hours=hours)
    return _trend(recent, hour_text(F.col("created_at")), "hour")


def recent_visitors(
    views: DataFrame, *, site: str, as_of: datetime | None = None, minutes: int = 60
) -> DataFrame:
    return (
        _site_since(views, site, as_of, minutes=minutes)
        .filter(is_clean())
        .groupBy("visitor_id")
        .agg(
            F.max("device_type").alias("device_type"),
            F.max("os_name").alias("os_name"),
            F.max(F.concat("browser_name", F.lit(" "), "browser_version")).alias("browser"),
            F.max("country_code").alias("country_code"),
            F.max("created_at").alias("created_at"),
            F.count("*").alias("view_count"),
        )
        .orderBy(F.desc("created_at"), "visitor_id")
        .limit(20)
    )


def recent_events(
    events: DataFrame, *, site: str, as_of: datetime | None = None, minutes: int = 60
) -> DataFrame:
    return (
        _site_since(events, site, as_of, minutes=minutes)
        .filter(is_clean())
        .orderBy(F.desc("created_at"), "id")
        .limit(20)
        .select("event_type", "site_id", "visitor_id", "created_at")
    )


def _traffic(views: DataFrame) -> DataFrame:
    """Totals over all sites; reduced to one row per visitor before counting them."""
    visitors = views.groupBy("visitor_id").agg(
        F.count("*").alias("total"),
        F.count_if(is_clean()).alias("human"),
        F.count_if(is_bot()).alias("bot"),
    )
    return visitors.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_views"),
        F.coalesce(F.sum("human"), F.lit(0)).alias("human_views"),
        F.coalesce(F.sum("bot"), F.lit(0)).alias("bot_views"),
        F.count("visitor_id").alias("unique_visitors"),
    )


def summary_24h(
    views: DataFrame, *, as_of: datetime | None = None, hours: int = 24
) -> DataFrame:
    return _traffic(within(views, ago(as_of, hours=hours)))


def live_stats(
    views: DataFrame, *, as_of: datetime | None = None, minutes: int = 10
) -> DataFrame:
    recent = within(views, ago(as_of, minutes=minutes))
    return _traffic(recent).select("human_views", "bot_views", "unique_visitors")


def dashboard(
    views: DataFrame, events: DataFrame, *, site: str, as_of: datetime | None = None
) -> dict[str, DataFrame]:
    scope = dict(site=site, as_of=as_of)
    return {
        "now": dashboard_now(views, **scope),
        "hourly_visitors": minute_trend(views, **scope),
        "hourly_events": minute_trend(events, **scope),
        "daily_visitors": hour_trend(views, **scope),
        "daily_events": hour_trend(events, **scope),
        "recent_visitors": recent_visitors(views, **scope),
        "recent_events": recent_events(events, **scope),
    }
