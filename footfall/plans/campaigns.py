"""Campaign performance and campaign-to-event conversion."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.labels import day_text
from footfall.functions.predicates import days_back, first_rows, is_clean, within
from footfall.functions.statistics import ratio

BREAKDOWN_ROWS = 20


def _clean_since(df: DataFrame, days: int, as_of: datetime | None) -> DataFrame:
    first = days_back(as_of, days)
    return within(df, first).filter(is_clean())


def campaign_stats(
    campaigns: DataFrame,
    views: DataFrame,
    *,
    days: int = 30,
    campaign_id: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """Views and visitors of every registered campaign, zeros kept.

    The views are counted per (campaign, site) before the join: only the small
    result meets the campaign table, so a dominant campaign cannot skew the join.
    """
    if campaign_id is not None:
        campaigns = campaigns.filter(F.col("id") == campaign_id)
    counted = (
        _clean_since(views, days, as_of)
        .filter(F.col("utm_campaign").isNotNull())
        .groupBy("utm_campaign", "site_id")
        .agg(F.count("*").alias("views"), F.countDistinct("visitor_id").alias("visitors"))
    )
    return (
        campaigns.join(counted, ["utm_campaign", "site_id"], "left")
        .select(
            "id", "name", "utm_campaign", "site_id", "status",
            F.coalesce("views", F.lit(0)).alias("views"),
            F.coalesce("visitors", F.lit(0)).alias("visitors"),
        )
        .orderBy(F.desc("views"), "id")
    )


def _of_campaign(
    views: DataFrame, utm_campaign: str, site: str, days: int, as_of: datetime | None
) -> DataFrame:
    return _clean_since(views, days, as_of).filter(
        (F.col("utm_campaign") == utm_campaign) & (F.col("site_id") == site)
    )


def campaign_breakdown(
    views: DataFrame,
    column: str,
    missing: str | None,
    *,
    utm_campaign: str,
    site: str,
    days: int = 30,
    as_of: datetime | None = None,
    visitors: bool = True,
) -> DataFrame:
    """Top values of one column in one campaign; NULL is labelled afterwards."""
    measures = [F.count("*").alias("views")]
    if visitors:
        measures.append(F.countDistinct("visitor_id").alias("visitors"))
    top = (
        _of_campaign(views, utm_campaign, site, days, as_of)
        .groupBy(column)
        .agg(*measures)
        .orderBy(F.desc("views"), column)
        .limit(BREAKDOWN_ROWS)
    )
    return top.fillna(missing, [column]) if missing else top


def campaign_by_source(views: DataFrame, **scope) -> DataFrame:
    return campaign_breakdown(views, "utm_source", "direct", **scope)


def campaign_by_medium(views: DataFrame, **scope) -> DataFrame:
    return campaign_breakdown(views, "utm_medium", "none", **scope)


def campaign_by_content(views: DataFrame, **scope) -> DataFrame:
    return campaign_breakdown(views, "utm_content", "none", visitors=False, **scope)


def campaign_by_term(views: DataFrame, **scope) -> DataFrame:
    return campaign_breakdown(views, "utm_term", "none", visitors=False, **scope)


def campaign_top_paths(views: DataFrame, **scope) -> DataFrame:
    return campaign_breakdown(views, "path", None, **scope)


def campaign_daily(
    views: DataFrame,
    *,
    utm_campaign: str,
    site: str,
    days: int = 30,
    as_of: datetime | None = None,
) -> DataFrame:
    return (
        _of_campaign(views, utm_campaign, site, days, as_of)
        .groupBy(day_text(F.col("created_at")).alias("date"))
        .agg(F.count("*").alias("views"), F.countDistinct("visitor_id").alias("visitors"))
        .orderBy("date")
    )


def campaign_detail(views: DataFrame, **scope) -> dict[str, DataFrame]:
    return {
        "by_source": campaign_by_source(views, **scope),
        "by_medium": campaign_by_medium(views, **scope),
        "daily_trend": campaign_daily(views, **scope),
        "top_paths": campaign_top_paths(views, **scope),
        "by_content": campaign_by_content(views, **scope),
        "by_term": campaign_by_term(views, **scope),
    }


def campaign_events(
    views: DataFrame,
    events: DataFrame,
    campaigns: DataFrame,
    *,
    site: str,
    days: int = 30,
    event_type: str | None = None,
    as_of: datetime | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Do campaign visitors trigger events? NULL campaign = organic traffic.
    All campaigns, or the ``limit`` with the most visitors.

    Both facts are aggregated per campaign before they meet; organic views meet
    organic events through a NULL-safe join.
    """
    visited = (
        _clean_since(views, days, as_of)
        .filter(F.col("site_id") == site)
        .groupBy("utm_campaign")
        .agg(F.countDistinct("visitor_id").alias("visitors"))
    )
    acted = _clean_since(events, days, as_of).filter(F.col("site_id") == site)
    if event_type is not None:
        acted = acted.filter(F.col("event_type") == event_type)
    acted = acted.groupBy(F.col("utm_campaign").alias("acted_campaign")).agg(
        F.countDistinct("visitor_id").alias("event_visitors"), F.count("*").alias("events")
    )
    registered = campaigns.filter(F.col("site_id") == site).select(
        F.col("id").alias("campaign_id"),
        F.col("name").alias("campaign_name"),
        F.col("utm_campaign").alias("registered_campaign"),
    )
    rates = (
        visited.join(acted, F.col("utm_campaign").eqNullSafe(F.col("acted_campaign")), "left")
        .join(registered, F.col("utm_campaign") == F.col("registered_campaign"), "left")
        .select(
            "campaign_id", "campaign_name", "utm_campaign", "visitors",
            F.coalesce("event_visitors", F.lit(0)).alias("event_visitors"),
            F.coalesce("events", F.lit(0)).alias("events"),
        )
        .withColumn("event_rate", ratio(F.col("event_visitors"), F.col("visitors")))
        .withColumn("events_per_visitor", ratio(F.col("events"), F.col("visitors")))
        .orderBy(F.desc("visitors"), "utm_campaign")
    )
    return first_rows(rates, limit)


def campaign_event_types(
    events: DataFrame, *, site: str, days: int = 30, as_of: datetime | None = None
) -> DataFrame:
    """Ten largest event types per campaign."""
    listed = (
        _clean_since(events, days, as_of)
        .filter(F.col("site_id") == site)
        .groupBy("utm_campaign", "event_type")
        .agg(
            F.count("*").alias("count"),
            F.countDistinct("visitor_id").alias("unique_visitors"),
        )
    )
    place = Window.partitionBy("utm_campaign").orderBy(F.desc("count"), "event_type")
    return (
        listed.withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= 10)
        .drop("place")
    )


def campaign_events_document(
    views: DataFrame,
    events: DataFrame,
    campaigns: DataFrame,
    *,
    site: str,
    days: int = 30,
    event_type: str | None = None,
    as_of: datetime | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The conversion report with each campaign's event types nested inside."""
    rows = campaign_events(
        views, events, campaigns, site=site, days=days, event_type=event_type, as_of=as_of, limit=limit
    )
    types = (
        campaign_event_types(events, site=site, days=days, as_of=as_of)
        .groupBy(F.col("utm_campaign").alias("typed_campaign"))
        .agg(
            F.expr("""
                transform(
                    array_sort(collect_list(struct(-count AS ord, event_type, count, unique_visitors))),
                    t -> struct(t.event_type, t.count, t.unique_visitors))
            """).alias("event_types")
        )
    )
    empty = F.expr("array()").cast(
        "array<struct<event_type:string,count:bigint,unique_visitors:bigint>>"
    )
    return (
        rows.join(types, F.col("utm_campaign").eqNullSafe(F.col("typed_campaign")), "left")
        .drop("typed_campaign")
        .withColumn("event_types", F.coalesce("event_types", empty))
        .orderBy(F.desc("visitors"), "utm_campaign")
    )


def campaign_list(campaigns: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Newest first; all of them, or the newest ``limit``."""
    return first_rows(campaigns.orderBy(F.desc("created_at"), "id"), limit)
