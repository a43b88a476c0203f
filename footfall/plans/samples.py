"""The sample reports site owners run by hand. They use the looser human test
(score below 50), which also lets API rows through."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.labels import day_text
from footfall.functions.predicates import BOT_SCORE, SUSPECT_SCORE, below_bot, days_back, first_rows, within


def _human(rows: DataFrame, as_of: datetime | None = None, days: int | None = None) -> DataFrame:
    rows = rows.filter(below_bot())
    return rows if days is None else _last(rows, as_of, days)


def _last(rows: DataFrame, as_of: datetime | None, days: int) -> DataFrame:
    return within(rows, days_back(as_of, days))


def _share(counted: DataFrame) -> DataFrame:
    """Percentage of the total, over the already grouped rows."""
    total = F.sum("views").over(Window.partitionBy())
    return counted.withColumn("pct", F.round(F.col("views") * 100.0 / total, 1))


def _seconds(ms: str) -> Column:
    return F.round(F.avg(ms) / 1000.0, 1)


def views_per_day(views: DataFrame, *, days: int | None = None) -> DataFrame:
    """Newest day first; every day with views, or the newest ``days`` of them."""
    per_day = (
        _human(views)
        .groupBy(day_text(F.col("created_at")).alias("day"))
        .agg(F.count("*").alias("views"))
        .orderBy(F.desc("day"))
    )
    return first_rows(per_day, days)


def top_pages_week(views: DataFrame, *, as_of: datetime | None = None) -> DataFrame:
    return (
        _human(views, as_of, 7)
        .groupBy("path")
        .agg(F.count("*").alias("views"), F.countDistinct("visitor_id").alias("visitors"))
        .orderBy(F.desc("views"), "path")
        .limit(20)
    )


def uniques_by_country(views: DataFrame, *, as_of: datetime | None = None) -> DataFrame:
    return (
        _human(views, as_of, 30)
        .groupBy("country_code")
        .agg(F.countDistinct("visitor_id").alias("visitors"))
        .orderBy(F.desc("visitors"), "country_code")
    )


def device_share(views: DataFrame, *, as_of: datetime | None = None) -> DataFrame:
    counted = (
        _human(views, as_of, 30).groupBy("device_type").agg(F.count("*").alias("views"))
    )
    return _share(counted).orderBy(F.desc("views"), "device_type")


def avg_interaction_by_page(views: DataFrame, *, as_of: datetime | None = None) -> DataFrame:
    return (
        _human(views, as_of, 30)
        .filter(F.col("interaction_ms") > 0)
        .groupBy("path")
        .agg(F.count("*").alias("views"), _seconds("interaction_ms").alias("avg_seconds"))
        .orderBy(F.desc("avg_seconds"), "path")
        .limit(20)
    )


def returning_vs_new(views: DataFrame, *, as_of: datetime | None = None) -> DataFrame:
    counted = (
        _human(views, as_of, 30)
        .groupBy("is_returning")
        .agg(F.countDistinct("visitor_id").alias("visitors"), F.count("*").alias("pageviews"))
    )
    kind = F.when(F.col("is_returning") == 1, "returning").otherwise("new")
    return counted.select(kind.alias("type"), "visitors", "pageviews")


def utm_performance(views: DataFrame) -> DataFrame:
    return (
        _human(views)
        .filter(F.col("utm_campaign").isNotNull())
        .groupBy("utm_campaign")
        .agg(
            F.count("*").alias("pageviews"),
            F.countDistinct("visitor_id").alias("visitors"),
            _seconds("interaction_ms").alias("avg_seconds"),
        )
        .orderBy(F.desc("pageviews"), "utm_campaign")
    )


def bot_categories(views: DataFrame, *, as_of: datetime | None = None) -> DataFrame:
    score = F.col("bot_score")
    category = (
        F.when(score >= BOT_SCORE, "likely bot")
        .when(score >= SUSPECT_SCORE, "suspect")
        .otherwise("likely human")
    )
    counted = (
        _last(views, as_of, 7).groupBy(category.alias("category")).agg(F.count("*").alias("views"))
    )
    return _share(counted).orderBy(F.desc("views"), "category")


def hourly_pattern(views: DataFrame, *, as_of: datetime | None = None) -> DataFrame:
    return (
        _human(views, as_of, 7)
        .groupBy(F.hour("created_at").alias("hour_utc"))
        .agg(F.count("*").alias("views"))
        .orderBy("hour_utc")
    )


def event_types(events: DataFrame, *, as_of: datetime | None = None) -> DataFrame:
    return (
        _human(events, as_of, 30)
        .groupBy("event_type")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "event_type")
    )
