"""Visitor lists, histories, suspicious traffic and score details."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.labels import display_time
from footfall.functions.predicates import (
    SUSPECT_SCORE,
    below_bot,
    contains_text,
    first_rows,
    is_bot,
    is_clean,
    score_band,
    where_equal,
    within,
)
from footfall.operators.paging import Page, paginate


def _distinct_list(value: Column | str) -> Column:
    """Distinct values, sorted and comma separated; NULL when there is none."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(value)), ","), F.lit(""))


def _flag_excluded(visitors: DataFrame, excluded: DataFrame) -> DataFrame:
    marks = excluded.select("visitor_id").distinct().withColumn("_mark", F.lit(1))
    return (
        visitors.join(marks, "visitor_id", "left")
        .withColumn("is_excluded", F.when(F.col("_mark").isNotNull(), 1).otherwise(0))
        .drop("_mark")
    )


def suspicious_visitors(
    views: DataFrame,
    excluded: DataFrame,
    *,
    site: str | None = None,
    min_score: int = SUSPECT_SCORE,
    limit: int = 50,
) -> DataFrame:
    """The ``limit`` visitors with the highest scores.

    They are ranked on plain numbers first; the lists of sites, devices and so on
    are built for the chosen visitors only.
    """
    browser = F.concat("browser_name", F.lit(" "), "browser_version")
    order = (F.desc("max_bot_score"), F.desc("pageviews"), F.col("visitor_id"))
    suspects = where_equal(views.filter(F.col("bot_score") >= min_score), site_id=site)
    top = (
        suspects.groupBy("visitor_id")
        .agg(
            F.max("bot_score").alias("max_bot_score"),
            F.count("*").alias("pageviews"),
            F.min("created_at").alias("first_seen"),
            F.max("created_at").alias("last_seen"),
        )
        .orderBy(*order)
        .limit(limit)
    )
    same = lambda a, b: a["visitor_id"].eqNullSafe(b["visitor_id"])
    chosen = top.select("visitor_id")
    lists = (
        suspects.join(chosen, same(suspects, chosen), "left_semi")
        .groupBy(F.col("visitor_id").alias("_visitor"))
        .agg(
            _distinct_list("site_id").alias("sites"),
            _distinct_list("device_type").alias("devices"),
            _distinct_list("country_code").alias("countries"),
            _distinct_list("os_name").alias("os_names"),
            _distinct_list(browser).alias("browsers"),
        )
    )
    return (
        _flag_excluded(
            top.join(lists, F.col("visitor_id").eqNullSafe(F.col("_visitor")), "left").drop("_visitor"),
            excluded,
        )
        .withColumn("band", score_band(F.col("max_bot_score")))
        .orderBy(*order)
    )


def excluded_report(
    excluded: DataFrame, views: DataFrame, *, limit: int | None = None
) -> DataFrame:
    """All exclusions, or the newest ``limit``, with what those visitors did."""
    newest = first_rows(excluded.orderBy(F.desc("created_at"), "visitor_id"), limit)
    stats = (
        views.join(newest.select("visitor_id"), "visitor_id", "left_semi")
        .groupBy("visitor_id")
        .agg(F.count("*").alias("pageviews"), F.max("bot_score").alias("max_bot_score"))
    )
    return (
        newest.join(stats, "visitor_id", "left")
        .withColumn("pageviews", F.coalesce("pageviews", F.lit(0)))
        .orderBy(F.desc("created_at"), "visitor_id")
    )


HISTORY_COLUMNS = (
    "kind", "path", "event_type", "site_id", "interaction_ms", "device_type", "os_name",
    "browser_name", "browser_version", "country_code", "referrer_type", "data",
    "bot_score", "is_pwa", "created_at", "is_excluded",
)


def visitor_history(
    views: DataFrame,
    events: DataFrame,
    excluded: DataFrame,
    *,
    visitor_id: str,
    newest: int | None = None,
) -> DataFrame:
    """Views and events of one visitor: all, or the ``newest`` of each."""
    mine = F.col("visitor_id") == visitor_id

    def listed(facts: DataFrame, kind: str) -> DataFrame:
        rows = facts.filter(mine)
        if newest is not None:
            rows = rows.orderBy(F.desc("created_at"), "id").limit(newest)
        return rows.withColumn("kind", F.lit(kind))

    seen, done = listed(views, "view"), listed(events, "event")
    rows = seen.unionByName(done, allowMissingColumns=True)
    return _flag_excluded(rows, excluded.filter(mine)).select(*HISTORY_COLUMNS)


def visitor_summary(views: DataFrame, events: DataFrame, *, visitor_id: str) -> DataFrame:
    """Totals and attribute sets over all views and events of one visitor."""
    mine = F.col("visitor_id") == visitor_id
    seen = (
        views.filter(mine)
        .select("created_at", "interaction_ms", "device_type", "country_code", "site_id")
        .withColumn("kind", F.lit("view"))
    )
    done = events.filter(mine).select(F.lit("event").alias("kind"))
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    is_view = F.col("kind") == "view"
    return seen.unionByName(done, allowMissingColumns=True).agg(
        F.count_if(is_view).alias("total_views"),
        F.count_if(~is_view).alias("total_events"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
        F.coalesce(F.sum("interaction_ms"), F.lit(0)).alias("total_interaction"),
        _distinct_list(given("device_type")).alias("devices"),
        _distinct_list(given("country_code")).alias("countries"),
        _distinct_list(given("site_id")).alias("sites"),
    )


def score_detail(rows: DataFrame, *, row_id: int) -> DataFrame:
    """Score of one row and one line per factor; a row without detail gives one
    line with no factor. Unreadable detail counts as empty."""
    factors = F.from_json("bot_score_detail", "map<string,string>")
    return (
        rows.filter(F.col("id") == row_id)
        .limit(1)
        .select(F.col("bot_score").alias("score"), F.explode_outer(factors))
        .withColumnsRenamed({"key": "factor", "value": "points"})
    )




def _order(sort: str, allowed: dict[str, str]):
    """Only listed sort keys are accepted."""
    if sort not in allowed:
        raise ValueError(f"unknown sort: {sort}")
    column = allowed[sort]
    return F.desc(column) if sort.endswith("_desc") else F.asc(column)


def visitor_list(
    views: DataFrame,
    *,
    site: str | None = None,
    device: str | None = None,
    country: str | None = None,
    returning: str | None = None,
    bot: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """One row per visitor. Row filters apply before grouping; the returning and
    bot filters test the visitor's maxima."""
    rows = where_equal(views, site_id=site, device_type=device, country_code=country)
    if search:
        rows = rows.filter(contains_text(["visitor_id"], search))
    visitors = rows.groupBy("visitor_id").agg(
        F.count("*").alias("view_count"),
        F.max("created_at").alias("last_seen"),
        F.min("created_at").alias("first_seen"),
        F.max("device_type").alias("device_type"),
        F.max("os_name").alias("os_name"),
        F.max(F.concat("browser_name", F.lit(" "), "browser_version")).alias("browser"),
        F.max("country_code").alias("country_code"),
        F.max("is_returning").alias("is_returning"),
        F.max("bot_score").alias("max_bot_score"),
    )
    if returning in ("returning", "new"):
        visitors = visitors.filter(F.col("is_returning") == (1 if returning == "returning" else 0))
    if bot == "suspect":
        visitors = visitors.filter(is_bot("max_bot_score"))
    elif bot == "clean":
        visitors = visitors.filter(below_bot("max_bot_score"))
    return visitors


def visitors_listing(
    views: DataFrame,
    excluded: DataFrame,
    *,
    sort: str = "time_desc",
    page: int = 1,
    **filters: str | None,
) -> Page:
    """One page of visitors; the exclusion flag is joined to that page only."""
    first = _order(
        sort,
        {
            "time_desc": "last_seen", "time_asc": "last_seen",
            "views_desc": "view_count", "views_asc": "view_count",
        },
    )
    found = paginate(visitor_list(views, **filters), first, "visitor_id", page=page)
    rows = _flag_excluded(found.rows, excluded).orderBy(first, "visitor_id")
    return Page(rows, found.total, found.page, found.per_page, found.total_pages)


def pageview_list(
    views: DataFrame,
    *,
    site: str | None = None,
    device: str | None = None,
    country: str | None = None,
    bot: str | None = None,
    search: str | None = None,
) -> DataFrame:
    rows = where_equal(views, site_id=site, device_type=device, country_code=country)
    if bot == "suspect":
        rows = rows.filter(is_bot())
    elif bot == "clean":
        rows = rows.filter(is_clean())
    if search:
        rows = rows.filter(contains_text(["visitor_id", "path"], search))
    return rows


def pageviews_listing(
    views: DataFrame,
    *,
    sort: str = "time_desc",
    page: int = 1,
    zone: str = "UTC",
    **filters: str | None,
) -> Page:
    first = _order(sort, {"time_desc": "created_at", "time_asc": "created_at"})
    found = paginate(pageview_list(views, **filters), first, "id", page=page)
    rows = found.rows.withColumn("shown_at", display_time(F.col("created_at"), zone))
    return Page(rows, found.total, found.page, found.per_page, found.total_pages)


def events_listing(
    events: DataFrame,
    *,
    site: str | None = None,
    event_type: str | None = None,
    search: str | None = None,
    page: int = 1,
) -> Page:
    rows = where_equal(events, site_id=site, event_type=event_type)
    if search:
        rows = rows.filter(contains_text(["event_type", "data"], search))
    found = paginate(rows, F.desc("created_at"), "id", page=page)
    shown = found.rows.select(
        "event_type", "site_id", "visitor_id", "data", "device_type", "bot_score",
        "is_returning", "created_at",
    )
    return Page(shown, found.total, found.page, found.per_page, found.total_pages)


def event_type_counts(events: DataFrame, *, site: str | None = None) -> DataFrame:
    return (
        where_equal(events, site_id=site)
        .groupBy("event_type")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "event_type")
    )


def facets(views: DataFrame, *, current_site: str | None = None) -> DataFrame:
    """Distinct devices, countries and sites for the filter menus, in one scan;
    the current site is listed even when it has no views yet."""
    found = (
        views.select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(kind).alias("facet"), F.col(name).alias("value"))
                        for kind, name in (
                            ("device", "device_type"),
                            ("country", "country_code"),
                            ("site", "site_id"),
                        )
                    ]
                )
            ).alias("f")
        )
        .select("f.facet", "f.value")
        .filter(F.col("value").isNotNull())
        .distinct()
    )
    if current_site is not None:
        own = found.sparkSession.range(1).select(
            F.lit("site").alias("facet"), F.lit(current_site).alias("value")
        )
        found = found.union(own).distinct()
    return found.orderBy("facet", "value")


def daily_summary(events: DataFrame, *, day: date) -> DataFrame:
    """Events, sessions, ten top paths and types and sessions per device of one day.

    One scan: each event becomes a row per section, and these shrink in every task
    to one row per section, name and session before they are shuffled.
    """
    nothing = F.lit(None).cast("string")

    def part(section: str, name: Column, session: Column = nothing) -> Column:
        return F.struct(F.lit(section).alias("section"), name.alias("name"), session.alias("session"))

    session = F.col("session_id")
    long = (
        within(events, day, day + timedelta(days=1))
        .select(
            F.inline(
                F.array(
                    part("total_events", nothing),
                    part("top_paths", F.get_json_object("data", "$.path")),
                    part("top_event_types", F.col("event_type")),
                    part("unique_sessions", nothing, session),
                    part("device_breakdown", F.col("device_type"), session),
                )
            )
        )
        .groupBy("section", "name", "session")
        .agg(F.count("*").alias("rows"))
    )
    by_session = F.col("section").isin("unique_sessions", "device_breakdown")
    counted = (
        long.groupBy("section", "name")
        .agg(F.count("session").alias("sessions"), F.sum("rows").alias("rows"))
        .select("section", "name", F.when(by_session, F.col("sessions")).otherwise(F.col("rows")).alias("n"))
    )
    ranked = F.col("section").isin("top_paths", "top_event_types")
    # names of the other sections stand alone, so one rank filter fits all
    place = Window.partitionBy("section", F.when(~ranked, F.col("name"))).orderBy(F.desc("n"), "name")
    found = (
        counted.filter(~ranked | F.col("name").isNotNull())
        .withColumn("_place", F.row_number().over(place))
        .filter(F.col("_place") <= 10)
        .drop("_place")
    )
    # a day without events still has its two totals
    totals = found.sparkSession.createDataFrame(
        [("total_events",), ("unique_sessions",)], "section string"
    ).select("section", nothing.alias("name"), F.lit(0).cast("bigint").alias("n"))
    return found.unionByName(totals).groupBy("section", "name").agg(F.max("n").alias("n"))
